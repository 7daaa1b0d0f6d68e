"""Joins, merges, upserts, crawling, search, files, jobs and streaming."""

import pytest
from pyspark.sql import functions as F

from tidewater.operators import catalog as K
from tidewater.operators import relational as R
from tidewater.plans import ingest, jobs, options
from tidewater.sources import fetch as H
from tidewater.sources import files as S
from tidewater.sources.staging import staged, unstaged
from tidewater.sources.tables import StoredTable
from tidewater.streaming.upserts import streamed_table, upsert_stream

PRODUCT = "product_id string, insurer_id string, name string, category string, product_url string, description string, discovered_from_url string, tags_json string, metadata_json string, updated_at string"


def product(i, seq=None, **changes):
    row = dict.fromkeys((c.split()[0] for c in PRODUCT.split(", ")), "x") | {"product_id": i} | changes
    return tuple(row.values()) + ((seq,) if seq is not None else ())


def test_upsert_keeps_some_columns_and_is_idempotent(spark):
    stored = spark.createDataFrame([product("a", insurer_id="i1", name="old"), product("b")], PRODUCT)
    coming = spark.createDataFrame([product("a", 1, insurer_id="i2", name="mid", description="d"), product("a", 2, insurer_id="i3", name="new", description=None), product("c", 3), product("c", 4, name="last", insurer_id="i9")], PRODUCT + ", seq long")
    once = R.PRODUCT_ROWS.apply(stored, coming)
    rows = {r.product_id: r for r in once.collect()}
    assert (rows["a"].insurer_id, rows["a"].name, rows["a"].description) == ("i1", "new", None)
    assert (rows["c"].insurer_id, rows["c"].name) == ("x", "last") and rows["b"].name == "x"
    assert sorted(R.PRODUCT_ROWS.apply(once, coming).collect()) == sorted(once.collect())


def test_empty_sections_overwrite_unless_the_best_is_kept(spark):
    schema = "product_id string, section_name string, category string, schema_version string, section_body string, confidence double, source_document_id string"
    stored = spark.createDataFrame([("p", "Claims", "health", "1.0", "good", 0.8, "d1")], schema)
    coming = spark.createDataFrame([("p", "Claims", "motor", "1.0", "", 0.0, "d2", 1)], schema + ", seq long")
    assert R.upsert_sections(stored, coming).first().section_body == ""
    kept = R.upsert_sections(stored, coming, keep_best=True).first()
    assert (kept.section_body, kept.category) == ("good", "health")


def test_merges(spark):
    rows = [("p", 1, "i1", "n1", "c", "u1", "", ["a", "b"], {"k": "1", "z": "1"}), ("p", 2, "i2", "n2", "c", "u2", "text", ["b", "c"], {"k": "2"})]
    merged = R.PRODUCTS.apply(spark.createDataFrame(rows, "product_id string, seq long, insurer_id string, name string, category string, product_url string, description string, tags array<string>, metadata map<string,string>").repartition(2)).first()
    assert (merged.insurer_id, merged.name, merged.description, merged.tags, merged.metadata) == ("i1", "n1", "text", ["a", "b", "c"], {"k": "2", "z": "1"})
    bare = [("q", 1, "i", "n", "c", "u", "", None, None), (None, 1, "i", "n", "c", "u", "", ["t"], {"k": None})]
    merged = R.PRODUCTS.apply(spark.createDataFrame(bare, "product_id string, seq long, insurer_id string, name string, category string, product_url string, description string, tags array<string>, metadata map<string,string>")).collect()
    assert {r.product_id: (r.tags, r.metadata) for r in merged} == {"q": ([], {}), None: (["t"], {"k": None})}


def test_first_match_within_a_page(spark):
    docs = spark.createDataFrame([("i", "p", "d1", "Brochure of Beta and Alpha"), ("i", "p", "d2", "other"), ("i", "q", "d3", ""), ("i", "r", "d4", "Alpha")], "insurer_id string, page_url string, document_id string, anchor_text string")
    products = spark.createDataFrame([("i", "p", "a", "alpha", 1), ("i", "p", "b", "beta", 0), ("i", "q", "c", "gamma", 0)], "insurer_id string, page_url string, product_id string, name string, pos int")
    assert {r.document_id: r.product_id for r in R.match_products(docs, products).collect()} == {"d1": "b", "d2": None, "d3": "c", "d4": None}


def test_pages_without_products_borrow_earlier_ones(spark):
    products = spark.createDataFrame([("i", "p0", 0, 0, "a", "Alpha"), ("i", "p2", 2, 1, "b", "Beta"), ("i", "p2", 2, 0, "c", "Gamma")], "insurer_id string, page_url string, visit long, pos int, product_id string, name string")
    docs = [("i", "p0", 0, "d0", "x"), ("i", "p1", 1, "d1", "x"), ("i", "p1", 1, "d2", "beta"), ("i", "p3", 3, "d3", "beta and gamma"), ("i", "p3", 3, "d4", None), ("i", "p2", 2, "d5", "beta"), ("j", "p4", 4, "d6", "alpha"), ("i", "p-", -1, "d7", "alpha")]
    frame = spark.createDataFrame(docs, "insurer_id string, page_url string, visit long, document_id string, anchor_text string")
    found = {r.document_id: r.product_id for r in R.match_in_scope(frame, products).collect()}
    assert found == {"d0": "a", "d1": "a", "d2": "a", "d3": "c", "d4": None, "d5": "b", "d6": None, "d7": None}


def test_lookups_without_a_key(spark):
    rows = spark.createDataFrame([("a", 1), (None, 2), ("", 3), ("z", 4)], "k string, n int")
    found = R.lookup(rows, spark.createDataFrame([("a", "A"), ("", "blank")], "k string, v string"), "k", "v")
    assert found.columns == ["k", "n", "v"] and {r.n: r.v for r in found.collect()} == {1: "A", 2: "", 3: "", 4: ""}


def test_crawl_order_depth_and_budget(spark):
    links = spark.createDataFrame([("a", 0, "b"), ("a", 1, "c"), ("b", 0, "d"), ("c", 0, "b"), ("c", 1, "e"), ("d", 0, "f"), ("a", 2, "a")], "url string, pos int, target string")
    roots = spark.createDataFrame([("a", "a"), ("c", "c")], "root string, url string")
    seen = {(r.root, r.url): (r.depth, r.visit) for r in R.crawl(roots, links, max_depth=2).collect()}
    assert seen == {("a", "a"): (0, 0), ("a", "b"): (1, 1), ("a", "c"): (1, 2), ("a", "d"): (2, 3), ("a", "e"): (2, 4), ("c", "c"): (0, 0), ("c", "b"): (1, 1), ("c", "e"): (1, 2), ("c", "d"): (2, 3)}
    assert {r.url for r in R.crawl(roots.limit(1), links, max_pages=3).collect()} == {"a", "b", "c"}


def test_filters_by_insurer(spark):
    names = spark.createDataFrame([("i1", "One"), ("i2", "Two")], "insurer_id string, name string")
    rows = spark.createDataFrame([("i1", 1), ("i2", 2)], "insurer_id string, x int")
    assert R.by_insurers(rows, names, ["two"]).count() == 1
    assert R.by_insurers(rows, names, ["none"]).count() == 2 and R.by_insurers(rows, names, ["none"], strict=True).count() == 0


def catalogue(spark):
    rows = [(0, "moor", "Moor Shield", "Moor Health", 4.7, 842, "base-plan", ["restoration"], "health_base"), (1, "elevate", "Moor Elevate", "Moor Health", 4.4, 312, "topup-plan", ["global"], "health_topup"), (2, "lake", "Lake Health Supreme", "Lake Health & Co", 4.1, 690, "base-plan", ["maternity"], "health_base"), (3, "dale", "Protect 3D", "Dale Life", 4.9, 512, "term-plan", ["term"], "life_term")]
    frame = spark.createDataFrame(rows, "ordinal int, id string, name string, insurer string, rating double, priceFrom int, coverageType string, tags array<string>, categoryId string")
    empty = F.array().cast("array<struct<id:string,rating:int>>")
    return frame.withColumns({"coverageAmount": F.lit("x"), "policyExcerpt": F.lit("excerpt"), "policyDocumentUrl": F.lit("u"), "highlights": F.array(F.lit("h")), "policyWording": F.lit("wording"), "reviews": empty})


def test_search(spark):
    items = catalogue(spark)
    ids = lambda **q: [r.id for r in K.search(items, K.ProductQuery(**q)).items.collect()]
    assert ids() == ["moor", "elevate", "lake", "dale"] and ids(sort="price_low") == ["elevate", "dale", "lake", "moor"] and ids(sort="rating")[0] == "dale"
    assert ids(search="Lake Supreme") == [] and ids(search="moor elevate MOOR health") == ["elevate"] and ids(search="3d dale") == ["dale"]
    assert ids(category="health_base", tags=("maternity", "x")) == ["lake"] and ids(coverage_types=("term-plan", "topup-plan")) == ["elevate", "dale"]
    page = K.search(items, K.ProductQuery(page=2, page_size=3))
    assert [r.id for r in page.items.collect()] == ["dale"] and (page.total, page.pages, page.clamped(9), page.clamped(0)) == (4, 2, 2, 1)
    assert "TakeOrderedAndProject" in page.items._jdf.queryExecution().executedPlan().toString()
    assert K.detail(items, "lake").first().name == "Lake Health Supreme"
    with pytest.raises(LookupError):
        K.detail(items, "none")
    labels = spark.createDataFrame([("health_base", "Retail Health")], "id string, label string")
    assert [(r.id, r.label) for r in K.suggestions(items, labels, "MOOR").collect()] == [("moor", "Retail Health"), ("elevate", "All")]
    assert K.suggestions(items, labels, "").count() == 0
    counts = K.category_counts(spark.createDataFrame([("health_base",), ("motor",)], "id string"), items)
    assert {r.id: r.productCount for r in counts.collect()} == {"health_base": 2, "motor": 0}


def test_lists(spark):
    row = spark.range(1).select(K.toggle(F.array(F.lit("a"), F.lit("b")), F.lit("a")).alias("off"), K.toggle(F.array(F.lit("b")), F.lit("a")).alias("on"), K.remember(F.array(*map(F.lit, "abcdef")), F.lit(" c ")).alias("seen")).first()
    assert (row.off, row.on, row.seen) == (["b"], ["b", "a"], ["c", "a", "b", "d", "e", "f"])


def test_files_come_back(spark, tmp_path):
    rows = spark.createDataFrame([("b", 'quote " and, comma\nline', None), ("a", "", "x")], "name string, text string, more string")
    S.write_csv(rows, f"{tmp_path}/csv")
    back = S.read_csv(spark, f"{tmp_path}/csv", "more string, name string, text string")
    assert {(r.name, r.text) for r in back.collect()} == {("b", 'quote " and, comma\nline'), ("a", None)}
    S.write_json(rows, f"{tmp_path}/json", "name")
    assert spark.read.json(f"{tmp_path}/json").count() == 2
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "a.txt").write_bytes(b"abc")
    assert S.file_hashes(spark, f"{tmp_path}/files").first().content_hash == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    assert S.file_listing(spark, f"{tmp_path}/files").first().path.endswith("a.txt")
    contents = spark.createDataFrame([("a.TXT", bytearray(b"ab")), ("b.pdf", bytearray(b"x")), ("c.bad", bytearray(b"y"))], "path string, content binary")
    texts = S.extract_text(contents, {".txt": lambda c: c.decode() + "योजना", ".bad": lambda c: 1 / 0})
    assert {r.path: r.extracted_text for r in texts.collect()} == {"a.TXT": "ab", "b.pdf": "", "c.bad": ""}
    (tmp_path / "queue.json").write_text('{"documents": [{"document_id": "d", "insurer_id": "i", "product_id": ""}]}')
    entry = S.read_queue(spark, f"{tmp_path}/queue.json").first()
    assert (entry.insurer_name, entry.product_id) == ("i", None)


def test_commits_are_seen_at_once_or_not_at_all(spark, tmp_path, monkeypatch):
    stored = StoredTable(f"file://{tmp_path}/table", ("id",), 4)
    assert stored.read(spark) is None
    folders = lambda: sorted(p.name for p in (tmp_path / "table").iterdir() if p.name.startswith("data-"))
    stored.replace(spark.range(100))
    assert stored.read(spark).count() == 100
    first = stored.read(spark)

    def die(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(StoredTable, "_publish", die)  # the data are written, the manifest is not
        with pytest.raises(RuntimeError):
            stored.replace(spark.range(7))
    assert stored.read(spark).count() == 100 and len(folders()) == 2
    stored.replace(spark.range(50))
    assert stored.read(spark).count() == 50 and first.count() == 100 and len(folders()) == 2
    only = [r[0] for r in spark.range(1).select(stored.bucket()).collect()]
    kept = stored.read(spark, only).count()
    stored.rewrite(spark.range(1), only)
    assert stored.read(spark).count() == 50 - kept + 1 and stored.read(spark, only).count() == 1
    stored.rewrite(spark.range(0), only)
    assert stored.read(spark).count() == 50 - kept and stored.read(spark, only).count() == 0
    with pytest.raises(ValueError):
        StoredTable(f"file://{tmp_path}/table", ("id",), 5).read(spark)
    with monkeypatch.context() as m:
        m.setattr(StoredTable, "_last", lambda self, _: (2, None))  # a second writer that missed a commit
        with pytest.raises(RuntimeError):
            stored.replace(spark.range(3))


def test_staged_tables_go_when_asked(spark):
    kept, gone = staged(spark.range(3), "kept"), staged(spark.range(4), "gone")
    unstaged(gone, spark.range(2))
    assert kept.count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FILE_NOT_EXIST"):
        gone.collect()


def test_retry_rounds_carry_failures_only(spark):
    rows = spark.range(10).withColumnRenamed("id", "document_id")
    asked = []

    def attempt(todo, n):
        asked.append(todo.count())
        return todo.where(F.col("document_id") % (3 - n) == 0)

    done, left = jobs.retry_rounds(rows, attempt, rounds=1)
    assert asked == [10, 6] and done.count() == 7 and left.count() == 3


def test_reprocess(spark):
    docs = spark.createDataFrame([("d1", "p", "i1", "Eligibility\nAdults only, from 18 years on.", "2024"), ("d2", None, "i2", "", "2025"), ("d3", "p", "i1", None, "2025")], "document_id string, product_id string, insurer_id string, extracted_text string, updated_at string")
    names = spark.createDataFrame([("i1", "One"), ("i2", "Two")], "insurer_id string, name string")
    assert [r.document_id for r in jobs.Reprocess(limit=2).documents(docs, names).collect()] == ["d2", "d3"]
    assert [r.document_id for r in jobs.Reprocess(("one",), only_missing_text=True).documents(docs, names).collect()] == ["d3"]
    products = spark.createDataFrame([("p", "health")], "product_id string, category string")
    assert jobs.Reprocess().sections(docs, products).where("confidence = 1").count() == 1


def test_fetches_take_turns_and_fail_as_data(spark):
    def get(url):
        if "bad" in url:
            raise OSError("down")
        return (200, "text/html", b"<p>" + url.encode()) if "page" in url else (200, "application/pdf", b"x" * 50) if "pdf" in url else (500, "", b"")

    rows = spark.createDataFrame([("a", "page1"), ("a", "bad"), ("b", "pdf"), ("b", ""), ("c", None), ("c", "err")], "insurer_id string, url string")
    found = {r.url: r for r in H.fetch(rows, get, throttle=H.Throttle(2, 0, 0.01), most=40).select("*", H.html_of().alias("html")).collect()}
    assert (found["page1"].html, found["page1"].error) == ("<p>page1", None) and found["bad"].error == "OSError: down"
    assert found["pdf"].error == "too large" and found["pdf"].html is None and found["err"].error == "status 500" and found[""].error == found[None].error == "no address"
    assert H.fetch(rows, get, throttle=H.Throttle(3, 0, 0)).rdd.getNumPartitions() == 3
    with pytest.raises(ValueError):
        H.Throttle(1, 2, 1)
    with pytest.raises(Exception, match="down"):
        H.strict(H.fetch(rows.limit(2), get, throttle=H.Throttle(1, 0, 0))).collect()


def test_options():
    assert options.ingest_options([]) == ingest.Limits() and options.reprocess_options([]) == jobs.Reprocess()
    given = options.reprocess_options(["--insurer", "a", "--insurer", "b", "--max-documents", "3", "--only-missing-text", "--skip-policy-sections"])
    assert given == jobs.Reprocess(("a", "b"), only_missing_text=True, limit=3, with_sections=False)
    assert options.ingest_options(["--no-download-documents", "--max-depth", "2"]) == ingest.Limits(max_depth=2, download=False)
    assert options.download_options(["--min-delay", "0", "--max-parallel-insurers", "0"]).throttle == H.Throttle(1, 0, 4) and options.download_options([]) == jobs.Download()
    with pytest.raises(ValueError):
        options.download_options(["--min-delay", "5"])


def test_stream_of_upserts(spark, tmp_path):
    changes = f"{tmp_path}/changes"
    rows = lambda *x: spark.createDataFrame(list(x), PRODUCT + ", seq long").write.mode("append").parquet(changes)
    rows(product("a", 1, name="one"), product("b", 2))
    run = lambda: upsert_stream(spark.readStream.schema(PRODUCT + ", seq long").parquet(changes), f"file://{tmp_path}/table", R.PRODUCT_ROWS, "seq", f"{tmp_path}/check", buckets=4).awaitTermination()
    run()
    rows(product("a", 3, name="two", insurer_id="late"))
    run()
    run()
    table = {r.product_id: r for r in streamed_table(f"file://{tmp_path}/table", R.PRODUCT_ROWS, 4).read(spark).collect()}
    assert set(table) == {"a", "b"} and (table["a"].name, table["a"].insurer_id) == ("two", "x")
