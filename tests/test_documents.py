"""Documents stored as files, the download job, envelopes in parts, and how files are reprocessed."""

import json
from hashlib import sha256
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidewater.plans import jobs
from tidewater.sources import files
from tidewater.sources.documents import stored_documents, write_documents
from tidewater.sources.fetch import Throttle


def below(folder):
    return sorted(str(p.relative_to(folder)) for p in Path(folder).rglob("*") if p.is_file() and not p.name.endswith(".crc"))


def listed(spark, folder):
    return sorted((r.path, bytes(r.content)) for r in stored_documents(spark, folder).select("path", "content").collect())


def test_files_are_written_and_listed(spark, tmp_path):
    folder = f"file://{tmp_path}/docs"
    assert listed(spark, folder) == []
    rows = [(f"i{k % 3}/d {k}.pdf", bytes([k]) * k) for k in range(40)] + [("top.bin", b"\x00\xff"), ("i0/ü.doc", "é".encode())]
    write_documents(spark.createDataFrame(rows, "path string, content binary").repartition(5), folder)
    assert listed(spark, folder) == sorted(r for r in rows if r[1])
    write_documents(spark.createDataFrame([("top.bin", b"new"), ("none", None)], "path string, content binary"), folder)
    assert dict(listed(spark, folder)) == {p: c for p, c in rows if c} | {"top.bin": b"new"}
    write_documents(spark.createDataFrame([], "path string, content binary"), folder)
    assert below(tmp_path / "docs") == sorted([p for p, _ in rows] + ["none"])


def test_tasks_that_read_files_do_not_grow_with_the_files(spark, tmp_path):
    write_documents(spark.range(1000).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("path"), F.lit(b"x").alias("content")), f"file://{tmp_path}/docs")
    found = stored_documents(spark, f"file://{tmp_path}/docs")
    assert found.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism and found.count() == 1000
    assert "ReadSchema: struct<path:string>" in found.select("path")._jdf.queryExecution().executedPlan().toString()


def test_names_of_stored_files_stay_off_the_driver(spark, tmp_path):
    rows = [("a/b/c/d.pdf", b"1"), ("a/e f.pdf", b"22"), ("ü%20.doc", b"333"), ("a/_hidden/x.pdf", b"4"), ("a/.y", b"5"), *[(f"big{k}", bytes([k]) * (3 << 20)) for k in range(3)]]
    write_documents(spark.createDataFrame(rows, "path string, content binary").repartition(1), f"file://{tmp_path}/docs")
    found = stored_documents(spark, f"file://{tmp_path}/docs")
    assert sorted((r.path, r.length, bytes(r.content)) for r in found.coalesce(1).collect()) == sorted((p, len(c), c) for p, c in rows if p not in ("a/_hidden/x.pdf", "a/.y"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "binaryFile" not in plan(found) and "ArrowEvalPython" not in plan(found.select("path", "length"))
    names = spark.range(3).select(F.concat(F.lit("big"), F.col("id").cast("string")).alias("path"))
    assert "Broadcast" not in plan(names.join(found, "path", "left")) and names.join(found, "path").count() == 3
    docs = spark.createDataFrame([("D 1", "i1", "https://h/1.pdf", "a/e f.pdf", "p1"), ("D 2", "i1", "https://h/2.pdf", None, "p1")], "document_id string, insurer_id string, source_url string, local_path string, product_id string")
    docs = docs.withColumns({c: F.lit(None).cast("string") for c in ("page_url", "anchor_text", "discovery_method", "extension", "document_type")})
    insurers, products = spark.createDataFrame([("i1", "One")], "insurer_id string, name string"), spark.createDataFrame([("p1", "P")], "product_id string, name string")
    pending = jobs.pending_downloads(docs, insurers, products, found.select(F.col("path").alias("local_path")))
    assert [(r.document_id, r.product_name) for r in pending.collect()] == [("D 2", "P")]
    assert plan(pending).split("== Initial Plan ==")[-1].count("BroadcastHashJoin") <= 1  # insurers


@pytest.mark.parametrize("bad", ["../out", "/etc/x", "a/../../b", "", None])
def test_paths_stay_below_the_folder(spark, tmp_path, bad):
    rows = spark.createDataFrame([("fine", b"1"), (bad, b"2")], "path string, content binary").repartition(2)
    with pytest.raises(Exception, match="not a path below"):
        write_documents(rows, f"file://{tmp_path}/docs")
    assert below(tmp_path) == []


def test_a_job_that_fails_leaves_no_file(spark, tmp_path):
    rows = spark.range(200, numPartitions=8).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("path"), F.when(F.col("id") == 150, F.raise_error(F.lit("lost")).cast("string")).otherwise("x").cast("binary").alias("content"))
    with pytest.raises(Exception, match="lost"):
        write_documents(rows, f"file://{tmp_path}/docs")
    assert below(tmp_path) == []


def test_download_tries_again_and_keeps_the_rest(spark, tmp_path):
    calls = tmp_path / "calls"

    def get(url):
        with calls.open("a") as f:
            f.write(url + "\n")
        asked = calls.read_text().split().count(url)
        if "never" in url or ("later" in url and asked < 2):
            raise TimeoutError(url)
        return 200, "application/pdf", f"body of {url}".encode()

    names = ["a.pdf", "later-b.pdf", "never-c.pdf", "d.zip"]
    docs = spark.createDataFrame([(f"D {n}", "i1", f"https://h/{n}") for n in names] + [("no address", "i1", "")], "document_id string, insurer_id string, source_url string")
    docs = docs.withColumns({c: F.lit(None).cast("string") for c in ("product_id", "local_path", "page_url", "anchor_text", "discovery_method", "extension", "document_type")})
    insurers = spark.createDataFrame([("i1", "One")], "insurer_id string, name string")
    products = spark.createDataFrame([], "product_id string, name string")
    settings = jobs.Download(f"file://{tmp_path}/docs", f"file://{tmp_path}/queue", Throttle(2, 0, 0), retries=1)
    answers = jobs.live_answers(settings, get, f"file://{tmp_path}/journal")
    done = jobs.download(spark, settings, docs, insurers, products, answers, {".pdf": lambda c: c.decode()})
    stored = {r.document_id: r for r in done.documents.collect()}
    assert {d: r["round"] for d, r in stored.items()} == {"D a.pdf": 0, "D later-b.pdf": 1}
    for r in stored.values():
        body = f"body of {r.source_url}"
        assert (r.extracted_text, r.content_hash, r.insurer_name) == (body, sha256(body.encode()).hexdigest(), "One")
        assert Path(r.local_path.removeprefix("file://")).read_text() == body
    assert sorted(calls.read_text().split()) == sorted([f"https://h/{n}" for n in ("a.pdf", *2 * ("later-b.pdf", "never-c.pdf", "d.zip"))])
    left = {r.document_id for r in files.read_queue(spark, settings.queue).collect()}
    assert left == {"D never-c.pdf", "D d.zip"} == {r.document_id for r in done.left.collect()}
    # The next run takes the queue, not the table.
    again = jobs.download(spark, settings, docs, insurers, products, lambda rows, n: rows.withColumn("content", F.lit(b"late")), {})
    assert [r.document_id for r in again.documents.collect()] == ["D never-c.pdf"] and [r.document_id for r in again.left.collect()] == ["D d.zip"]
    listing = stored_documents(spark, settings.folder).select(F.concat(F.lit(settings.folder + "/"), "path").alias("local_path"))
    every = done.documents.unionByName(again.documents).select("document_id", "local_path")
    pending = jobs.pending_downloads(docs.drop("local_path").join(every, "document_id", "left"), insurers, products, listing)
    assert [r.document_id for r in pending.collect()] == ["D d.zip"]


def test_nothing_to_download(spark, tmp_path):
    docs = spark.createDataFrame([], "document_id string, insurer_id string, source_url string, product_id string, local_path string, page_url string, anchor_text string, discovery_method string, extension string, document_type string")
    names = spark.createDataFrame([], "insurer_id string, product_id string, name string")
    settings = jobs.Download(f"file://{tmp_path}/docs", f"file://{tmp_path}/queue", retries=0)
    done = jobs.download(spark, settings, docs, names, names, None, {})
    assert done.documents.count() == done.left.count() == files.read_queue(spark, settings.queue).count() == 0


@pytest.mark.parametrize("n", [0, 1, 500])
def test_envelope_parts_are_one_document(spark, tmp_path, n):
    rows = [(f"i{k % 7}", f"d{k:04}", None if k % 5 else 'a "b",\n[x') for k in range(n)]
    df = spark.createDataFrame(rows, "insurer_id string, document_id string, product_id string")
    files.write_envelope(df, str(tmp_path / "q"), "2024-05-06", "documents", ["insurer_id", "document_id"])
    whole = json.loads("".join(p.read_text() for p in sorted((tmp_path / "q").glob("part-*"))))
    assert (whole["generated_at"], whole["record_count"]) == ("2024-05-06", n)
    assert whole["documents"] == [{k: v for k, v in zip(df.columns, r, strict=True) if v is not None} for r in sorted(rows)]
    (tmp_path / "one.json").write_text(json.dumps(whole))
    read = lambda path: sorted(map(tuple, files.read_queue(spark, str(path)).collect()), key=repr)
    assert read(tmp_path / "q") == read(tmp_path / "one.json") and len(read(tmp_path / "q")) == n


def test_reprocessing_moves_no_bytes_and_sorts_nothing(spark):
    docs = spark.range(50).selectExpr("concat('d', id) AS document_id", "'i' AS insurer_id", "cast(null as string) AS product_id", "concat('f', id, '.pdf') AS local_path", "'' AS extracted_text", "cast(id as string) AS updated_at", "'x' AS content_hash", "'u' AS source_url", "'' AS page_url", "'' AS anchor_text", "'' AS discovery_method", "'.pdf' AS extension", "'brochure' AS document_type")
    chosen = jobs.Reprocess().documents(docs, docs.select("insurer_id", F.lit("n").alias("name")))
    assert "rangepartitioning" not in chosen._jdf.queryExecution().executedPlan().toString().lower()
    assert [r.document_id for r in jobs.newest(docs, 3).collect()] == ["d9", "d8", "d7"]
    contents = spark.range(40).select(F.concat(F.lit("f"), "id", F.lit(".pdf")).alias("path"), F.encode(F.concat(F.lit("text "), "id"), "UTF-8").alias("content"))
    done = jobs.Reprocess().run(docs, docs.select("insurer_id", F.lit("n").alias("name")).distinct(), spark.createDataFrame([], "product_id string, name string, category string"), contents, {".pdf": lambda c: c.decode()})
    assert done.stats.head().asDict() == {"documents_processed": 40, "documents_missing": 10, "documents_skipped": 0, "sections_written": 0}
    assert {(r.document_id, r.extracted_text, r.content_hash) for r in done.documents.collect()} == {(f"d{k}", f"text {k}", sha256(f"text {k}".encode()).hexdigest()) for k in range(40)}
