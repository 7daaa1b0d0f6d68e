"""Crawling, fetching, processing, sinks and stored tables, over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import catalog as K
from tidewater.operators import relational as R
from tidewater.operators.sections import SCHEMAS
from tidewater.operators.sections import policy_sections as sections_of
from tidewater.plans import crawling, ingest, jobs, pipeline
from tidewater.queries.base import Group, table
from tidewater.queries.tables import _ALL_DOCS, _DEFINED, _MATCHED, _TABLES, _categorised, documents, insurers, products, stored_files
from tidewater.queries.texts import SECTIONS_SQL
from tidewater.sources import fetch as H
from tidewater.sources import files as S
from tidewater.sources.documents import stored_documents, write_documents
from tidewater.sources.staging import shared_folder
from tidewater.sources.tables import StoredTable

group = Group()


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# Pages with more links and headings behind their own.

_MORE_LINKS = '<a href="mailto:a@b.in">m</a><a href="/f.PDF?x=1">f</a><a href="https://other.example/x">o</a><a href="javascript:x">j</a><a href="tel:1">t</a><a href="/late#p">p</a><a href="">e</a><a href="/a.zip">z</a>'
_ROOT = "regexp_extract(url, '^[a-z]+://[^/?#]*')"


@group.query(
    f"WITH anchors AS (SELECT page_id, url, unnest(regexp_extract_all(html || '{_MORE_LINKS}', '<a href=\"([^\"]*)\"', 1)) AS href, generate_subscripts(regexp_extract_all(html || '{_MORE_LINKS}', '<a href=\"([^\"]*)\"', 1), 1) - 1 AS pos FROM pages),"
    f" absolute AS (SELECT *, CASE WHEN href LIKE '/%' THEN {_ROOT} || href ELSE href END AS target FROM anchors)"
    f" SELECT url, pos, target FROM absolute WHERE href <> '' AND starts_with(target, {_ROOT} || '/') AND NOT regexp_matches(lower(regexp_replace(target, '[?#].*', '')), '[.](pdf|doc|docx|xls|xlsx|zip|png|jpg|jpeg|gif|svg|mp4|mp3|avi|mov)$')"
)
def crawl_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = F.regexp_extract("url", "^[a-z]+://[^/?#]*", 0)
    pages = table(spark, sf_dir, "pages").select(root.alias("root"), "url", F.concat("html", F.lit(_MORE_LINKS)).alias("html"))
    return ingest.page_links_of(pages).select("url", "pos", "target")


_SNIPPET = "'<section><h2>Care Plan ' || page_id || ' <a href=\"/plans/' || page_id || '.html\">more</a></h2><p>About ' || page_id || '</p>and on<h3>Sure Cover ' || page_id || '</h3><p>' || repeat('word ', {n}) || '</p><p>tail</p><h4>Note ' || page_id || '</h4></section>'"
_WORDS = "rtrim(repeat('word ', (page_id % 200)::INT))"


@group.query(
    f"SELECT page_id, 'ins-care-plan-' || page_id || '-more' AS product_id, 'Care Plan ' || page_id || ' more' AS name, {_ROOT} || '/plans/' || page_id || '.html' AS product_url, 'About ' || page_id || ' and on' AS description, 'h2' AS level FROM pages"
    f" UNION ALL SELECT page_id, 'ins-sure-cover-' || page_id, 'Sure Cover ' || page_id, url, CASE WHEN page_id % 200 = 0 THEN 'tail' WHEN length({_WORDS}) > 400 THEN left({_WORDS}, 800) ELSE {_WORDS} || ' tail' END, 'h3' FROM pages"
)
def product_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings planted behind each page's own: their ids, addresses and descriptions."""
    snippet = F.expr(_SNIPPET.format(n="cast(page_id % 200 as int)"))
    pages = table(spark, sf_dir, "pages").select(F.lit("ins").alias("insurer_id"), F.col("url").alias("page_url"), F.col("page_id").alias("visit"), F.concat("html", snippet).alias("html"))
    found = ingest.product_candidates(ingest.scanned(pages)).where(F.col("name").rlike("^(Care Plan|Sure Cover) [0-9]"))
    return found.select(F.col("visit").alias("page_id"), "product_id", "name", "product_url", "description", F.col("metadata")["heading_level"].alias("level"))


@group.query(
    "WITH pr AS (SELECT p_brand AS i, p_partkey % 40 AS v, p_partkey AS pos, p_name AS n FROM part WHERE p_partkey % 2 = 0), d AS (SELECT p_partkey AS id, p_brand AS i, p_size % 40 AS v, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'Get THE ' || upper(p_name) || ' or small ring' END AS a FROM part),"
    " own AS (SELECT DISTINCT i, v FROM pr), paged AS (SELECT d.* FROM d JOIN own USING (i, v)), bare AS (SELECT d.* FROM d ANTI JOIN own USING (i, v)),"
    " firsts AS (SELECT i, n, min(v * 1000000000 + pos) AS o FROM pr GROUP BY 1, 2),"
    " hit1 AS (SELECT id, arg_min(n, pos) AS hit FROM paged JOIN pr USING (i, v) WHERE a <> '' AND contains(lower(a), lower(n)) GROUP BY 1), sole1 AS (SELECT i, v, min(n) AS sole FROM pr GROUP BY 1, 2 HAVING count(*) = 1),"
    " seen AS (SELECT id, a, n, o FROM bare JOIN firsts USING (i) WHERE o // 1000000000 <= v), hit2 AS (SELECT id, arg_min(n, o) FILTER (a <> '' AND contains(lower(a), lower(n))) AS hit, CASE WHEN count(*) = 1 THEN min(n) END AS sole FROM seen GROUP BY 1)"
    " SELECT id AS document_id, coalesce(hit, sole) AS product_id FROM paged LEFT JOIN hit1 USING (id) LEFT JOIN sole1 USING (i, v) UNION ALL SELECT id, coalesce(hit, sole) FROM bare LEFT JOIN hit2 USING (id)"
)
def scope_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    page = lambda n: F.concat(F.lit("g"), n.cast("string"))
    visit = F.col("p_partkey") % 40
    known = part.where("p_partkey % 2 = 0").select(F.col("p_brand").alias("insurer_id"), page(visit).alias("page_url"), visit.alias("visit"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("product_id"), F.col("p_name").alias("name"))
    anchor = F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.concat(F.lit("Get THE "), F.upper("p_name"), F.lit(" or small ring")))
    at = F.col("p_size").cast("long") % 40
    docs = part.select(F.col("p_partkey").alias("document_id"), F.col("p_brand").alias("insurer_id"), page(at).alias("page_url"), at.alias("visit"), anchor.alias("anchor_text"))
    return R.match_in_scope(docs, known).select("document_id", "product_id")


_TYPES = ("policy_wording", "brochure", "prospectus")


@group.query(f"WITH {_ALL_DOCS.replace('FROM policies), said', 'FROM policies), kept AS (SELECT * FROM wanted WHERE abs(doc_id) % 3 = 0), said').replace('SELECT doc_id, text FROM wanted)', 'SELECT doc_id, text FROM kept)')}, {_DEFINED}, {SECTIONS_SQL}, {_MATCHED} SELECT doc_id, section_name, content, confidence FROM matched")
def sections_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only wordings, a third of all documents, are cut into sections."""
    kinds = F.element_at(F.array(*map(F.lit, _TYPES)), (F.abs("doc_id") % 3 + 1).cast("int"))
    docs = _categorised(spark, sf_dir).withColumn("document_type", kinds)
    return sections_of(docs, doc_types=("policy_wording",)).select("doc_id", "section_name", "content", "confidence")


# A crawl whose page budget binds: five pages for each root, in the order of a queue.

_QUEUE = """
WITH links AS (SELECT l_suppkey AS url, l_partkey AS pos, l_partkey % (SELECT count(*) FROM supplier) AS target FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)),
l0 AS (SELECT r_regionkey AS root, r_regionkey::BIGINT AS url, 0 AS depth, 0 AS visit FROM region),
l1 AS (SELECT root, url, 1 AS depth, row_number() OVER (PARTITION BY root ORDER BY pos, url) AS visit FROM (SELECT root, target AS url, min(pos) AS pos FROM l0 JOIN links USING (url) WHERE target <> root GROUP BY 1, 2) QUALIFY visit < {budget}),
n1 AS (SELECT root, count(*) AS n FROM (SELECT root FROM l0 UNION ALL SELECT root FROM l1) GROUP BY 1),
l2 AS (SELECT root, url, 2 AS depth, n + row_number() OVER (PARTITION BY root ORDER BY o, url) - 1 AS visit FROM
  (SELECT l1.root, target AS url, min((visit, pos)) AS o FROM l1 JOIN links USING (url) WHERE NOT EXISTS (FROM l0 z WHERE z.root = l1.root AND z.url = target) AND NOT EXISTS (FROM l1 z WHERE z.root = l1.root AND z.url = target) GROUP BY 1, 2) JOIN n1 USING (root) QUALIFY visit < {budget})
SELECT root, url, depth, visit FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2
"""


def _budgeted(spark: SparkSession, sf_dir: str, budget: int) -> DataFrame:
    suppliers = F.broadcast(table(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("n")))
    links = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct().join(suppliers)
    links = links.select(F.col("l_suppkey").alias("url"), (F.col("l_partkey") % F.col("n")).alias("target"), F.col("l_partkey").alias("pos"))
    roots = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("root"), F.col("r_regionkey").cast("long").alias("url"))
    return R.crawl(roots, links, max_depth=2, max_pages=budget).select("root", "url", "depth", "visit")


@group.query(_QUEUE.format(budget=5))
def crawl_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _budgeted(spark, sf_dir, 5)


@group.query(_QUEUE.format(budget=500))
def crawl_budget_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A budget that binds, if at all, on the second level."""
    return _budgeted(spark, sf_dir, 500)


# A crawl that fetches: the pages are the web, five sites of them, with links behind their own (which lead nowhere).

_BUDGET = 30
_PLANTED = ("'<a href=\"/p/' || (page_id + 5) || '\">n</a>'", "'<a href=\"' || (page_id * 6) || '\">s</a>'", "'<a href=\"../p/./' || (page_id + 5 * (page_id % 7 + 2)) || '\">f</a>'")


def _level(k: int) -> str:
    return (
        f"l{k} AS (SELECT s, p, {k} AS depth, before + row_number() OVER (PARTITION BY s ORDER BY o) - 1 AS visit FROM"
        f" (SELECT x.s, t AS p, min(10 * visit + pos) AS o, any_value((SELECT count(*) FROM v{k - 1} z WHERE z.s = x.s)) AS before FROM l{k - 1} x JOIN links USING (p) WHERE t NOT IN (SELECT p FROM v{k - 1}) GROUP BY 1, 2)"
        f" QUALIFY visit < {_BUDGET}), v{k} AS (FROM v{k - 1} UNION ALL FROM l{k})"
    )


@group.query(
    "WITH web AS (SELECT page_id AS p, page_id % 5 AS s, len(regexp_extract_all(html, '<a href=\"[^\"]*\"')) + 3 AS n_links FROM pages),"
    " links AS (SELECT p, pos, t FROM (SELECT p, 0 AS pos, p + 5 AS t FROM web UNION ALL SELECT p, 1, p * 6 FROM web UNION ALL SELECT p, 2, p + 5 * (p % 7 + 2) FROM web) WHERE t IN (SELECT p FROM web)),"
    f" l0 AS (SELECT s, p, 0 AS depth, 0::BIGINT AS visit FROM web WHERE p < 5), v0 AS (FROM l0), {', '.join(map(_level, (1, 2, 3)))}"
    " SELECT 'https://s' || s || '.example/p/' || s AS root, 'https://s' || s || '.example/p/' || p AS url, depth, visit, n_links FROM v3 JOIN web USING (s, p)"
)
def crawl_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level by level within the budget; a request that brings no page costs nothing of it."""
    address = lambda n: F.concat(F.lit("https://s"), (n % 5).cast("string"), F.lit(".example/p/"), n.cast("string"))
    pages = table(spark, sf_dir, "pages")
    web = pages.select(address(F.col("page_id")).alias("url"), F.concat("html", F.expr(" || ".join(_PLANTED))).alias("html"))
    roots = pages.where("page_id < 5").select(address(F.col("page_id")).alias("root"), address(F.col("page_id")).alias("url"))
    found = crawling.crawl_sites(roots, crawling.stored_web(web), max_depth=3, max_pages=_BUDGET)
    return found.visits.select("root", "url", "depth", "visit", F.size("links").cast("long").alias("n_links"))


# The whole ingestion: suppliers are the regulator's table, and pages, with a product and its wording behind their own text, the web.

_OFFER = "'<h2>Care Plan ' || page_id || '</h2><p>About it</p><a class=\"download\" href=\"/docs/care-' || page_id || '-policy-wording.pdf\">Policy wording of CARE PLAN ' || page_id || '</a>'"
_SOURCE = ingest.Source("general", "https://regulator.example/list", "insurers", {"Insurer": "insurer_name", "Website": "website"})


@group.query(
    "WITH visited AS (SELECT DISTINCT s, p FROM (SELECT page_id AS s, unnest([page_id, page_id + 5, page_id * 6, page_id + 5 * (page_id % 7 + 2)]) AS p FROM pages WHERE page_id < 5) WHERE p IN (SELECT page_id FROM pages) AND s + 1 IN (SELECT s_suppkey FROM supplier)),"
    " named AS (SELECT p, 'general-' || lower(replace(s_name, '#', '')) AS insurer_id, 'https://s' || s || '.example/docs/care-' || p || '-policy-wording.pdf' AS source_url FROM visited JOIN supplier ON s_suppkey = s + 1)"
    " SELECT insurer_id || '-care-' || p || '-policy-wording-policy_wording' AS document_id, insurer_id || '-care-plan-' || p AS product_id, source_url, CASE WHEN p % 4 <> 3 THEN sha256('ELIGIBILITY' || chr(10) || source_url) END AS content_hash,"
    " CASE WHEN p % 4 <> 3 THEN source_url END AS eligibility, p % 4 = 3 AS pending FROM named"
)
def ingest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stored tables and the queue hold after a run and the same run again; every fourth document has no answer."""
    address = lambda n: F.concat(F.lit("https://s"), (n % 5).cast("string"), F.lit(".example/p/"), n.cast("string"))
    pages = table(spark, sf_dir, "pages")
    web = pages.select(address(F.col("page_id")).alias("url"), F.concat("html", F.expr(" || ".join([*_PLANTED, _OFFER]))).alias("html"))
    site = F.when(F.col("s_suppkey") <= 5, F.concat(F.lit("https://s"), (F.col("s_suppkey") - 1).cast("string"), F.lit(".example/p/"), (F.col("s_suppkey") - 1).cast("string"))).otherwise("")
    listed = table(spark, sf_dir, "supplier").select(F.struct("s_suppkey", F.concat(F.lit("<tr><td>"), "s_name", F.lit("</td><td>"), site, F.lit("</td></tr>")).alias("row")).alias("x"))
    # The regulator's list is one page.
    rows = listed.agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["row"]), "").alias("rows"))
    regulator = rows.select(F.lit(_SOURCE.url).alias("url"), F.concat(F.lit("<table id='insurers'><thead><tr><th>Insurer</th><th>Website</th></tr></thead><tbody>"), "rows", F.lit("</tbody></table>")).alias("html"))
    content = F.when(F.regexp_extract("source_url", "care-([0-9]+)-", 1).cast("long") % 4 != 3, F.encode(F.concat(F.lit("ELIGIBILITY\n"), "source_url"), "UTF-8"))
    folder = _place(spark, "ingested")
    limits = ingest.Limits(max_depth=1, documents_dir=folder + "-files", schemas={"other": SCHEMAS["health"]} | SCHEMAS)
    for stamp in ("2024-01-01", "2024-01-02"):
        done = pipeline.run(spark, regulator, crawling.stored_web(web), folder, stamp, limits, lambda docs: docs.withColumn("content", content), {".pdf": lambda body: body.decode()}, (_SOURCE,))
    files = stored_documents(spark, limits.documents_dir).select(F.concat(F.lit(limits.documents_dir + "/"), "path").alias("local_path"), F.sha2("content", 256).alias("stored_hash"))
    left = S.read_queue(spark, f"{folder}/document_download_queue.json").select("document_id", F.lit(True).alias("left"))
    eligible = done.sections.where("section_name = 'Eligibility'").select(F.col("source_document_id").alias("document_id"), F.col("section_body").alias("eligibility"))
    mine = done.documents.where(F.col("source_url").contains("/docs/care-")).join(files, "local_path", "left").join(left, "document_id", "left").join(eligible, "document_id", "left")
    return mine.select("document_id", "product_id", "source_url", F.col("stored_hash").alias("content_hash"), "eligibility", F.coalesce("left", F.lit(False)).alias("pending"))


# Fetching: pages are stored as files, four of five, and asked for by their addresses there.

_MOST = 14_000


@group.query(
    f"SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'URLError' WHEN size > {_MOST} THEN 'too large' END AS error, CASE WHEN page_id % 5 <> 0 AND size <= {_MOST} THEN sha256(html) END AS content_hash,"
    f" CASE WHEN page_id % 5 NOT IN (0, 2) AND size <= {_MOST} THEN html END AS html FROM (SELECT *, octet_length(encode(html)) AS size FROM pages)"
)
def fetched_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _place(spark, "web")
    name = F.concat(F.lit("p"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 5 == 2, ".pdf").otherwise(".html"))
    pages = table(spark, sf_dir, "pages").select("page_id", name.alias("path"), F.encode("html", "UTF-8").alias("content"))
    write_documents(pages.where("page_id % 5 <> 0"), folder)
    requests = pages.select("page_id", F.concat(F.lit((folder if "://" in folder else f"file://{folder}") + "/"), "path").alias("url"), (F.col("page_id") % 7).alias("host"))
    answers = H.fetch(requests, group="host", throttle=H.Throttle(4, 0, 0), most=_MOST)
    return answers.select("page_id", F.regexp_extract("error", "^[A-Za-z ]+", 0).alias("error"), F.sha2("content", 256).alias("content_hash"), H.html_of().alias("html"))


_LIMIT = 3000


def _as_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a folder."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    return rows.select("doc_id", F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.octet_length("content").cast("long").alias("length"), "content")


@group.query(f"SELECT 'docs/' || doc_id || '.txt' AS path, sha256(text) AS content_hash FROM documents WHERE octet_length(encode(text)) <= {_LIMIT}")
def size_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.within_size(_as_files(spark, sf_dir), _LIMIT).select("path", F.sha2("content", 256).alias("content_hash"))


_SAID_TEXT = {".pdf": lambda content: "text: " + content.decode()}
_KINDS = ("https://h/a.pdf", "//h/b.DOCX", "https://h/c.zip", "", "https://h/get?f=d.pdf&x=1")
_KIND_SQL = "['" + "', '".join(_KINDS) + "'][doc_id % 5 + 1]"
_EXT_SQL = "['.pdf', '.docx', '.zip', NULL, '.pdf'][doc_id % 5 + 1]"


def _to_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    address = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("doc_id") % 5 + 1).cast("int"))
    old = {"local_path": F.lit("old"), "content_hash": F.lit(None).cast("string"), "extracted_text": F.lit("old text")}
    return _as_files(spark, sf_dir).select(F.concat(F.lit("D "), F.col("doc_id").cast("string")).alias("document_id"), F.lit("i").alias("insurer_id"), address.alias("source_url"), F.when(F.col("doc_id") % 7 != 0, F.col("content")).alias("content"), *[c.alias(n) for n, c in old.items()])


_PROCESSED = f"""
WITH d AS (SELECT *, 'D ' || doc_id AS document_id, {_EXT_SQL} AS extension, octet_length(encode(text)) AS size FROM documents),
k AS (SELECT *, extension IN ('.pdf', '.docx') AND doc_id % 7 <> 0 AND size BETWEEN 1 AND {_LIMIT} AS taken FROM d)
SELECT document_id, extension, CASE extension WHEN '.pdf' THEN 'application/pdf' WHEN '.docx' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' WHEN '.zip' THEN '' END AS content_type,
"""


@group.query(_PROCESSED + "CASE WHEN taken THEN 'data/documents/i/d-' || doc_id || extension ELSE 'old' END AS local_path, CASE WHEN taken THEN sha256(text) END AS content_hash, CASE WHEN NOT coalesce(taken, false) THEN 'old text' WHEN extension = '.pdf' THEN regexp_replace('text: ' || text, '[\\x{0900}-\\x{097F}]+', '', 'g') ELSE '' END AS extracted_text FROM k")
def process_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PDF text comes from a stand-in for the extractor."""
    docs = _to_process(spark, sf_dir)
    done = jobs.process_documents(docs.drop("content"), docs.select("document_id", "content"), _SAID_TEXT, max_bytes=_LIMIT)
    return done.select("document_id", "extension", "content_type", "local_path", "content_hash", "extracted_text")


@group.query(_PROCESSED + "CASE WHEN extension IN ('.pdf', '.docx') THEN NULL ELSE 'old' END AS local_path, CASE WHEN extension IN ('.pdf', '.docx') THEN '' ELSE 'old text' END AS extracted_text FROM k")
def process_without_download(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = jobs.process_documents(_to_process(spark, sf_dir).drop("content"), None)
    return done.select("document_id", "extension", "content_type", "local_path", "extracted_text")


_POLICY = {".pdf": lambda content: "Eligibility\n" + content.decode() + " is for adults only, of any kind of work."}
_CHOSEN = f"{_TABLES}, chosen AS (SELECT d.*, CASE WHEN extension = '.zip' THEN replace(local_path, '.pdf', '.zip') ELSE local_path END AS place, local_path IN (SELECT local_path FROM files) AS found FROM docs d WHERE insurer_id IN (SELECT insurer_id FROM insurers WHERE contains(insurer_id, '7')) AND coalesce(extracted_text, '') = '')"


def _reprocessed(spark: SparkSession, sf_dir: str) -> jobs.Reprocessed:
    zipped = lambda c: F.replace(F.col(c), F.lit(".pdf"), F.lit(".zip"))
    docs = documents(spark, sf_dir).withColumn("local_path", F.when(F.col("extension") == ".zip", zipped("local_path")).otherwise(F.col("local_path")))
    paths = stored_files(spark, sf_dir).distinct()
    files = paths.unionByName(paths.select(zipped("local_path").alias("local_path"))).select(F.col("local_path").alias("path"), F.encode("local_path", "UTF-8").alias("content"))
    known = products(spark, sf_dir).withColumn("category", F.when(F.col("product_id") % 2 == 0, "health").otherwise("motor"))
    return jobs.Reprocess(("7",), only_missing_text=True).run(docs, insurers(spark, sf_dir), known, files, _POLICY)


@group.query(
    f"{_CHOSEN} SELECT count(*) FILTER (found AND extension <> '.zip') AS documents_processed, count(*) FILTER (NOT found) AS documents_missing, count(*) FILTER (found AND extension = '.zip') AS documents_skipped,"
    f" coalesce(sum(CASE WHEN p_partkey % 2 = 0 THEN {len(SCHEMAS['health'])} ELSE {len(SCHEMAS['motor'])} END) FILTER (found AND extension <> '.zip' AND p_partkey IS NOT NULL), 0)::BIGINT AS sections_written FROM chosen LEFT JOIN part ON product_id = p_partkey::VARCHAR"
)
def reprocess_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reprocessed(spark, sf_dir).stats


@group.query(f"{_CHOSEN} SELECT document_id, sha256(place) AS content_hash, 'Eligibility' || chr(10) || place || ' is for adults only, of any kind of work.' AS extracted_text FROM chosen WHERE found AND extension <> '.zip'")
def reprocess_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reprocessed(spark, sf_dir).documents.select("document_id", "content_hash", "extracted_text")


@group.query(f"{_CHOSEN} SELECT document_id, coalesce(source_url, '') AS source_url, extension FROM chosen WHERE NOT found")
def reprocess_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reprocessed(spark, sf_dir).pending.select("document_id", "source_url", "extension")


# Downloads: what is pending is fetched, stored as files, tried again, and what still fails is the queue.

_ENDS = "['.pdf', '.docx', '.zip', '.doc'][doc_id % 4 + 1]"


@group.query(
    f"WITH d AS (SELECT *, 'D ' || doc_id AS document_id, {_ENDS} AS ext, CASE WHEN doc_id % 11 <> 0 THEN 0 WHEN doc_id % 22 = 0 THEN 1 ELSE 9 END AS round FROM documents), k AS (SELECT *, ext <> '.zip' AND round < 2 AND coalesce(text, '') <> '' AS ok FROM d)"
    " SELECT document_id, CASE WHEN ok THEN 'stored' ELSE 'left' END AS state, CASE WHEN ok THEN round END AS round, CASE WHEN ok THEN 'i' || doc_id % 7 || '/d-' || doc_id || ext END AS path, CASE WHEN ok THEN sha256(text) END AS content_hash FROM k"
)
def download_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, of which every eleventh has no answer at first, as files: hashed again as they lie in the folder, with the queue that is left, and nothing else pending."""
    ends = F.element_at(F.array(*map(F.lit, (".pdf", ".docx", ".zip", ".doc"))), (F.col("doc_id") % 4 + 1).cast("int"))
    texts = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("https://h/"), F.col("doc_id").cast("string"), ends).alias("source_url"), F.encode("text", "UTF-8").alias("content"))
    blank = {c: F.lit(None).cast("string") for c in ("product_id", "local_path", "page_url", "anchor_text", "discovery_method", "extension", "document_type")}
    docs = texts.select(F.concat(F.lit("D "), F.col("doc_id").cast("string")).alias("document_id"), F.concat(F.lit("i"), (F.col("doc_id") % 7).cast("string")).alias("insurer_id"), "source_url").withColumns(blank)
    since = F.when(F.col("doc_id") % 11 != 0, 0).when(F.col("doc_id") % 22 == 0, 1).otherwise(9)
    answers = lambda left, n: left.join(texts.where(since <= n).select("source_url", "content"), "source_url", "left").select(*left.columns, "content")
    folder = _place(spark, "files")
    settings = jobs.Download(folder, folder + "-queue", retries=1)
    done = jobs.download(spark, settings, docs, insurers(spark, sf_dir), products(spark, sf_dir), answers, {})
    there = stored_documents(spark, folder).select(F.concat(F.lit(folder + "/"), "path").alias("local_path"), "path", F.sha2("content", 256).alias("content_hash"))
    stored = done.documents.select("document_id", "local_path", "round").join(there, "local_path").select("document_id", F.lit("stored").alias("state"), "round", "path", "content_hash")
    left = S.read_queue(spark, settings.queue)
    now = docs.drop("local_path").join(done.documents.select("document_id", "local_path"), "document_id", "left")
    again = jobs.pending_downloads(now, insurers(spark, sf_dir), products(spark, sf_dir), there).join(left.select("document_id").hint("merge"), "document_id", "left_anti")
    nothing = [F.lit(None).cast("int").alias("round"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("content_hash")]
    return stored.unionByName(left.select("document_id", F.lit("left").alias("state"), *nothing)).unionByName(again.select("document_id", F.lit("pending").alias("state"), *nothing))


@group.query("SELECT l_orderkey, l_linenumber, l_partkey, 'say \"' || l_shipdate::DATE || '\", [' || chr(10) || ']}' AS said FROM lineitem")
def envelope_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All line items as one JSON document in parts, and back."""
    said = F.concat(F.lit('say "'), F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit('", [\n]}'))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", said.alias("said"))
    path = _place(spark, "envelope")
    S.write_envelope(rows, path, "2024-01-01T00:00:00+00:00", "lines", ["l_orderkey", "l_linenumber"])
    return S.read_envelope(spark, path, rows.schema)


# Jobs: a queue file, or the table where there is none; groups, and back.

_QUEUED = "SELECT o_orderkey::VARCHAR AS document_id, o_custkey::VARCHAR AS insurer_id, 'queue' AS origin FROM orders UNION ALL SELECT l_orderkey || '-' || l_linenumber, (l_suppkey + l_linenumber % 2 * 1000000)::VARCHAR, 'table' FROM lineitem"


@group.query(_QUEUED)
def job_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = documents(spark, sf_dir)
    entries = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("document_id"), F.col("o_custkey").cast("string").alias("insurer_id"))
    path = _place(spark, "queue")
    S.write_envelope(entries, path, "2024-01-01T00:00:00+00:00", "documents", ["insurer_id", "document_id"])
    from_queue = jobs.job_source(spark, path, stored).select("document_id", "insurer_id", F.lit("queue").alias("origin"))
    return from_queue.unionByName(jobs.job_source(spark, path + "-none", stored).select("document_id", "insurer_id", F.lit("table").alias("origin")))


@group.query("SELECT o_custkey AS insurer_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey::VARCHAR) - 1 AS pos, o_orderkey::VARCHAR AS document_id FROM orders")
def flatten_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("insurer_id"), F.col("o_orderkey").cast("string").alias("document_id"))
    return jobs.flattened(jobs.jobs_by_insurer(rows))


# Sinks, written and read again; stored tables; deletions.


@group.query("SELECT s_suppkey::VARCHAR AS a_key, s_name AS name, CASE WHEN s_suppkey % 3 <> 0 THEN 'say \"' || s_name || '\", twice' || chr(10) || 'or more' END AS said FROM supplier")
def csv_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("s_suppkey") % 3 != 0, F.concat(F.lit('say "'), "s_name", F.lit('", twice\nor more')))
    path = _place(spark, "csv")
    S.write_csv(table(spark, sf_dir, "supplier").select(said.alias("said"), F.col("s_name").alias("name"), F.col("s_suppkey").cast("string").alias("a_key")), path)
    return S.read_csv(spark, path, "a_key string, name string, said string")


@group.query("SELECT doc_id, text, lang FROM documents")
def json_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark, "json")
    S.write_json(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), path, "lang")
    return spark.read.schema("doc_id long, text string, lang string").json(path)


@group.query("SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'new ' || p_name ELSE p_name END AS p_name FROM part WHERE p_partkey % 10 <> 1")
def table_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table is replaced, then each bucket that a change touches is rewritten."""
    stored = StoredTable(_place(spark, "table"), ("p_partkey",), 8)
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    stored.replace(part)
    changed = part.where("p_partkey % 10 < 2")
    touched = [r[0] for r in changed.select(stored.bucket()).distinct().collect()]  # 8 numbers at most
    now = stored.read(spark, touched).where("p_partkey % 10 <> 1")
    stored.rewrite(now.withColumn("p_name", F.when(F.col("p_partkey") % 10 == 0, F.concat(F.lit("new "), "p_name")).otherwise(F.col("p_name"))), touched)
    return stored.read(spark)


@group.query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IS NULL OR l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 5)")
def fk_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "part").where("p_size <= 5")
    return R.without_parents(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), gone, "l_partkey", "p_partkey").select("l_orderkey", "l_linenumber", "l_partkey")


@group.query("SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 5) THEN l_partkey END AS l_partkey FROM lineitem")
def fk_set_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "part").where("p_size <= 5")
    return R.parents_set_null(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), gone, "l_partkey", "p_partkey")


# The catalogue: a small one in memory, pages and query strings.

@group.query(
    "SELECT r_regionkey AS ordinal, r_regionkey::VARCHAR AS id, r_name AS label, count(n_nationkey) AS n, coalesce(string_agg(n_name, ',' ORDER BY n_nationkey), '') AS names, max(n_regionkey + 0.5)::DOUBLE AS insurer_rating"
    " FROM region LEFT JOIN nation ON n_regionkey = r_regionkey AND n_nationkey % 4 <> 0 GROUP BY 1, 2, 3"
)
def memory_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that a program holds in memory, here the 5 regions and 25 nations, as tables of the catalogue."""
    regions = table(spark, sf_dir, "region").orderBy("r_regionkey").collect()
    nations = table(spark, sf_dir, "nation").where("n_nationkey % 4 <> 0").orderBy("n_nationkey").collect()
    categories = K.in_memory(spark, [{"id": str(r.r_regionkey), "label": r.r_name, "icon": "i"} for r in regions], K.CATEGORIES)
    makers = K.in_memory(spark, [{"id": str(r.r_regionkey), "name": f"Maker {r.r_regionkey}", "rating": r.r_regionkey + 0.5} for r in regions], K.INSURERS).select(F.col("name").alias("insurer"), F.col("rating").alias("r"))
    rows = K.in_memory(spark, [{"id": str(n.n_nationkey), "name": n.n_name, "insurer": f"Maker {n.n_regionkey}", "categoryId": str(n.n_regionkey)} for n in nations], K.PRODUCTS)
    counts = K.category_counts(categories.drop("productCount"), rows)
    named = rows.join(makers, "insurer").groupBy(F.col("categoryId").alias("id")).agg(F.array_sort(F.collect_list(F.struct("ordinal", "name"))).alias("x"), F.max("r").alias("insurer_rating"))
    joined = counts.join(named, "id", "left")
    return joined.select("ordinal", "id", "label", F.col("productCount").alias("n"), F.coalesce(F.array_join(F.transform("x", lambda y: y["name"]), ","), F.lit("")).alias("names"), "insurer_rating")


@group.query("SELECT o_orderkey, greatest(1, least(o_orderkey % 50 - 5, ceil((o_custkey % 200) / 8)))::BIGINT AS page FROM orders")
def page_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", K.clamped_page(F.col("o_orderkey") % 50 - 5, F.col("o_custkey") % 200).alias("page"))


@group.query(
    "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 AND p_size % 2 = 1 THEN '' ELSE '?' || concat_ws('&', CASE WHEN p_partkey % 4 <> 0 THEN 'search=' || replace(p_name, ' ', '+') END, CASE WHEN p_size % 2 = 0 THEN 'tags=' || replace(p_name, ' ', '&tags=') || '&tags=a%26b' END, CASE WHEN p_partkey % 4 <> 0 THEN 'page=' || p_size END) END AS query FROM part"
)
def query_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda when, value: F.when(when, F.array(value))
    some = F.col("p_partkey") % 4 != 0
    tags = F.when(F.col("p_size") % 2 == 0, F.array_append(F.split("p_name", " "), F.lit("a&b")))
    return table(spark, sf_dir, "part").select("p_partkey", K.query_string({"search": one(some, F.col("p_name")), "tags": tags, "page": one(some, F.col("p_size"))}).alias("query"))
