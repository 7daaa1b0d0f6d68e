"""Joins, merges, upserts, jobs, catalogue and file operators over the star-schema tables.

Suppliers stand in for insurers, parts for products, line items for documents, events for
versions and searches.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import catalog as K
from tidewater.operators import relational as R
from tidewater.operators.sections import SCHEMAS
from tidewater.operators.sections import match_sections as match
from tidewater.operators.sections import policy_sections as sections_of
from tidewater.operators.sections import split_sections as split
from tidewater.operators.sections import supported_categories as supported
from tidewater.plans import ingest, jobs
from tidewater.queries.base import Group, table
from tidewater.queries.texts import POLICY_SQL, SECTIONS_SQL, policies, sql_text
from tidewater.sources import files as S
from tidewater.sources.staging import shared_folder

group = Group()

# Insurers, products, documents and files, and the same for DuckDB.


def insurers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("insurer_id"), F.col("s_name").alias("name"))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("product_id"), F.col("p_name").alias("name"))


_KIND = "CASE l_returnflag WHEN 'A' THEN 'policy_wording' WHEN 'R' THEN 'brochure' ELSE 'prospectus' END"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "cast(l_suppkey + l_linenumber % 2 * 1000000 as string) AS insurer_id",
        "CASE l_linenumber % 4 WHEN 0 THEN '' WHEN 1 THEN cast(null as string) ELSE cast(l_partkey as string) END AS product_id",
        "concat_ws('-', l_orderkey, l_linenumber) AS document_id",
        f"{_KIND} AS document_type",
        "if(l_linenumber = 7, '', concat('https://h/', l_orderkey)) AS source_url",
        "concat('files/', l_orderkey, '-', l_partkey, '.pdf') AS local_path",
        "l_linestatus AS anchor_text",
        "concat('https://h/p', l_suppkey) AS page_url",
        "'crawl' AS discovery_method",
        "element_at(array('.pdf', '.doc', '.zip', ''), cast(l_linenumber % 4 + 1 as int)) AS extension",
        "CASE l_linenumber % 3 WHEN 0 THEN cast(null as string) WHEN 1 THEN '' ELSE l_returnflag END AS extracted_text",
        "cast(l_shipdate as string) AS updated_at",
    )


def stored_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where("l_quantity > 25").selectExpr("concat('files/', l_orderkey, '-', l_partkey, '.pdf') AS local_path")


_TABLES = f"""WITH insurers AS (SELECT s_suppkey::VARCHAR AS insurer_id, s_name AS name FROM supplier), products AS (SELECT p_partkey::VARCHAR AS product_id, p_name AS name FROM part),
docs AS (SELECT (l_suppkey + l_linenumber % 2 * 1000000)::VARCHAR AS insurer_id, CASE l_linenumber % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE l_partkey::VARCHAR END AS product_id, l_orderkey || '-' || l_linenumber AS document_id,
  {_KIND} AS document_type, CASE WHEN l_linenumber = 7 THEN '' ELSE 'https://h/' || l_orderkey END AS source_url, 'files/' || l_orderkey || '-' || l_partkey || '.pdf' AS local_path, l_linestatus AS anchor_text,
  'https://h/p' || l_suppkey AS page_url, 'crawl' AS discovery_method, ['.pdf', '.doc', '.zip', ''][l_linenumber % 4 + 1] AS extension, CASE l_linenumber % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE l_returnflag END AS extracted_text,
  strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS updated_at FROM lineitem),
files AS (SELECT DISTINCT 'files/' || l_orderkey || '-' || l_partkey || '.pdf' AS local_path FROM lineitem WHERE l_quantity > 25)"""
_NAMED = "coalesce(i.name, '') AS insurer_name, coalesce(d.product_id, '') AS product_id, coalesce(p.name, '') AS product_name"
_JOINED = "FROM docs d LEFT JOIN insurers i USING (insurer_id) LEFT JOIN products p ON p.product_id = d.product_id"
_MAPPED = f"SELECT d.insurer_id, {_NAMED}, document_id, document_type, source_url, local_path, anchor_text, page_url AS discovered_from_url, discovery_method {_JOINED}"


@group.query(f"{_TABLES} SELECT d.insurer_id, i.name AS insurer_name, d.product_id, p.name AS product_name, document_id, document_type, source_url FROM docs d JOIN insurers i USING (insurer_id) LEFT JOIN products p ON p.product_id = d.product_id")
def download_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jobs.download_jobs(documents(spark, sf_dir), insurers(spark, sf_dir), products(spark, sf_dir))
    return found.select("insurer_id", "insurer_name", "product_id", "product_name", "document_id", "document_type", "source_url")


@group.query(f"{_TABLES} {_MAPPED} WHERE document_type IN ('policy_wording', 'brochure') AND coalesce(d.product_id, '') <> ''")
def document_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.document_mappings(documents(spark, sf_dir), insurers(spark, sf_dir), products(spark, sf_dir))


@group.query(f"{_TABLES} {_MAPPED}")
def document_mappings_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.document_mappings(documents(spark, sf_dir), insurers(spark, sf_dir), products(spark, sf_dir), every=True)


@group.query(f"{_TABLES} SELECT d.insurer_id, {_NAMED}, document_id, document_type, source_url, page_url, anchor_text, discovery_method, extension {_JOINED} WHERE source_url <> '' AND local_path NOT IN (SELECT local_path FROM files)")
def pending_downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.pending_downloads(documents(spark, sf_dir), insurers(spark, sf_dir), products(spark, sf_dir), stored_files(spark, sf_dir))


@group.query(
    "WITH products AS (SELECT DISTINCT p_brand AS insurer_id, p_type AS page_url, p_name AS name, min(p_partkey) AS pos FROM part GROUP BY ALL), docs AS (SELECT p_partkey AS document_id, p_brand AS insurer_id, p_type AS page_url, CASE WHEN p_size % 3 = 0 THEN '' ELSE 'Get THE ' || upper(p_name) || ' or small ring' END AS anchor FROM part),"
    " hits AS (SELECT document_id, arg_min(p.name, p.pos) AS hit FROM docs d JOIN products p USING (insurer_id, page_url) WHERE anchor <> '' AND contains(lower(anchor), lower(p.name)) GROUP BY 1),"
    " single AS (SELECT insurer_id, page_url, min(name) AS sole FROM products GROUP BY 1, 2 HAVING count(*) = 1) SELECT document_id, coalesce(hit, sole) AS product_id FROM docs LEFT JOIN hits USING (document_id) LEFT JOIN single USING (insurer_id, page_url)"
)
def match_doc_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    known = part.groupBy(F.col("p_brand").alias("insurer_id"), F.col("p_type").alias("page_url"), F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("pos")).withColumn("product_id", F.col("name"))
    anchor = F.when(F.col("p_size") % 3 == 0, "").otherwise(F.concat(F.lit("Get THE "), F.upper("p_name"), F.lit(" or small ring")))
    docs = part.select(F.col("p_partkey").alias("document_id"), F.col("p_brand").alias("insurer_id"), F.col("p_type").alias("page_url"), anchor.alias("anchor_text"))
    return R.match_products(docs, known).select("document_id", "product_id")


_DEFINED = "defs AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', {i}, {sql_text(n)}, [{', '.join(sql_text(a) for a in aliases)}])" for c, sections in SCHEMAS.items() for i, (n, aliases) in enumerate(sections)) + ") v(category, ordinal, section_name, aliases))"
_MATCHED = """matched AS (SELECT w.doc_id, w.category, d.ordinal, d.section_name,
  coalesce(arg_min(s.content, s.ordinal) FILTER (hit), '') AS content, coalesce(arg_min(CASE WHEN lower(s.title) = lower(d.section_name) THEN 1.0 ELSE 0.8 END, s.ordinal) FILTER (hit), 0)::DOUBLE AS confidence
  FROM wanted w JOIN defs d USING (category) JOIN (SELECT *, true AS x FROM sections) s ON s.doc_id = w.doc_id,
  LATERAL (SELECT lower(s.title) = lower(d.section_name) OR len(list_filter(d.aliases, lambda a: contains(lower(s.title), a))) > 0 AS hit) GROUP BY ALL)"""
_ALL_DOCS = f"{POLICY_SQL}, wanted AS (SELECT doc_id, ['health', 'motor', 'life_term', 'life_savings', 'other'][doc_id % 5 + 1] AS category, text FROM documents UNION ALL SELECT doc_id, category, text FROM policies), said AS (SELECT doc_id, text FROM wanted)"


def _categorised(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.element_at(F.array(*map(F.lit, ("health", "motor", "life_term", "life_savings", "other"))), (F.col("doc_id") % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", kinds.alias("category"))
    return rows.unionByName(policies(spark))


@group.query(f"WITH {_ALL_DOCS}, {_DEFINED}, {SECTIONS_SQL}, {_MATCHED} SELECT doc_id, category, ordinal, section_name, content, confidence FROM matched")
def match_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of all documents, and of policies."""
    texts = _categorised(spark, sf_dir)
    return match(split(texts), texts.select("doc_id", "category")).drop("schema_version")


@group.query(f"WITH {_ALL_DOCS}, {_DEFINED}, {SECTIONS_SQL}, {_MATCHED} SELECT doc_id, section_name, content, confidence FROM matched")
def policy_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections_of(_categorised(spark, sf_dir)).select("doc_id", "section_name", "content", "confidence")


@group.query(f"WITH {_ALL_DOCS} SELECT doc_id, category, category IN ('health', 'life_savings', 'life_term', 'motor') AS supported FROM wanted")
def supported_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a document's category has sections of its own."""
    known = supported(spark).withColumn("known", F.lit(True))
    return _categorised(spark, sf_dir).join(known, "category", "left").select("doc_id", "category", F.coalesce("known", F.lit(False)).alias("supported"))


# Versions of records: events of a user, in order of event_id.


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "cast(user_id as string) AS product_id",
        "event_id AS seq",
        "concat('i', event_id % 7) AS insurer_id",
        "event_type AS name",
        "concat('c', event_id % 3) AS category",
        "concat('u', event_id) AS product_url",
        "if(event_id % 4 = 0, concat('text ', event_id), '') AS description",
        "array(event_type, concat('t', event_id % 5)) AS tags",
        "map(event_type, cast(event_id as string), 'last', cast(event_id as string)) AS metadata",
        "if(event_id % 5 = 0, cast(null as string), concat('h', event_id)) AS content_hash",
        "if(event_id % 3 = 0, concat('p', event_id), cast(null as string)) AS local_path",
        "if(event_id % 4 = 0, concat('text ', event_id), '') AS extracted_text",
    )


_VERSIONS = "v AS (SELECT user_id::VARCHAR AS k, event_id AS seq, 'i' || event_id % 7 AS insurer_id, event_type, 'c' || event_id % 3 AS category, 'u' || event_id AS url, CASE WHEN event_id % 4 = 0 THEN 'text ' || event_id ELSE '' END AS body, CASE WHEN event_id % 5 <> 0 THEN 'h' || event_id END AS hash, CASE WHEN event_id % 3 = 0 THEN 'p' || event_id END AS path FROM events)"
_META = "meta AS (SELECT k, string_agg(key || '=' || last, ',' ORDER BY key) AS metadata FROM (SELECT k, key, max(seq) AS last FROM (SELECT k, seq, event_type AS key FROM v UNION ALL SELECT k, seq, 'last' FROM v) GROUP BY k, key) GROUP BY k)"


def _flat_metadata() -> F.Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


@group.query(
    f"WITH {_VERSIONS}, {_META}, tags AS (SELECT k, string_agg(tag, ',' ORDER BY first) AS tags FROM (SELECT k, tag, min(seq * 2 + p) AS first FROM (SELECT k, seq, 0 AS p, event_type AS tag FROM v UNION ALL SELECT k, seq, 1, 't' || seq % 5 FROM v) GROUP BY k, tag) GROUP BY k)"
    " SELECT k AS product_id, arg_min(insurer_id, seq) AS insurer_id, arg_min(event_type, seq) AS name, arg_min(category, seq) AS category, coalesce(arg_min(body, seq) FILTER (body <> ''), '') AS description, any_value(tags) AS tags, any_value(metadata) AS metadata FROM v JOIN meta USING (k) JOIN tags USING (k) GROUP BY k"
)
def merge_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = R.PRODUCTS.apply(_versions(spark, sf_dir))
    return merged.select("product_id", "insurer_id", "name", "category", "description", F.array_join("tags", ",").alias("tags"), _flat_metadata().alias("metadata"))


@group.query(
    f"WITH {_VERSIONS}, {_META} SELECT k AS document_id, first(insurer_id ORDER BY seq) AS insurer_id, first(hash ORDER BY seq) AS content_hash, arg_min(path, seq) FILTER (path IS NOT NULL) AS local_path, coalesce(arg_min(body, seq) FILTER (body <> ''), '') AS extracted_text, any_value(metadata) AS metadata FROM v JOIN meta USING (k) GROUP BY k"
)
def merge_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _versions(spark, sf_dir).withColumnsRenamed({"product_id": "document_id", "name": "document_type", "product_url": "source_url"}).withColumn("product_id", F.col("insurer_id"))
    merged = R.DOCUMENTS.apply(rows)
    return merged.select("document_id", "insurer_id", "content_hash", "local_path", "extracted_text", _flat_metadata().alias("metadata"))


def _upserted(spark: SparkSession, sf_dir: str, upsert: R.Upsert, keys: dict[str, str], nulls: str) -> DataFrame:
    """Events as versions: those of even ids up to the middle are stored (one a key, the first), all others come in."""
    events = table(spark, sf_dir, "events")
    rest = {c: f"concat('{c}', event_id)" for c in (*upsert.kept, *upsert.written)}
    rest[nulls] = f"if(event_id % 2 = 0, cast(null as string), concat('{nulls}', event_id))"
    if "confidence" in rest:
        rest["confidence"] = "cast(event_id as double)"
    rows = events.selectExpr("event_id AS seq", *[f"{sql} AS {c}" for c, sql in {**keys, **rest}.items()])
    stored = R.first_by_key(rows.where("seq % 10 = 0").withColumn("_k", F.concat_ws("|", *upsert.keys)), "_k", "seq")
    return upsert.apply(stored.drop("_k", "seq"), rows.where("seq % 10 <> 0"))


def _upsert_sql(key: str, kept: str, written: str, nulls: str) -> str:
    """The last version of a key that comes in, or else the stored one; ``kept`` of the stored one, or else of the first."""
    last = "coalesce(max(event_id) FILTER (event_id % 10 <> 0), min(event_id))"
    first = "coalesce(min(event_id) FILTER (event_id % 10 = 0), min(event_id))"
    return f"SELECT {key}, '{kept}' || {first} AS {kept}, '{written}' || {last} AS {written}, CASE WHEN {last} % 2 = 1 THEN '{nulls}' || {last} END AS {nulls} FROM events GROUP BY ALL"


_USER = "cast(user_id as string)"


@group.query(_upsert_sql("user_id::VARCHAR AS insurer_id", "source_url", "name", "website_url"))
def upsert_insurers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _upserted(spark, sf_dir, R.INSURERS, {"insurer_id": _USER}, "website_url").select("insurer_id", "source_url", "name", "website_url")


@group.query(_upsert_sql("user_id::VARCHAR AS product_id", "insurer_id", "name", "description"))
def upsert_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _upserted(spark, sf_dir, R.PRODUCT_ROWS, {"product_id": _USER}, "description").select("product_id", "insurer_id", "name", "description")


@group.query(_upsert_sql("user_id::VARCHAR AS document_id", "insurer_id", "source_url", "extracted_text"))
def upsert_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _upserted(spark, sf_dir, R.DOCUMENT_ROWS, {"document_id": _USER}, "extracted_text").select("document_id", "insurer_id", "source_url", "extracted_text")


@group.query(_upsert_sql("user_id::VARCHAR AS product_id, event_type AS section_name", "category", "schema_version", "section_body"))
def upsert_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = {"product_id": _USER, "section_name": "event_type"}
    return _upserted(spark, sf_dir, R.SECTION_ROWS, keys, "section_body").select("product_id", "section_name", "category", "schema_version", "section_body")


@group.query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IS NOT NULL AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)")
def fk_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = table(spark, sf_dir, "part").where("p_size > 5")
    return R.violations(table(spark, sf_dir, "lineitem"), parents, "l_partkey", "p_partkey").select("l_orderkey", "l_linenumber", "l_partkey")


@group.query(
    "WITH RECURSIVE links AS (SELECT DISTINCT l_suppkey AS url, l_partkey % (SELECT count(*) FROM supplier) AS target FROM lineitem), walk(root, url, depth) AS (SELECT r_regionkey, r_regionkey::BIGINT, 0 FROM region UNION SELECT root, target, depth + 1 FROM walk JOIN links USING (url) WHERE depth < 2)"
    " SELECT root, url, min(depth) AS depth FROM walk GROUP BY root, url"
)
def crawl_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = F.broadcast(table(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("n")))
    links = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct().join(suppliers)
    links = links.select(F.col("l_suppkey").alias("url"), (F.col("l_partkey") % F.col("n")).alias("target"), F.col("l_partkey").alias("pos"))
    roots = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("root"), F.col("r_regionkey").cast("long").alias("url"))
    return R.crawl(roots, links, max_depth=2, max_pages=1_000_000).select("root", "url", "depth")


# The regulator's tables: suppliers and customers as rows of two sources.

_SITE = "CASE WHEN {0} % 3 = 0 THEN ' https://s' || {0} || '.in/x). ' WHEN {0} % 3 = 1 THEN '' END"


def _cells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    general = table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS pos", "map('Sr. No.', concat(' ', s_suppkey), 'Insurer', s_name, 'CEO/CMD', '  ', 'Telephone no./Fax no./ Web address of the Insurer', concat('/ Web: www.t', s_suppkey, '.com;'), 'Website', "
        "CASE WHEN s_suppkey % 3 = 0 THEN concat(' https://s', s_suppkey, '.in/x). ') WHEN s_suppkey % 3 = 1 THEN '' END) AS cells"
    )
    life = table(spark, sf_dir, "customer").selectExpr("c_custkey AS pos", "map('Sl.No', cast(c_custkey as string), 'Name', c_name, 'Designation', c_mktsegment, 'Telephone/Fax', '022-1') AS cells")
    return general, life


def _insurer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    general, life = _cells(spark, sf_dir)
    return ingest.insurer_union([ingest.insurer_rows(general, ingest.SOURCES[0]), ingest.insurer_rows(life, ingest.SOURCES[1])])


_GENERAL = "SELECT 'general' AS category, s_suppkey::VARCHAR AS serial_no, s_name AS insurer_name, NULL AS leader_name, NULL AS leader_designation, '/ Web: www.t' || s_suppkey || '.com;' AS contacts, CASE WHEN s_suppkey % 3 = 0 THEN 'https://s' || s_suppkey || '.in/x).' END AS website, CASE WHEN s_suppkey % 3 = 0 THEN 'https://s' || s_suppkey || '.in/x' ELSE 'https://www.t' || s_suppkey || '.com' END AS website_url FROM supplier"
_LIFE = "SELECT 'life', c_custkey::VARCHAR, c_name, NULL, c_mktsegment, '022-1', NULL, NULL FROM customer"


@group.query(_GENERAL)
def insurer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ingest.insurer_rows(_cells(spark, sf_dir)[0], ingest.SOURCES[0])
    return rows.select("category", "serial_no", "insurer_name", "leader_name", F.lit(None).cast("string").alias("leader_designation"), "contacts", "website", "website_url")


@group.query(f"{_GENERAL} UNION ALL {_LIFE}")
def insurer_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _insurer_rows(spark, sf_dir).select("category", "serial_no", "insurer_name", "leader_name", "leader_designation", "contacts", "website", "website_url")


@group.query(
    f"SELECT category || '-' || replace(lower(replace(insurer_name, '#', '')), ' ', '-') AS insurer_id, insurer_name AS name, category, coalesce(website_url, '') AS website_url, 4 + (website_url IS NOT NULL)::INT + (website IS NOT NULL)::INT + (leader_designation IS NOT NULL)::INT AS n_metadata FROM ({_GENERAL} UNION ALL {_LIFE})"
)
def insurer_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.insurers(_insurer_rows(spark, sf_dir)).select("insurer_id", "name", "category", "website_url", F.size("metadata").alias("n_metadata"))


@group.query("SELECT '2025-01-01T00:00:00+00:00' AS generated_at, count(*) AS record_count, count(DISTINCT n_regionkey) AS n_regions, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation")
def dataset_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = S.envelope(table(spark, sf_dir, "nation"), "2025-01-01T00:00:00+00:00", "records", "n_nationkey", n_regions=F.countDistinct("n_regionkey"))
    return whole.select("generated_at", "record_count", "n_regions", F.array_join(F.transform("records", lambda r: r["n_name"]), ",").alias("names"))


@group.query("SELECT o_orderkey::VARCHAR AS document_id, o_custkey::VARCHAR AS insurer_id, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey::VARCHAR ELSE o_orderpriority END AS insurer_name, nullif(CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE '' END, '') AS product_id FROM orders")
def queue_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = {n: F.lit(None).cast("string") for n in (c.split()[0] for c in S.QUEUE.split(", "))}
    entry["document_id"], entry["insurer_id"] = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    entry["insurer_name"] = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority"))
    entry["product_id"] = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).otherwise("")
    text = F.to_json(F.struct(F.array(F.struct(*[c.alias(n) for n, c in entry.items()])).alias("documents")))
    schema = f"documents array<struct<{S.QUEUE.replace(' string', ':string')}>>"
    envelopes = table(spark, sf_dir, "orders").select(F.from_json(text, schema).alias("e")).select("e.*")
    return S.queue_entries(envelopes).select("document_id", "insurer_id", "insurer_name", "product_id")


# The catalogue: parts as products.


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("ordinal"),
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("insurer"),
        (F.col("p_size") / 10).alias("rating"),
        F.col("p_retailprice").alias("priceFrom"),
        F.lower("p_type").alias("coverageType"),
        F.col("p_size").cast("string").alias("coverageAmount"),
        F.split("p_name", " ").alias("tags"),
        F.col("p_type").alias("categoryId"),
        F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("policyExcerpt"),
        F.lit("https://h/x.pdf").alias("policyDocumentUrl"),
        F.array(F.col("p_brand")).alias("highlights"),
        F.lit("Wording").alias("policyWording"),
        F.when(F.col("p_size") % 2 == 0, F.array(F.struct(F.lit("r1").alias("id"), F.col("p_size").alias("rating")))).otherwise(F.array().cast("array<struct<id:string,rating:int>>")).alias("reviews"),
    )


_FACETS = "p_type IN ('ECONOMY', 'SMALL') AND p_brand IN ('Brand#2', 'Brand#4', 'Brand#17') AND len(list_intersect(string_split(p_name, ' '), ['ring', 'bolt'])) > 0"
_FOUND = "contains(lower(p_name || ' ' || p_brand || ' size ' || p_size || ' Wording ' || p_name), 'ring brand#2')"


@group.query(f"SELECT 'p' || p_partkey AS id FROM part WHERE {_FACETS}")
def facet_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = K.ProductQuery(coverage_types=("economy", "small"), insurers=("Brand#2", "Brand#4", "Brand#17"), tags=("ring", "bolt"))
    return K.facets(catalogue(spark, sf_dir), query).select("id")


@group.query(f"SELECT 'p' || p_partkey AS id, total, ceil(total / 8)::BIGINT AS pages FROM (SELECT *, count(*) OVER () AS total FROM part WHERE {_FOUND}) ORDER BY p_retailprice, p_partkey LIMIT 8 OFFSET 8")
def search_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = K.search(catalogue(spark, sf_dir), K.ProductQuery(search="RING brand#2", sort="price_low", page=2))
    return page.items.select("id", F.lit(page.total).cast("long").alias("total"), F.lit(page.pages).cast("long").alias("pages"))


_SEARCHES = ("ring brand#2", "Size 4", "ng", "WORDING b", "no such words", "bolt bolt")
_HAYSTACK = "lower(p_name || ' ' || p_brand || ' size ' || p_size || ' Wording ' || p_name)"


@group.query(" UNION ALL ".join(f"SELECT '{x}' AS search, p_partkey AS ordinal FROM part WHERE contains({_HAYSTACK}, '{x.lower()}')" for x in _SEARCHES))
def search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All matches of several searches, by the stored index."""
    rows = catalogue(spark, sf_dir)
    index = K.build_index(rows, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}")
    found = [K.matching(rows, K.ProductQuery(search=x), index).select(F.lit(x).alias("search"), F.col("ordinal").cast("long").alias("ordinal")) for x in _SEARCHES]
    return reduce(DataFrame.unionByName, found)


@group.query(
    f"WITH found AS (SELECT * FROM part WHERE contains({_HAYSTACK}, 'ing')) SELECT 'total' AS facet, '' AS value, count(*) AS n FROM found HAVING count(*) > 0 UNION ALL SELECT 'category', p_type, count(*) FROM found GROUP BY 2"
    " UNION ALL SELECT 'insurer', p_brand, count(*) FROM found GROUP BY 2 UNION ALL SELECT 'coverage', lower(p_type), count(*) FROM found GROUP BY 2 UNION ALL SELECT 'tag', unnest(list_distinct(string_split(p_name, ' '))) AS tag, count(*) FROM found GROUP BY 2"
)
def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.facet_counts(catalogue(spark, sf_dir), K.ProductQuery(search="ING"))


@group.query("SELECT row_number() OVER (ORDER BY p_size DESC, p_partkey) AS place, 'p' || p_partkey AS id FROM part ORDER BY 1 LIMIT 100")
def sort_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = K.page_rows(catalogue(spark, sf_dir), K.ProductQuery(sort="rating", page_size=100))
    listed = rows.agg(F.array_sort(F.collect_list(F.struct((-F.col("rating")).alias("r"), "ordinal", "id"))).alias("rows"))
    return listed.select(F.posexplode("rows").alias("place", "x")).select((F.col("place") + 1).cast("long").alias("place"), "x.id")


@group.query("SELECT 'p' || p_partkey AS id, p_name AS name, p_brand AS insurer, p_size / 10 AS rating, p_retailprice AS price, replace(p_name, ' ', ',') AS tags, CASE WHEN p_size % 2 = 0 THEN 'r1' END AS last_review FROM part")
def product_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalogue(spark, sf_dir).select(*K.summary())
    return rows.select("id", "name", "insurer", "rating", F.col("priceFrom").alias("price"), F.array_join("tags", ",").alias("tags"), F.col("lastReview.id").alias("last_review"))


@group.query("SELECT 'p' || p_partkey AS id, p_name AS name, lower(p_type) AS coverage FROM part WHERE p_partkey = 17")
def product_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.detail(catalogue(spark, sf_dir), "p17").select("id", "name", F.col("coverageType").alias("coverage"))


@group.query("SELECT p_partkey AS ordinal, 'p' || p_partkey AS id, p_name AS name, CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN 'Kind ' || p_type ELSE 'All' END AS label FROM part WHERE contains(lower(p_name), 'd r') ORDER BY 1 LIMIT 6")
def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    categories = spark.createDataFrame([("ECONOMY", "Kind ECONOMY"), ("SMALL", "Kind SMALL")], "id string, label string")
    return K.suggestions(catalogue(spark, sf_dir), categories, "D R")


@group.query("SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY last DESC, term DESC) - 1 AS pos, term FROM (SELECT user_id, event_type || ' ' || event_id % 9 AS term, max(ts) AS last FROM events GROUP BY 1, 2) QUALIFY pos < 6")
def recent_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").selectExpr("user_id", "concat(' ', event_type, ' ', event_id % 9, ' ') AS said", "ts")
    return K.recent_searches(rows, "user_id", "said", "ts")


@group.query("SELECT c.id, count(p_partkey) AS n FROM (SELECT DISTINCT p_type AS id FROM part UNION ALL SELECT 'none') c LEFT JOIN part ON p_type = c.id GROUP BY 1")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    products_ = catalogue(spark, sf_dir)
    categories = products_.select(F.col("categoryId").alias("id")).distinct().unionByName(spark.createDataFrame([("none",)], "id string"))
    return K.category_counts(categories, products_).select("id", F.col("productCount").alias("n"))


@group.query("SELECT row_number() OVER (ORDER BY first) - 1 AS pos, tag FROM (SELECT tag, min(k * 10 + i) AS first FROM (SELECT p_partkey AS k, unnest(string_split(p_name, ' ')) AS tag, generate_subscripts(string_split(p_name, ' '), 1) AS i FROM (SELECT * FROM part ORDER BY p_partkey LIMIT 8)) GROUP BY tag)")
def tag_facet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.tag_facet(K.page_rows(catalogue(spark, sf_dir), K.ProductQuery()))


@group.query("SELECT p_partkey, split_part(p_name, ' ', 1) || '-0,' || split_part(p_name, ' ', 2) || '-1' AS ids, p_type || ',' || replace(p_name, ' ', ',') AS searches FROM part")
def array_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").withColumn("tags", F.split("p_name", " "))
    return rows.select("p_partkey", F.array_join(K.numbered_ids(F.col("tags")), ",").alias("ids"), F.array_join(K.remember(F.col("tags"), F.concat(F.col("p_type"), F.lit(" "))), ",").alias("searches"))


@group.query("SELECT p_partkey, CASE WHEN list_contains(string_split(p_name, ' '), 'ring') THEN array_to_string(list_filter(string_split(p_name, ' '), lambda x: x <> 'ring'), ',') ELSE replace(p_name, ' ', ',') || ',ring' END AS tags FROM part")
def array_toggle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(K.toggle(F.split("p_name", " "), F.lit("ring")), ",").alias("tags"))


@group.query("SELECT o_orderkey, o_orderdate::VARCHAR AS updated_at FROM orders ORDER BY o_orderdate DESC, o_orderkey::VARCHAR LIMIT 20")
def topk_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("updated_at"), F.col("o_orderkey").cast("string").alias("document_id"))
    return jobs.newest(rows, 20).select("o_orderkey", F.col("updated_at").cast("string").alias("updated_at"))


# Counts, lists, JSON columns and files.


@group.query(
    f"{_TABLES} SELECT count(*) AS documents, count(DISTINCT nullif(product_id, '')) AS products, count(DISTINCT insurer_id) AS insurers, count(*) FILTER (coalesce(local_path, '') = '') AS missing_files, count(*) FILTER (extension NOT IN ('.pdf', '.doc', '.docx')) AS unsupported,"
    " count(*) FILTER (coalesce(extracted_text, '') <> '') AS with_text, count(*) FILTER (coalesce(extracted_text, '') <> '' AND coalesce(product_id, '') <> '') AS sectioned FROM docs"
)
def reprocess_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.reprocess_stats(documents(spark, sf_dir))


@group.query("SELECT o_custkey AS insurer_id, count(*) AS n, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey::VARCHAR) AS jobs FROM orders GROUP BY 1")
def jobs_by_insurer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("insurer_id"), F.col("o_orderkey").cast("string").alias("document_id"))
    return jobs.jobs_by_insurer(rows).select("insurer_id", F.size("jobs").cast("long").alias("n"), F.array_join("jobs", ",").alias("jobs"))


@group.query("SELECT row_number() OVER (ORDER BY key) - 1 AS pos, key FROM (SELECT DISTINCT event_type AS key FROM events UNION SELECT 'k' || event_id % 4 FROM events)")
def key_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").selectExpr("map(event_type, '1', concat('k', event_id % 4), '2') AS m")
    return S.key_union(rows, "m")


@group.query("SELECT s_suppkey, s_name FROM supplier ORDER BY s_suppkey LIMIT 7")
def limit_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", "s_name").orderBy("s_suppkey").limit(7)


@group.query(f"{_TABLES} SELECT document_id, insurer_id, document_type FROM docs WHERE insurer_id IN (SELECT insurer_id FROM insurers WHERE contains(name, '0012') OR contains(insurer_id, '0012'))")
def products_by_insurer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.by_insurers(documents(spark, sf_dir), insurers(spark, sf_dir), ["0012"], strict=True).select("document_id", "insurer_id", "document_type")


@group.query(f"{_TABLES} SELECT document_id, updated_at FROM docs WHERE extracted_text IS NULL OR extracted_text = ''")
def docs_missing_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.missing_text(documents(spark, sf_dir)).select("document_id", "updated_at")


@group.query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))


@group.query("""SELECT event_id, '{"a":"' || event_id % 3 || '","k":"' || event_type || '","z":"1"}' AS json FROM events""")
def json_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").selectExpr("event_id", "map('z', '1', 'k', event_type, 'a', cast(event_id % 3 as string)) AS m")
    return rows.select("event_id", S.json_sorted(F.col("m")).alias("json"))


@group.query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN (props->>'k')::BIGINT ELSE -1 END AS k FROM events""")
def json_decode_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.expr("CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN cast(null as string) WHEN 2 THEN '' ELSE '{broken' END")
    decoded = S.json_or(given, "k bigint", F.struct(F.lit(None).cast("long").alias("k")))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(decoded["k"], F.lit(-1)).alias("k"))


@group.query("SELECT o_orderkey AS document_id, CASE WHEN o_orderkey % 3 = 0 THEN 0 WHEN o_orderkey % 3 = 1 AND o_orderkey % 2 = 0 THEN 1 WHEN o_orderkey % 5 = 0 THEN 2 END AS round FROM orders")
def retry_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"))
    works = ("document_id % 3 = 0", "document_id % 3 = 1 AND document_id % 2 = 0", "document_id % 5 = 0")
    done, left = jobs.retry_rounds(rows, lambda todo, n: todo.where(works[n]), rounds=2)
    return done.unionByName(left.withColumn("round", F.lit(None).cast("int")))
