"""Text, URL, HTML and classification operators over documents, pages, parts and trap values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import text as T
from tidewater.functions import urls as U
from tidewater.operators import classifying as C
from tidewater.operators.relational import resolve_names
from tidewater.plans.ingest import document_id as document_key
from tidewater.queries.base import Group, table
from tidewater.sources.html import page_headings, page_links, page_text, table_rows

group = Group()

# DuckDB's own spelling of the character classes.
_W = r"[\s\x0B\x1C-\x1F\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_CLEAN = rf"trim(regexp_replace(regexp_replace({{0}}, '[\x{{{{0900}}}}-\x{{{{097F}}}}]+', '', 'g'), '{_W.replace('{', '{{').replace('}', '}}')}+', ' ', 'g'))"
_SLUG = (
    r"regexp_replace(lower(trim(regexp_replace(regexp_replace(strip_accents({0}), '[^\x00-\x7F]', '', 'g'), '[^\w\s\x0B\x1C-\x1F-]', '', 'g'), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31))),"
    r" '[-\s\x0B\x1C-\x1F]+', '-', 'g')"
)
_LINES = (
    r"lines AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS pos FROM (SELECT doc_id, "
    + _CLEAN.format("x.line")
    + r" AS line, x.ord FROM said, LATERAL (SELECT unnest(regexp_split_to_array(text, '\r\n|[\n\r\x0B\f\x1C-\x1E\x{0085}\x{2028}\x{2029}]')) AS line, generate_subscripts(regexp_split_to_array(text, '\r\n|[\n\r\x0B\f\x1C-\x1E\x{0085}\x{2028}\x{2029}]'), 1) AS ord) x) WHERE line <> '')"
)
_HEAD = (
    r"(length(regexp_replace(line, ':+$', '')) BETWEEN 1 AND 120 AND len(list_filter(regexp_split_to_array(trim(regexp_replace(line, ':+$', '')), '\s+'), lambda w: w <> '')) <= 12"
    r" AND (length(regexp_replace(regexp_replace(line, ':+$', ''), '[^\p{Lu}]', '', 'g')) >= length(regexp_replace(regexp_replace(line, ':+$', ''), '[^\p{Ll}]', '', 'g')) OR regexp_matches(regexp_replace(line, ':+$', ''), '^[A-Z][A-Za-z0-9\s/&,-]{3,}$')))"
)

_POLICIES = (
    (-1, "Key Features\nCovers everything at home.\n\nEligibility:\nAdults from 18 to 65 years.\nWAITING PERIODS\nThirty days for all, and longer for some ailments of note.\n12345\nPremium\nSee the chart below, please, for all ages.", "health"),
    (-2, "intro line of the policy text here, before any heading at all.\nCOVERAGE\nOWN DAMAGE COVER\nOwn damage is covered up to the value declared by the insured.\nClaims:\nCall us within a day of the loss, or write.", "motor"),
    (-3, "Benefits\nDeath benefit is paid at once to the nominee of the insured.\nSuicide Clause\nNo benefit is paid in the first year of the policy.\fPolicy Term\nTen to forty years, as you like it.", "life_term"),
    (-4, "no headings in this text, only a line that goes on.", "life_savings"),
    (-5, "Loan\nLoans up to the surrender value are granted, at interest.", "unknown"),
)


def policies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(_POLICIES), "doc_id long, text string, category string")


def sql_text(x: str) -> str:
    """A text as a DuckDB expression."""
    plain = "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\f", "' || chr(12) || '") + "'"
    return plain


POLICY_SQL = "policies AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {sql_text(t)}, '{c}')" for i, t, c in _POLICIES) + ") v(doc_id, text, category))"
_SAID = f"{POLICY_SQL}, said AS (SELECT doc_id, text FROM documents UNION ALL SELECT doc_id, text FROM policies)"


def said(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, and policy texts with headings."""
    return table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(policies(spark).select("doc_id", "text"))


@group.query(f"WITH {_SAID} SELECT doc_id, {_CLEAN.format('text')} AS text FROM said")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return said(spark, sf_dir).select("doc_id", T.clean_text(F.col("text")).alias("text"))


_SCRIPTS = ("plan योजना one", "योजना", "no script", "a  b", None)


@group.query(r"SELECT id, regexp_replace(text, '[\x{0900}-\x{097F}]+', '', 'g') AS text FROM (SELECT doc_id AS id, text FROM documents UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({-i}, {'NULL' if x is None else sql_text(x)})" for i, x in enumerate(_SCRIPTS, 1)) + ") v(id, text))")
def strip_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    traps = spark.createDataFrame([(-i, x) for i, x in enumerate(_SCRIPTS, 1)], "id long, text string")
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text").unionByName(traps)
    return rows.select("id", T.strip_script(F.col("text")).alias("text"))


_SLUGS = ("Café Müller — Plan", "--x  y__z--", " Tab\tand  space ", "naïve_ñandú!", "")


@group.query("SELECT id, " + _SLUG.format("text") + " AS slug FROM (SELECT doc_id AS id, text FROM documents UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({-i}, {sql_text(x)})" for i, x in enumerate(_SLUGS, 1)) + ") v(id, text))")
def slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    traps = spark.createDataFrame([(-i, x) for i, x in enumerate(_SLUGS, 1)], "id long, text string")
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text").unionByName(traps)
    return rows.select("id", T.slugify(F.col("text")).alias("slug"))


@group.query(
    "SELECT doc_id, string_agg(word, ' ' ORDER BY first) AS words FROM (SELECT doc_id, word, min(ord) AS first FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS ord FROM documents) WHERE word <> '' GROUP BY doc_id, word) GROUP BY doc_id"
)
def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array_join(T.ordered_distinct(F.split("text", " ")), " ")
    return table(spark, sf_dir, "documents").select("doc_id", words.alias("words")).where("words <> ''")


@group.query(f"WITH {_SAID}, {_LINES} SELECT doc_id, pos, line FROM lines")
def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.operators.sections import document_lines

    return document_lines(said(spark, sf_dir))


@group.query(f"WITH {_SAID}, {_LINES} SELECT doc_id, pos, {_HEAD} AS heading FROM lines")
def is_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_lines(spark, sf_dir).select("doc_id", "pos", T.is_heading(F.col("line")).alias("heading"))


SECTIONS_SQL = rf"""{_LINES}, marked AS (SELECT *, {_HEAD} AS head FROM lines),
islands AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM marked),
sections AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY island) - 1 AS ordinal, title, content FROM (
  SELECT doc_id, island, coalesce(max(regexp_replace(line, ':+$', '')) FILTER (head), 'Overview') AS title, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT head) AS content FROM islands GROUP BY doc_id, island) WHERE content IS NOT NULL)"""
SAID_SQL = _SAID


@group.query(f"WITH {_SAID}, {SECTIONS_SQL} SELECT doc_id, ordinal, title, content FROM sections")
def split_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.operators.sections import split_sections as split

    return split(said(spark, sf_dir))


@group.query(f"WITH {_SAID}, {SECTIONS_SQL} SELECT doc_id, count(*) AS sections, sum(length(content))::BIGINT AS chars FROM sections GROUP BY doc_id")
def sections_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.operators.sections import sections_by_window

    return sections_by_window(said(spark, sf_dir)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("sections"), F.sum(F.length("content")).alias("chars"))


@group.query(f"WITH {_SAID}, {SECTIONS_SQL} SELECT doc_id, ordinal, title, content FROM sections")
def sections_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as rows of lines, cut over blocks of twenty."""
    from tidewater.operators import sections

    return sections.sections_of_lines(sections.document_lines(said(spark, sf_dir)), block=20)


@group.query("SELECT p_partkey, length(p_name) - length(regexp_replace(p_name, '(?i)(an|e)', '', 'g')) AS matched, len(regexp_extract_all(p_name, '(?i)(an|e)')) AS matches, p_name AS text FROM part")
def highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = table(spark, sf_dir, "part").select("p_partkey", T.highlight(F.col("p_name"), " an  E ").alias("s"))
    hits = F.filter("s", lambda x: x["match"])
    whole = F.array_join(F.transform("s", lambda x: x["text"]), "")
    return marked.select("p_partkey", F.char_length(F.array_join(F.transform(hits, lambda x: x["text"]), "")).cast("long").alias("matched"), F.size(hits).cast("long").alias("matches"), whole.alias("text"))


# URLs.

_SCHEMES = ("//h/p", "www.h.com", "http://h/p", "", None)


@group.query("SELECT url, CASE WHEN url LIKE '//%' THEN 'https:' || url ELSE url END AS full_url FROM (SELECT url FROM pages UNION ALL SELECT regexp_replace(url, '^https?:', '') FROM pages UNION ALL SELECT * FROM (VALUES " + ", ".join("(NULL)" if x is None else f"('{x}')" for x in _SCHEMES) + ") v(url))")
def ensure_scheme(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("url")
    rows = pages.unionByName(pages.select(F.regexp_replace("url", "^https?:", "").alias("url"))).unionByName(spark.createDataFrame([(x,) for x in _SCHEMES], "url string"))
    return rows.select("url", U.ensure_scheme(F.col("url")).alias("full_url"))


@group.query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) = regexp_extract(replace(replace(url, '://www.', '://'), '://m.', '://'), '^[a-z]+://([^/?#]*)', 1) AS same FROM pages")
def same_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    apex = F.regexp_replace("url", r"://(www|m)\.", "://")
    return table(spark, sf_dir, "pages").select("page_id", U.same_domain(F.col("url"), apex).alias("same"))


_SITES = (("/ Web: www.harbour.com", "x"), (None, "/ Phone: 1"), ("", "see HTTPS://A.com/x). or www.b.in"), ("none", None))


@group.query(
    "SELECT first, second, coalesce(nullif(CASE WHEN lower(a) LIKE 'www.%' THEN 'https://' || a ELSE a END, ''), nullif(CASE WHEN lower(b) LIKE 'www.%' THEN 'https://' || b ELSE b END, ''), '') AS site FROM (SELECT first, second, regexp_replace(regexp_extract(first, '(?i)(https?://[^\\s,;]+|www\\.[^\\s,;]+)', 1), '[).,;]+$', '') AS a,"
    " regexp_replace(regexp_extract(second, '(?i)(https?://[^\\s,;]+|www\\.[^\\s,;]+)', 1), '[).,;]+$', '') AS b FROM (SELECT 'page ' || page_id AS first, 'at ' || url || ').' AS second FROM pages UNION ALL SELECT * FROM (VALUES "
    + ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in pair) + ")" for pair in _SITES)
    + ") v(first, second)))"
)
def primary_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("first"), F.concat(F.lit("at "), "url", F.lit(").")).alias("second"))
    rows = pages.unionByName(spark.createDataFrame(list(_SITES), "first string, second string"))
    return rows.select("first", "second", U.primary_url(F.col("first"), F.col("second")).alias("site"))


_FILES = ("https://h/a.PDF", "https://h/a.pdf?v=1", "https://h/docs/a.b.docx", "https://h/noext", "https://h/x.html", "https://h/.hidden", "https://h/get?f=a.pdf&x=y")
_FILE_SQL = "(SELECT url FROM pages UNION ALL SELECT * FROM (VALUES " + ", ".join(f"('{x}')" for x in _FILES) + ") v(url))"
_SUFFIX = r"lower(regexp_extract(regexp_extract(url, '([^/]*)/*$', 1), '.(\.[^.]+)$', 1))"
_EXT = f"CASE WHEN {_SUFFIX} IN ('.pdf', '.doc', '.docx') THEN {_SUFFIX} WHEN contains(lower(url), '.pdf') THEN '.pdf' WHEN {_SUFFIX} <> '' THEN {_SUFFIX} ELSE '.dat' END"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("url").unionByName(spark.createDataFrame([(x,) for x in _FILES], "url string"))


@group.query(f"SELECT url, {_EXT} AS extension, CASE {_EXT} WHEN '.pdf' THEN 'application/pdf' WHEN '.doc' THEN 'application/msword' WHEN '.docx' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' END AS media_type FROM {_FILE_SQL}")
def detect_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _files(spark, sf_dir).withColumn("extension", U.detect_extension(F.col("url")))
    return rows.select("url", "extension", U.media_type(F.col("extension")).alias("media_type"))


@group.query(
    f"SELECT url, 'data/documents/ins/' || {_SLUG.format('url')} || {_EXT} AS path, CASE WHEN contains(url, '.html') THEN 'kept/' || url ELSE 'data/documents/ins/' || {_SLUG.format('url')} || coalesce(nullif({_SUFFIX}, ''), '.pdf') END AS resolved FROM {_FILE_SQL}"
)
def local_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _files(spark, sf_dir).withColumns({"slug": T.slugify(F.col("url")), "insurer": F.lit("ins"), "stored": F.concat(F.lit("kept/"), "url"), "exists": F.contains("url", F.lit(".html")), "recorded": F.lit("")})
    resolved = U.stored_path(F.col("stored"), F.col("exists"), F.col("recorded"), F.col("url"), "data/documents", F.col("insurer"), F.col("slug"))
    return rows.select("url", U.local_path("data/documents", F.col("insurer"), F.col("slug"), U.detect_extension(F.col("url"))).alias("path"), resolved.alias("resolved"))


_STEM = r"regexp_replace(regexp_extract(url, '([^/]*)/*$', 1), '(.)\.[^.]+$', '\1')"


@group.query(f"SELECT url, {_SLUG.format(f'concat_ws(chr(45), chr(105) || chr(49), {_STEM}, chr(120))')} AS document_id FROM {_FILE_SQL}")
def document_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("url", document_key(F.lit("i1"), F.col("url"), F.lit("x")).alias("document_id"))


# HTML. Anchors of the pages are relative to the host.

_ANCHORS = r"SELECT page_id, url, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href, generate_subscripts(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1), 1) - 1 AS pos FROM pages"


@group.query(r"SELECT page_id, pos, CASE WHEN href LIKE '/%' THEN regexp_extract(url, '^[a-z]+://[^/?#]*') || href ELSE href END AS target FROM (" + _ANCHORS + ")")
def resolve_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "pages").select("page_id", "url", F.posexplode(page_links("html")).alias("pos", "link"))
    return links.select("page_id", "pos", U.absolute_url(F.col("url"), F.col("link.href")).alias("target"))


@group.query("SELECT page_id, pos, href FROM (" + _ANCHORS + ")")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(page_links("html")).alias("pos", "link")).select("page_id", "pos", "link.href")


_H1 = r"unnest(regexp_extract_all(html, '(?s)<h([1-4])[^>]*>(.*?)</h', 1))"


@group.query(
    r"SELECT page_id, 'h' || unnest(regexp_extract_all(html, '(?s)<h([1-4])[^>]*>(.*?)</h', 1)) AS level, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(unnest(regexp_extract_all(html, '(?s)<h([1-4])[^>]*>(.*?)</h', 2)), '<[^>]*>', ' ', 'g'),"
    r" '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#x27;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g')) AS title FROM pages"
)
def html_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.explode(page_headings("html")).alias("h")).select("page_id", "h.level", "h.title")


_ENTITIES = "replace(replace(replace(replace(replace(replace(replace({0}, '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#x27;', chr(39)), '&amp;', '&')"
_TEXT = _ENTITIES.format(r"trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))")


@group.query(f"SELECT page_id, {_TEXT} AS text FROM pages")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", page_text("html").alias("text"))


_TABLES = (
    ("t1", "<table id='x'><thead><tr><th>A</th><th> B&amp;C </th></tr></thead><tbody><tr><td>1</td><td>2<td>extra</tr><tr><td> </td></tr><tr><th>no cells</th></tr><tr><td>only</td></tr></tbody></table>"),
    ("t2", "<div><table id='y'></table><table id='x'><thead><th>A<th>A</thead><tbody><tr><td><b>u</b> v</td><td>w</td></tr></table></div>"),
    ("t3", "<p>no table"),
)


_OWN_HTML = "CASE page_id % 3 " + " ".join(f"WHEN {k} THEN {sql_text(html)}" for k, (_, html) in enumerate(_TABLES)) + " END"


@group.query(
    "SELECT page_id, 0 AS pos, '1' AS a, '2 extra' AS bc FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT page_id, 1, 'only', '' FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT page_id, 2, url, page_id::VARCHAR FROM pages WHERE page_id % 3 = 0"
    " UNION ALL SELECT page_id, 0, 'w', NULL FROM pages WHERE page_id % 3 = 1"
)
def html_table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table behind each page's own text, in a third of them with a row that tells the page's address."""
    row = F.concat(F.lit("<tr><td>"), "url", F.lit("</td><td>"), "page_id", F.lit("</td></tr></tbody>"))
    html = F.concat("html", F.replace(F.expr(_OWN_HTML), F.lit("<tr><td>only</td></tr></tbody>"), F.concat(F.lit("<tr><td>only</td></tr>"), row)))
    rows = table_rows(table(spark, sf_dir, "pages").select("page_id", html.alias("html")), "x")
    return rows.select("page_id", "pos", F.try_element_at("cells", F.lit("A")).alias("a"), F.try_element_at("cells", F.lit("B&C")).alias("bc"))


_HEADED = r"trim(regexp_replace(regexp_replace(unnest(regexp_extract_all(html, '(?s)<h([1-4])[^>]*>(.*?)</h', 2)), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"
_SPOKEN = {"english": " the | and ", "german": " die | und ", "romance": " que | la "}


@group.query(
    f"WITH heads AS (SELECT page_id, {_TEXT} AS page, {_HEADED} AS raw FROM pages), titled AS (SELECT page_id, page, {_ENTITIES.format('raw')} AS title FROM heads)"
    " SELECT page_id, title, CASE " + " ".join(f"WHEN regexp_matches(lower(title || ' ' || page), '{w}') THEN '{k}'" for k, w in _SPOKEN.items()) + " ELSE 'other' END AS category, concat_ws(',', "
    + ", ".join(f"CASE WHEN regexp_matches(lower(title), '{w}') THEN '{k}' END" for k, w in _SPOKEN.items())
    + ") AS tags FROM titled WHERE length(title) > 5 AND regexp_matches(lower(title), 'the|die|que|les|plan')"
)
def product_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All headings with a product-like word; the pages' own words stand in for the domain's."""
    found = table(spark, sf_dir, "pages").select("page_id", page_text("html").alias("page"), F.explode(page_headings("html")).alias("h"))
    title = F.col("h.title")
    kept = found.where(C.potential_product(title, ("the", "die", "que", "les", "plan")))
    kinds = {"english": (" the ", " and "), "german": (" die ", " und "), "romance": (" que ", " la ")}
    return kept.select("page_id", title.alias("title"), C.category(title, F.col("page"), kinds).alias("category"), F.array_join(C.tags(title, kinds), ",").alias("tags"))


# Classification. Parts' types stand in for titles; traps show that keywords are substrings.

_TITLES = ("Immediate Annuity", "Care", "x", "Term Plan for Life Cover", "Motor and Health", "Money Back", None)
_TITLE_SQL = "(SELECT p_name AS title, p_type AS page FROM part UNION ALL SELECT v.t, '' FROM (VALUES " + ", ".join("(NULL)" if x is None else f"('{x}')" for x in _TITLES) + ") v(t))"
_KIND = {k: "regexp_matches({0}, '" + "|".join(v) + "')" for k, v in {"health": ("health", "medi", "hospital"), "motor": ("motor", "car", "bike", "vehicle", "auto"), "life_term": ("term", "life cover"), "life_savings": ("traditional", "savings", "endowment", "money back", "investment")}.items()}


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_name").alias("title"), F.col("p_type").alias("page"))
    return parts.unionByName(spark.createDataFrame([(x, "") for x in _TITLES], "title string, page string"))


@group.query("SELECT title, page, CASE " + " ".join(f"WHEN {c.format('text')} THEN '{k}'" for k, c in _KIND.items()) + f" ELSE 'other' END AS category FROM (SELECT *, lower(coalesce(title, '') || ' ' || coalesce(page, '')) AS text FROM {_TITLE_SQL})")
def classify_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _titles(spark, sf_dir).select("title", "page", C.category(F.col("title"), F.col("page")).alias("category"))


@group.query("SELECT title, page, concat_ws(',', " + ", ".join(f"CASE WHEN {c.format('lower(title)')} THEN '{k}' END" for k, c in _KIND.items()) + f") AS tags FROM {_TITLE_SQL}")
def extract_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _titles(spark, sf_dir).select("title", "page", F.array_join(C.tags(F.col("title")), ",").alias("tags"))


_LINKS = (
    ("Sales Brochure", "https://h/x.pdf"), ("", "https://h/policy-wordings.pdf"), ("", "https://h/a/policydocument_1.pdf"), ("Prospectus", "https://h/leaflet.pdf"), ("", "https://h/page"),
    ("Download now", "https://h/docs/terms.docx?x=brochure"), ("Policy Schedule", "https://h/a%20b.PDF#p"), (None, "https://h/wording/x.pdf"),
)
_LINK_SQL = "(SELECT p_name AS anchor, 'https://h/' || replace(p_type, ' ', '-') || '.pdf' AS url FROM part UNION ALL SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in pair) + ")" for pair in _LINKS) + ") v(anchor, url))"
_TYPE = "CASE WHEN regexp_matches(a, 'policy wording|policy document|policy schedule') THEN 'policy_wording' WHEN regexp_matches(a, 'brochure|leaflet') THEN 'brochure' WHEN regexp_matches(a, 'prospectus') THEN 'prospectus' WHEN regexp_matches(u, 'policy[-_ ]?(wording|document|schedule)') THEN 'policy_wording' WHEN regexp_matches(u, 'brochure|leaflet') THEN 'brochure' WHEN contains(u, 'prospectus') THEN 'prospectus' ELSE 'other' END"


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.lit("https://h/"), F.replace("p_type", F.lit(" "), F.lit("-")), F.lit(".pdf"))
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("anchor"), url.alias("url")).unionByName(spark.createDataFrame(list(_LINKS), "anchor string, url string"))


@group.query(f"SELECT anchor, url, {_TYPE} AS document_type, {_TYPE} <> 'other' AS required FROM (SELECT *, lower(coalesce(anchor, '')) AS a, lower(url) AS u FROM {_LINK_SQL})")
def infer_doc_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _links(spark, sf_dir).withColumn("document_type", C.document_type(F.col("anchor"), F.col("url")))
    return rows.withColumn("required", F.col("document_type").isin(*C.REQUIRED_TYPES))


@group.query(f"SELECT anchor, url FROM (SELECT *, regexp_replace(lower(url), '[?#].*$', '') AS u FROM {_LINK_SQL}) WHERE regexp_matches(u, '\\.(pdf|doc|docx)$') AND regexp_matches(lower(coalesce(anchor, '')) || ' ' || u, 'policy|wording|brochure|prospectus|schedule|leaflet')")
def doc_keyword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir).where(C.is_document_link(F.col("anchor"), F.col("url")))


@group.query(
    f"SELECT anchor, url, regexp_matches(lower(url), 'download|product-?brochure|policy-wording|policy_wording|policywording|policy-document') OR regexp_matches(lower(coalesce(anchor, '')), 'download|brochure|policy wording|policy document|policy schedule') OR coalesce(length(anchor) % 7 = 0, false) AS download FROM {_LINK_SQL}"
)
def download_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    hint = F.array(F.when(F.length("anchor") % 7 == 0, F.lit("btn Downloads")).otherwise("plain"))
    return _links(spark, sf_dir).select("anchor", "url", C.is_download_link(F.col("anchor"), F.col("url"), F.array(F.lit("x")), hint).alias("download"))


@group.query("SELECT s_suppkey, s_name FROM supplier WHERE contains(lower(s_name), '7') OR contains(lower(s_suppkey::VARCHAR), '7') OR contains(lower(s_name), '00001')")
def resolve_insurers(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("insurer_id"), F.col("s_name").alias("name"))
    return resolve_names(names, [" 7", "00001 ", ""]).select(F.col("insurer_id").cast("long").alias("s_suppkey"), F.col("name").alias("s_name"))
