"""Text, URL, HTML, section and classification rules."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tidewater import catalogue
from tidewater.functions import text as T
from tidewater.functions import urls as U
from tidewater.operators import classifying as C
from tidewater.operators.relational import resolve_names
from tidewater.operators.sections import SCHEMAS, definitions, document_lines, match_sections, policy_sections, sections_by_window, sections_of_lines, split_sections, supported_categories
from tidewater.plans.ingest import SOURCES, Limits, directory, harvest, page_links_of, with_site
from tidewater.sources.html import description, headings, links, table, table_rows, tree


def values(spark, texts, column):
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r[1] for r in sorted(frame.select("i", column(F.col("t"))).collect())]


def test_cleaning(spark):
    assert values(spark, ["  a \tb\x1c ", "योजना plan", None, ""], T.clean_text) == ["a b", "plan", None, ""]


def python_slug(x):
    ascii_ = unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode()
    return re.sub(r"[-\s]+", "-", re.sub(r"[^\w\s-]", "", ascii_).strip().lower())


def test_slugs(spark):
    texts = ["Café Müller — Plan", "--x  y__z--", " Tab\tand  space ", "ﬁne ½ price", "", "ÅÄÖ"]
    once = values(spark, texts, T.slugify)
    assert once == [python_slug(x) for x in texts]
    assert values(spark, once, T.slugify) == once


def test_whole_texts_are_slugged(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    slugs = {r.id: r.slug for r in catalogue.queries()["slugify"](spark, sf).collect() if r.id >= 0}
    assert slugs == {i: python_slug(x) for i, x in texts.items()} and sum("\n" in x.strip() for x in texts.values()) > len(texts) / 2


@pytest.mark.parametrize(
    ("line", "expected"),
    [("12345", True), ("---", True), ("Policy covers everything", True), ("policy covers", False), ("Covered.", False), ("KEY FEATURES:", True), (":", False), ("A " * 13, False), ("X" * 121, False), ("X" * 120, True)],
)
def test_headings(spark, line, expected):
    assert values(spark, [line], T.is_heading) == [expected]


def test_highlight(spark):
    seen = spark.createDataFrame([("Lake Health Supreme (lake)",)], "t string")
    parts = seen.select(T.highlight(F.col("t"), " lake (  sup ")).first()[0]
    assert [(p.text, p.match) for p in parts] == [("Lake", True), (" Health ", False), ("Sup", True), ("reme ", False), ("(", True), ("lake", True), (")", False)]
    assert [(p.text, p.match) for p in seen.select(T.highlight(F.col("t"), "  ")).first()[0]] == [("Lake Health Supreme (lake)", False)]
    assert [(p.text, p.match) for p in seen.select(T.highlight(F.lit(""), "x")).first()[0]] == [("", False)]


def test_urls(spark):
    assert values(spark, ["//h/p", "www.h.com", "http://h", ""], U.ensure_scheme) == ["https://h/p", "www.h.com", "http://h", ""]
    assert values(spark, ["https://h/a.PDF", "https://h/a.pdf?v=1", "https://h/noext", "https://h/x.html", "https://h/.hidden"], U.detect_extension) == [".pdf", ".pdf", ".dat", ".html", ".dat"]
    assert values(spark, ["https://h/p/x.pdf", "https://h/a.b.docx", "https://h/"], U.stem) == ["x", "a.b", "h"]
    joined = values(spark, ["../x", "/y", "https://o/z", "", "?q"], lambda c: U.absolute_url(F.lit("https://h/a/b/c"), c))
    assert joined == ["https://h/a/x", "https://h/y", "https://o/z", "", "https://h/a/b/c?q"]
    assert values(spark, ["https://h:80/a", "HTTPS://H/a", "https://www.h/a", ""], lambda c: U.same_domain(c, F.lit("https://h/"))) == [False, False, False, False]
    assert values(spark, ["/ Web: www.harbour.com", None], lambda c: U.primary_url(c, F.lit("/ Phone: 1"))) == ["https://www.harbour.com", ""]


def test_classification(spark):
    assert values(spark, ["Immediate Annuity", "Care", "x", "Term Plan"], lambda c: C.category(c, F.lit(""))) == ["health", "motor", "other", "life_term"]
    assert values(spark, ["Motor and Health Term"], C.tags) == [["health", "motor", "life_term"]]
    assert values(spark, ["Sales Brochure", "", None], lambda c: C.document_type(c, F.lit("https://h/policy-wordings.pdf"))) == ["brochure", "policy_wording", "policy_wording"]
    assert values(spark, ["My plan", "plan", "x y z w"], C.potential_product) == [True, False, False]


PAGE = """<html><body id=top><script>var plan = "<h1>no</h1>"</script><nav><a href='/about'>About</a><a href="mailto:x@y">m</a><a href="/a.zip">z</a><a href="https://other/x">o</a></nav>
<div class="downloads section"><h2>Harbour Health Plan <a href="plan.html">more</a></h2><p>First text<p>Second <b>bold</b> text</div>
<h3>Short</h3><div><a href="docs/harbour-policy-wording.pdf" title="Download">Policy wording of Harbour Health Plan more</a> <a href="x.pdf">other</a></div>"""


def test_html_needs_no_well_formed_page():
    root = tree(PAGE)
    assert [(h["level"], h["title"], h["href"]) for h in headings(root)] == [("h2", "Harbour Health Plan more", "plan.html"), ("h3", "Short", "")]
    assert headings(root)[0]["description"] == "First text Second bold text"
    found = links(root)
    assert [x["href"] for x in found] == ["/about", "mailto:x@y", "/a.zip", "https://other/x", "plan.html", "docs/harbour-policy-wording.pdf", "x.pdf"]
    assert found[5]["attributes"] == ["Download"] and "downloads section" in found[4]["ancestors"]
    assert "no" not in root.text().split() and tree(None).text() == "" and tree("</p>a<br>b").text() == "a b"
    long = tree("<h1>t</h1>" + "".join(f"<p>{'x' * 150}</p>" for _ in range(9)))
    assert len(description(next(long.find("h1")))) == 150 * 3 + 2


def test_tables(spark):
    html = "<table id='x'><thead><tr><th>A</th><th>A</th><th>B</th></tr></thead><tbody><tr><td>1</td><td>2</td></tr><tr><td> </td></tr></tbody></table>"
    assert table(tree(html), "x") == {"headers": ["A", "A", "B"], "rows": [["1", "2", ""]]} and table(tree(html), "y") is None
    pages = spark.createDataFrame([("p", html), ("q", "<p>none")], "page string, html string")
    assert [(r.page, r.cells) for r in table_rows(pages, "x").collect()] == [("p", {"A": "2", "B": ""})]
    with pytest.raises(Exception, match="no table"):
        table_rows(pages, "x", strict=True).collect()


def test_sections(spark):
    text = "intro text goes here, all lower case.\nKEY\nEligibility:\nAdults only, from 18 years on.\n12345\nPremium\nSee the chart, please."
    docs = spark.createDataFrame([(1, text, "health", "policy_wording"), (2, "", "health", "policy_wording"), (3, text, "unknown", "brochure")], "doc_id long, text string, category string, document_type string")
    rows = [(r.title, r.content) for r in split_sections(docs.where("doc_id = 1")).orderBy("ordinal").collect()]
    assert rows == [("Overview", "intro text goes here, all lower case."), ("Eligibility", "Adults only, from 18 years on."), ("Premium", "See the chart, please.")]
    assert sorted(split_sections(docs).collect()) == sorted(sections_by_window(docs).collect())
    for block in (1, 3, 10_000):
        assert sorted(split_sections(docs).collect()) == sorted(sections_of_lines(document_lines(docs), block=block).collect())
    found = policy_sections(docs).collect()
    assert {r.doc_id for r in found} == {1} and len(found) == len(SCHEMAS["health"])
    assert {r.section_name: r.confidence for r in found if r.confidence} == {"Eligibility": 1.0, "Premium Illustration": 0.8}
    assert policy_sections(docs, doc_types=("brochure",)).count() == 0
    assert [r.category for r in supported_categories(spark).collect()] == ["health", "life_savings", "life_term", "motor"]
    assert definitions(spark).count() == 31


def test_an_earlier_alias_beats_a_later_exact_title(spark):
    sections = spark.createDataFrame([(1, 0, "Claim process and more", "a"), (1, 1, "Claims", "b")], "doc_id long, ordinal int, title string, content string")
    row = match_sections(sections, spark.createDataFrame([(1, "health")], "doc_id long, category string")).where("section_name = 'Claims'").first()
    assert (row.content, row.confidence) == ("a", 0.8)


def test_resolve_names(spark):
    names = spark.createDataFrame([("general-moor", "Moor"), ("life-lic", "LIC of India")], "insurer_id string, name string")
    assert [r.insurer_id for r in resolve_names(names, [" LIC ", ""]).collect()] == ["life-lic"]
    assert resolve_names(names, ["  "]).count() == 0


def test_from_regulator_pages_to_sections(spark):
    def regulator(source, rows):
        head = "".join(f"<th>{h}</th>" for h in source.columns)
        body = "".join("<tr>" + "".join(f"<td>{c}</td>" for c in row) + "</tr>" for row in rows)
        return (source.url, f"<table id='{source.table_id}'><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>")

    general, life, health = SOURCES
    pages = [regulator(general, [["1", "Harbour", "x", "y", "z", "/ Web: www.harbour.in", ""]]), regulator(life, [["1", "Lake Life", "7"]]), regulator(health, [["1", "Moor", "", "", "", "", "https://moor.in/)."]])]
    insurers = directory(spark.createDataFrame(pages, "url string, html string"))
    known = {r.insurer_id: r.website_url for r in insurers.collect()}
    assert known == {"general-harbour": "https://www.harbour.in", "life-lake-life": "", "health-moor": "https://moor.in/"}
    assert {r.insurer_id for r in with_site(insurers).collect()} == {"general-harbour", "health-moor"}
    visited = spark.createDataFrame([("general-harbour", "https://h/p/", 0, PAGE), ("general-harbour", "https://h/q/", 1, '<p class="downloads"><a href="/b/leaflet.pdf">a leaflet</a></p>')], "insurer_id string, page_url string, visit long, html string")
    texts = spark.createDataFrame([("https://h/p/docs/harbour-policy-wording.pdf", "Eligibility\nAdults only, from 18 years on.")], "source_url string, extracted_text string")
    out = harvest(visited, texts, Limits())
    product = out.products.collect()
    assert [(p.product_id, p.category, p.tags, p.product_url) for p in product] == [("general-harbour-harbour-health-plan-more", "health", ["health"], "https://h/p/plan.html")]
    documents = {d.document_id: d for d in out.documents.collect()}
    assert set(documents) == {"general-harbour-harbour-policy-wording-policy_wording", "general-harbour-leaflet-brochure"}
    assert all(d.product_id == product[0].product_id for d in documents.values())
    assert {s.section_name: s.confidence for s in out.sections.collect() if s.confidence} == {"Eligibility": 1.0}
    crawl = page_links_of(visited.select(F.lit("https://h/").alias("root"), F.col("page_url").alias("url"), "html"))
    assert {r.target for r in crawl.collect()} == {"https://h/about", "https://h/p/plan.html"}


def test_one_text_of_very_many_lines_over_many_tasks(spark):
    """Two million lines of one document: no task sees more than some blocks, and the rows are what they should be."""
    n, every = 2_000_000, 1000
    text = F.when(F.col("id") % every == 7, F.concat(F.lit("HEADING NUMBER "), F.col("id").cast("string"))).otherwise(F.concat(F.lit("a line of prose, "), F.col("id").cast("string"), F.lit(".")))
    rows = spark.range(n, numPartitions=16).select(F.lit(1).alias("doc_id"), F.col("id").alias("pos"), text.alias("line"))
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        found = sections_of_lines(rows).cache()
        assert found.count() == n // every + 1
        facts = found.select("ordinal", "title", F.size(F.split("content", "\n")).alias("n")).orderBy("ordinal").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert [r.ordinal for r in facts] == list(range(n // every + 1))
    assert facts[0].n == 7 and facts[1].title == "HEADING NUMBER 7" and {r.n for r in facts[1:-1]} == {999} and facts[-1].n == 992
    found.unpersist()


def test_sections_of_all_documents_are_matched(spark):
    sf = "/root/testdata/sf0.001"
    documents = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id % 5 < 4 and trim(text) <> ''")
    found = catalogue.queries()["match_sections"](spark, sf).where("doc_id >= 0")
    assert found.select("doc_id").distinct().count() > 0.9 * documents.count() and "content" in found.columns
