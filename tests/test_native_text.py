"""Decomposition and url resolution as column expressions, against the library and the standard's own examples."""

import unicodedata
from urllib.parse import urljoin

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewater.functions.text import plain_ascii, slugify
from tidewater.functions.urls import absolute_url

#: RFC 3986, 5.4: references resolved against http://a/b/c/d;p?q.
EXAMPLES = {
    "g:h": "g:h", "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q#s",
    "g#s": "http://a/b/c/g#s", "g?y#s": "http://a/b/c/g?y#s", ";x": "http://a/b/c/;x", "g;x": "http://a/b/c/g;x", "g;x?y#s": "http://a/b/c/g;x?y#s", ".": "http://a/b/c/", "./": "http://a/b/c/", "..": "http://a/b/", "../": "http://a/b/",
    "../g": "http://a/b/g", "../..": "http://a/", "../../": "http://a/", "../../g": "http://a/g", "../../../g": "http://a/g", "../../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g", "g.": "http://a/b/c/g.", ".g": "http://a/b/c/.g",
    "g..": "http://a/b/c/g..", "..g": "http://a/b/c/..g", "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/", "g/./h": "http://a/b/c/g/h", "g/../h": "http://a/b/c/h", "g;x=1/./y": "http://a/b/c/g;x=1/y", "g;x=1/../y": "http://a/b/c/y",
    "g?y/./x": "http://a/b/c/g?y/./x", "g?y/../x": "http://a/b/c/g?y/../x", "g#s/./x": "http://a/b/c/g#s/./x", "g#s/../x": "http://a/b/c/g#s/../x", "http:g": "http://a/b/c/g",
}
BASES = ["http://a/b/c/d;p?q", "https://h.in", "https://h.in/", "http://h/x//y/z.html?q=1#f", "//h/p", "/only/path", "ftp://h/a/b", "mailto:x@y", "custom://h/a", "rel/ative", "HTTP://H/A/../b", "http://h/a/../../b/./", None, ""]


def resolved(spark, pairs):
    rows = spark.createDataFrame([(i, b, u) for i, (b, u) in enumerate(pairs)], "i int, b string, u string")
    return [r.x for r in rows.select("i", absolute_url(F.col("b"), F.col("u")).alias("x")).orderBy("i").collect()]


def test_the_standards_examples(spark):
    assert resolved(spark, [("http://a/b/c/d;p?q", u) for u in EXAMPLES]) == list(EXAMPLES.values())


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(st.lists(st.tuples(st.sampled_from(BASES), st.text(st.sampled_from("ab./?#: \t\n=&%é") , max_size=12) | st.sampled_from(["javascript:x", "HTTP://Q/r", "https:/x", "http:", "//", "///a", "?", "#", " /x", "a//b//../c", "./a:b"])), min_size=60, max_size=60))
def test_as_the_library_resolves(spark, pairs):
    assert resolved(spark, pairs) == [urljoin(b or "", u) if u else "" for b, u in pairs]


def test_empty_and_null_urls(spark):
    assert resolved(spark, [("http://a/", None), ("http://a/", ""), (None, "x"), ("", "/x")]) == ["", "", "x", "/x"]


def test_every_character_decomposes_as_in_the_library(spark):
    points = [p for p in range(0x110000) if not 0xD800 <= p < 0xE000]
    texts = ["".join(map(chr, points[i : i + 997])) for i in range(0, len(points), 997)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    found = [r.x for r in rows.select("i", plain_ascii(F.col("t")).alias("x")).orderBy("i").collect()]
    assert found == [unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode() for t in texts]


def test_no_python_in_the_plans(spark):
    rows = spark.createDataFrame([("Crème brûlée №5 ½ ﬁn", "http://a/b"), (None, None), ("plain", "")], "t string, u string")
    df = rows.select(slugify(F.col("t")).alias("s"), absolute_url(F.lit("https://h/x/y"), F.col("u")).alias("a"))
    assert [tuple(r) for r in df.collect()] == [("creme-brulee-no5-12-fin", "http://a/b"), (None, ""), ("plain", "")]
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
