"""Characters that decompose to several are found by ranges, and every one of them is spelled as the library does."""

import unicodedata

from tidewater.functions import text as T


def test_classes_have_few_ranges():
    other = T._residues()[2]
    written = T._ranges(other)
    assert len(other) > 400 and written.count("-") < 80


def test_every_character_is_spelled(spark):
    one, _, other = T._residues()
    texts = [f"a{c}{c}z" for c in [*other, *one[::50]]] + ["".join(other), "x\u4e00\u00bd\u00e9\U0001f100" * 50, "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.s for r in rows.select("i", T.plain_ascii(rows.t).alias("s")).collect()}
    assert [got[i] for i in range(len(texts))] == [None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode() for t in texts]


def test_slug_edges(spark):
    rows = spark.createDataFrame([("\x1c\u2003 A  B\x85\t",), ("\u00a0--x_y--\x0b",), (" \n ",)], "t string")
    assert [r.s for r in rows.select(T.slugify(rows.t).alias("s")).collect()] == ["a-b", "--x_y--".replace("--", "-"), ""]
