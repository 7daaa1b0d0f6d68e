"""Names inside texts: the join by rare pieces against brute force, and on scopes of very many names."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tidewater.operators.relational import absent, match_products, parents_set_null, substring_pairs, without_parents

ALPHABET = "abAB éÉ你-"


def word(rng, n):
    return "".join(rng.choice(ALPHABET) for _ in range(n))


@pytest.mark.parametrize(("few", "heavy"), [(0, 3), (5, 10_000), (1000, 1)])
def test_against_brute_force(spark, few, heavy):
    rng = random.Random(few)
    names = [(rng.choice(["x", "y", None]), i, word(rng, rng.randrange(7))) for i in range(120)] + [("x", 500, None), ("z", 501, "only z"), ("x", 502, "aab"), ("x", 503, "aab")]
    texts = [(rng.choice(["x", "y", None, "w"]), i, word(rng, rng.randrange(40))) for i in range(150)] + [("x", 600, None), ("x", 601, ""), ("x", 602, "aab"), ("x", 602, "aab")]
    texts += [("x", 700 + i, "BaBa and") for i in range(40)]
    found = substring_pairs(spark.createDataFrame(texts, "k string, i long, said string"), spark.createDataFrame(names, "k string, j long, name string"), ["k"], "said", "name", few, heavy)
    assert found.columns == ["k", "i", "said", "j", "name"]
    expected = [(k, i, t, j, n) for k, i, t in texts if t for l, j, n in names if k == l and n is not None and n.lower() in t.lower()]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(expected, key=repr)


def test_empty_sides(spark):
    texts, names = spark.createDataFrame([], "k string, i long, said string"), spark.createDataFrame([("a", 1, "n")], "k string, j long, name string")
    assert substring_pairs(texts, names, ["k"], "said", "name", 0).count() == 0
    assert substring_pairs(spark.createDataFrame([("a", 1, "n")], texts.schema), names.limit(0), ["k"], "said", "name", 0).count() == 0


def test_time_follows_the_hits(spark):
    """One scope of 100,000 names: each document has one of them, and is not held against the others."""
    products = spark.range(100_000).select(F.lit("i").alias("insurer_id"), F.lit("p").alias("page_url"), F.concat(F.lit("Plan "), F.sha1(F.col("id").cast("string")).substr(1, 12)).alias("name"), F.col("id").alias("product_id"), F.col("id").alias("pos"))
    docs = spark.range(20_000).select(F.lit("i").alias("insurer_id"), F.lit("p").alias("page_url"), F.col("id").alias("document_id"), F.concat(F.lit("get PLAN "), F.sha1((F.col("id") * 5).cast("string")).substr(1, 12), F.lit(" here")).alias("anchor_text"))
    start = time.time()
    found = match_products(docs, products)
    wrong = found.where(~F.col("product_id").eqNullSafe(F.col("document_id") * 5)).count()
    assert wrong == 0
    assert time.time() - start < 90  # two thousand million comparisons would take many minutes


def test_rows_without_a_key_are_dealt(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.range(4000).select("id", F.when(F.col("id") % 100 == 0, F.col("id")).alias("k"))
        gone = spark.range(0, 1000).withColumnRenamed("id", "p")
        for left, count in ((without_parents(rows, gone, "k", "p"), 3990), (absent(rows, gone.withColumnRenamed("p", "k"), "k"), 3990), (parents_set_null(rows, gone, "k", "p"), 4000)):
            parts = left.groupBy(F.spark_partition_id()).count().collect()
            assert sum(r["count"] for r in parts) == count and len(parts) == 4 and max(r["count"] for r in parts) < 1300
        assert parents_set_null(rows, gone, "k", "p").where("k IS NULL").count() == 3970
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
