"""Search by the stored index and in one job: the same rows as by reading every text, with fewer bytes and one scan."""

import random

import pytest
from pyspark.sql import functions as F

from tidewater.operators import catalog as K
from tidewater.operators.search_index import build_search_index, grams


def leaves(df):
    """(nodes, bytes) of the scans of a frame that has run."""
    df.collect()
    plan, seen, stack = df._jdf.queryExecution().executedPlan(), [], []
    stack.append(plan)
    while stack:
        node = stack.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            stack.append(node.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            stack.append(node.plan())
            continue
        if name == "FileSourceScanExec":
            seen.append(int(node.metrics().apply("filesSize").value()))
        children = node.children()
        stack += [children.apply(i) for i in range(children.size())]
    return len(seen), sum(seen)


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    rng = random.Random(1)
    words = ["ring", "bolt", "Éclair", "你好", "a", "the", "Plan", "cover", "%", "x\ny"]
    rows = [(i * 3, " ".join(rng.choice(words) for _ in range(rng.randrange(12)))) for i in range(30_000)] + [(200_001, None), (None, "ring bolt"), (200_002, "ri"), (200_003, "RING")]
    table = spark.createDataFrame(rows, "ordinal long, text string")
    return rows, build_search_index(table, F.col("text"), str(tmp_path_factory.mktemp("index")))


@pytest.mark.parametrize("search", ["ring", "RING BOLT", "éclair 你", "好 你好 th", "ng", "x\ny p", "", "no such", "%", "ring ring ring ring ring ring", "ri"])
def test_same_rows_as_reading_all(built, search):
    rows, index = built
    expected = sorted(i for i, t in rows if i is not None and search.lower() in (t or "").lower())
    assert sorted(r.ordinal for r in index.matching(search).collect()) == expected


def test_a_rare_search_reads_few_bytes(spark, tmp_path):
    rows = spark.range(120_000).select("id", F.concat_ws(" ", F.lit("plan for"), F.sha1(F.col("id").cast("string")), F.sha1((F.col("id") + 7).cast("string")), F.when(F.col("id") == 70_001, "zzqqzz").otherwise("")).alias("text"))
    index = build_search_index(rows, F.col("text"), str(tmp_path / "index"), ordinal="id")
    n, read = leaves(index.matching("zzqqzz"))
    assert [r.ordinal for r in index.matching("zzqqzz").collect()] == [70_001]
    _, whole = leaves(index.texts())
    _, postings = leaves(index.candidates("zzqqzz"))
    _, everything = leaves(index.postings())
    assert n >= 1 and read < 0.5 * whole  # one slice of four
    assert postings < 0.15 * everything  # the buckets of four grams of 64


def test_grams():
    assert grams("abcabc") == ["abc", "bca", "cab"] and grams("ab") == []


PRODUCTS = "ordinal int, id string, name string, insurer string, rating double, priceFrom int, coverageType string, coverageAmount string, tags array<string>, categoryId string, policyExcerpt string, policyDocumentUrl string, highlights array<string>, policyWording string, reviews array<struct<id:string,rating:int>>"


@pytest.fixture(scope="module")
def products(spark, tmp_path_factory):
    rng = random.Random(2)
    rows = [(i, f"p{i}", f"Plan {rng.choice(['Moor', 'Dale', 'Fell'])} {i}", rng.choice(["A", "B"]), float(i % 5), i % 7, rng.choice(["base", None]), "1", rng.choice([["x", "y", "x"], ["z"], [], None]), rng.choice(["h", "m"]), "short", "u", [], "long wording", []) for i in range(500)]
    path = str(tmp_path_factory.mktemp("products"))
    spark.createDataFrame(rows, PRODUCTS).write.mode("overwrite").parquet(path)
    return rows, spark.read.parquet(path)


@pytest.mark.parametrize("query", [K.ProductQuery(), K.ProductQuery(search="moor", sort="price_low", page=3), K.ProductQuery(search="nothing"), K.ProductQuery(search="fell 1", insurers=("A",), sort="rating"), K.ProductQuery(tags=("x",), page=99)])
def test_page_and_total_from_one_job(spark, products, tmp_path, query):
    _, table = products
    tracker, group = spark.sparkContext.statusTracker(), f"search-{tmp_path}"
    spark.sparkContext.setJobGroup(group, "one page")
    page = K.search(table, query)
    jobs = tracker.getJobIdsForGroup(group)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    expected = K.page_rows(table, query).select(*K.summary()).collect()
    assert page.items.collect() == expected and page.total == K.matching(table, query).count()
    assert len(jobs) <= 1
    indexed = K.search(table, query, K.build_index(table, str(tmp_path / "index")))
    assert indexed.items.collect() == expected and indexed.total == page.total


def test_all_facets_from_one_scan(products):
    rows, table = products
    query = K.ProductQuery(search="MOOR")
    counted = K.facet_counts(table, query)
    found = [r for r in rows if "moor" in r[2].lower()]
    expected = {("total", ""): len(found)}
    for facet, at in (("category", 9), ("insurer", 3), ("coverage", 6)):
        for r in found:
            if r[at] is not None:
                expected[facet, r[at]] = expected.get((facet, r[at]), 0) + 1
    for r in found:
        for tag in set(r[8] or []):
            expected["tag", tag] = expected.get(("tag", tag), 0) + 1
    assert {(r.facet, r.value): r.n for r in counted.collect()} == expected
    assert leaves(counted)[0] == 1
