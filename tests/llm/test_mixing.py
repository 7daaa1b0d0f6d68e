import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidewater.llm.mixing import mix_sources, mixed

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, source string"


def shared_out(sizes: dict, weights=(5, 2, 1), share=1.5, most=2) -> dict:
    """The rule as written: share by weight, cap, share the excess again until no target is above its cap."""
    ranked = sorted(sizes, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(ranked)}
    target, left, open_ = {}, share * sum(sizes.values()), set(ranked)
    while open_:
        level = left / sum(weight[s] for s in open_)
        capped = {s for s in open_ if weight[s] * level >= most * sizes[s]}
        if not capped:
            break
        for s in capped:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= capped
    return target | {s: weight[s] * level for s in open_}


def test_whole_table_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    result = mix_sources(docs).collect()
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in result:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", rows[r.doc_id].text or ""))
        assert r["size"] == n and r.taken in (0, n, 2 * n)
        source = rows[r.doc_id].source
        sizes[source] += n
        taken[source] += r.taken
        largest[source] = max(largest[source], n)
    targets = shared_out(sizes)
    for r in result:
        source = rows[r.doc_id].source
        assert r.source_size == sizes[source] and r.target == pytest.approx(targets[source])
    assert len(result) == len(rows)
    assert sum(targets.values()) == pytest.approx(1.5 * sum(sizes.values()))
    for source, target in targets.items():
        assert abs(taken[source] - target) <= largest[source]


def test_the_mix_takes_what_the_plan_says(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("size", F.lit("clash")).withColumn("copies", F.lit(None).cast("int"))
    planned = {r.doc_id: r.taken // r["size"] for r in mix_sources(docs).collect() if r.taken}
    out = mixed(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()} == planned


def test_nulls_ties_repeats_and_empty(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (2, None, "x"), (3, "", None), (4, "d e", None), (None, "f", "y"), (5, " \t\n", "z")]
    result = mix_sources(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(result) == 7
    assert all(r.taken == 0 for r in result if r["size"] == 0)
    assert {r.source_size for r in result if r.doc_id == 4} == {2}
    empty = spark.createDataFrame([], SCHEMA)
    assert mix_sources(empty).count() == 0 and mixed(empty).count() == 0


def test_thresholds_nest(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("source", F.lit("one"))
    small = {r.doc_id: r.taken for r in mix_sources(docs, share=0.3).collect()}
    large = {r.doc_id: r.taken for r in mix_sources(docs, share=0.6).collect()}
    assert all(large[d] >= t for d, t in small.items())
    assert sum(small.values()) < sum(large.values())


def test_rows_without_an_id_meet_their_targets(spark):
    rows = [(None, " ".join(["word"] * (1 + i % 9)) + f" {i}", "xyz"[i % 7 % 3]) for i in range(600)]
    result = mix_sources(spark.createDataFrame(rows, SCHEMA)).collect()
    taken, target = defaultdict(int), {}
    for r in result:
        taken[r.source_size] += r.taken
        target[r.source_size] = r.target
    assert len(target) == 3 and all(abs(taken[s] - t) <= 10 for s, t in target.items())
