"""The retry queue as a stream with a clock by hand: the loop's successes, with pauses, back-off and dead letters."""

import json
from collections import defaultdict
from datetime import UTC, datetime, timedelta

from pyspark.sql import functions as F

from tidewater.plans.jobs import retry_rounds
from tidewater.streaming.retries import JOBS, Policy, retry_stream

START = datetime(2024, 5, 1, tzinfo=UTC)
#: document: the attempt that succeeds.
WORKS = {"a1": 0, "a2": 1, "a3": 2, "a4": 3, "b1": 0, "b2": 99, "b3": 1}


def attempt(document, url, n):
    if url == "raises" and n < WORKS[document]:
        raise TimeoutError(url)
    return n >= WORKS[document]


def at(seconds):
    return (START + timedelta(seconds=seconds)).isoformat()


def test_same_successes_as_the_loop(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    policy = Policy(pause=10, back_off=60, retries=2)
    (tmp_path / "in").mkdir()
    jobs = [{"insurer_id": d[0], "document_id": d, "source_url": "raises" if d == "b3" else "u", "at": at(0)} for d in WORKS]
    for n, rows in enumerate([jobs, jobs[:1], *[[{"insurer_id": "", "at": at(s)}] for s in range(5, 600, 25)]]):
        (tmp_path / f"in/{n:03}.json").write_text("\n".join(map(json.dumps, rows)))
    source = spark.readStream.schema(JOBS).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    try:
        query = retry_stream(source, attempt, policy).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).foreachBatch(lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(str(tmp_path / "out"))).trigger(availableNow=True).start()
        query.awaitTermination(240)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("at", "insurer_id").collect()
    done = {r.document_id: r.attempt for r in rows if r.outcome == "done"}
    table = spark.createDataFrame([(d, w) for d, w in WORKS.items()], "document_id string, works int")
    loop, left = retry_rounds(table, lambda open_, n: open_.where(F.col("works") <= n), 2)
    assert done == {r.document_id: r["round"] for r in loop.collect()}
    assert {r.document_id for r in rows if r.outcome == "dead"} == {r.document_id for r in left.collect()} == {"a4", "b2"}
    tries, times = defaultdict(list), defaultdict(list)
    for r in rows:
        tries[r.document_id].append((r.attempt, r.at))
        times[r.insurer_id].append(r.at)
    for document, seen in tries.items():
        assert [n for n, _ in seen] == list(range(len(seen))), document  # each attempt once, a repeated job too
        assert all((b - a).total_seconds() >= 60 * 2**n for n, ((_, a), (_, b)) in enumerate(zip(seen, seen[1:], strict=False)))
    for seen in times.values():
        assert all((b - a).total_seconds() >= 10 for a, b in zip(seen, seen[1:], strict=False))
