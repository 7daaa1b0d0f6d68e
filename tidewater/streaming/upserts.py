"""Structured Streaming upserts: each micro-batch is merged into a stored table, exactly once per batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidewater.operators.relational import Upsert
from tidewater.sources.tables import StoredTable

#: Buckets of a streamed table: a batch reads and writes only those that its keys fall into.
BUCKETS = 64


def upsert_stream(changes: DataFrame, path: str, upsert: Upsert, order: str, checkpoint: str, trigger: dict | None = None, buckets: int = BUCKETS) -> StreamingQuery:
    """Merges a stream of row versions into the table at ``path``; read it with ``streamed_table``.

    ``order`` tells which version of a key is the latest. A batch becomes visible as a whole or
    not at all, and an upsert is idempotent, so that a batch repeated after a failure changes
    nothing.
    """
    stored = streamed_table(path, upsert, buckets)

    def merge(batch: DataFrame, _: int) -> None:
        touched = [r[0] for r in batch.select(stored.bucket()).distinct().collect()]  # as many as there are buckets, at most
        if touched:
            current = stored.read(batch.sparkSession, touched)
            stored.rewrite(upsert.apply(batch.drop(order).limit(0) if current is None else current, batch, order), touched)

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def streamed_table(path: str, upsert: Upsert, buckets: int = BUCKETS) -> StoredTable:
    return StoredTable(path, upsert.keys, buckets)
