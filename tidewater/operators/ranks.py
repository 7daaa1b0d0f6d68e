"""Exact places of rows in a total order, without one task that holds them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.sources.staging import staged

#: monotonically_increasing_id keeps the partition above this many bits of the place inside it.
_PLACE_BITS = 33


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with ``rank``: 0 for the first row in ``order``, then 1, 2, ...

    Rows are dealt into ranges of the order and numbered inside them; the ranges' sizes, one
    row for each partition, give what comes before each. Rows that are equal in the whole order
    get neighbouring ranks. ``df`` must not have the columns rank and place_. An empty table
    gives an empty result. The result is staged.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    placed = staged(dealt.withColumn("place_", F.monotonically_increasing_id()), name)
    part, inside = F.shiftright("place_", _PLACE_BITS), F.col("place_").bitwiseAND((1 << _PLACE_BITS) - 1)
    sizes = placed.groupBy(part.alias("part_")).agg(F.count(F.lit(1)).alias("size_"))
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part_", F.coalesce(F.sum("size_").over(before), F.lit(0)).alias("start_"))
    # One row for each partition.
    return placed.join(F.broadcast(starts), part == F.col("part_")).select(*[F.col(f"`{c}`") for c in df.columns], (F.col("start_") + inside).alias("rank"))
