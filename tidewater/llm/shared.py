"""Arrow helpers for the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.sources.staging import staged, unstaged

#: What separates words, for Spark's regular expressions and for DuckDB's.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"

def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow over whole record batches; ``function`` yields what one batch becomes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from function(batch)

    return df.mapInArrow(run, schema)


def own(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns can't clash with those an operator adds."""
    return df.select(*[F.col(f"`{name}`") for name in names])


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


__all__ = ["SPACES", "WORD", "documents", "map_batches", "own", "staged", "unstaged"]
