"""A stored index for contiguous substring search: which texts hold which three characters.

Texts are numbered and cut into slices of 32,768. For each three characters and slice one row
lists the texts; a common gram is thus many rows of bounded size. Rows lie in buckets by a hash of
the gram, so that a search reads the buckets of its own grams only. Within a slice the lists of all
grams of the search are intersected; what is left, hardly more than the hits, is looked up
and compared. Below three characters there is no gram, and all texts are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.sources.staging import staged

GRAM, SLICE_BITS, BUCKETS = 3, 15, 64


def grams(text: str) -> list[str]:
    """The different grams of a search, which is in lower case."""
    return sorted({text[i : i + GRAM] for i in range(len(text) - GRAM + 1)})


def _bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class SearchIndex:
    """Below ``folder``: ``texts`` (slice, ordinal, said) and ``postings`` (bucket, gram, slice, places)."""

    spark: SparkSession
    folder: str
    buckets: int

    def texts(self) -> DataFrame:
        return self.spark.read.schema("ordinal long, said string, slice long").parquet(f"{self.folder}/texts")

    def postings(self) -> DataFrame:
        return self.spark.read.schema("gram string, slice long, places array<int>, bucket int").parquet(f"{self.folder}/postings")

    def candidates(self, search: str) -> DataFrame:
        """(slice, ordinal) of the texts that hold every gram of ``search``."""
        wanted = grams(search)
        # The numbers of the search's own buckets, which the scan then is cut to.
        mine = self.spark.createDataFrame([(g,) for g in wanted], "gram string").select(_bucket(F.col("gram"), self.buckets)).distinct().collect()
        rows = self.postings().where(F.col("bucket").isin(*[r[0] for r in mine]) & F.col("gram").isin(*wanted))
        whole = rows.groupBy("slice").agg(F.collect_list("places").alias("lists")).where(F.size("lists") == len(wanted))
        # From the shortest list on; no list is longer than a slice.
        short = F.array_sort("lists", lambda a, b: F.size(a) - F.size(b))
        both = F.reduce(short, short[0], lambda kept, more: F.array_intersect(kept, more))
        return whole.select("slice", F.explode(both).alias("place")).select("slice", (F.shiftleft("slice", SLICE_BITS) + F.col("place")).alias("ordinal"))

    def matching(self, search: str) -> DataFrame:
        """(ordinal) of the texts that contain ``search``, ignoring case."""
        low = search.lower()
        if len(low) < GRAM:
            return self.texts().where(F.col("said").contains(low)).select("ordinal")
        # Staged, so that its size is known. With a condition, Spark takes it for a filter and passes over the slices without a candidate.
        near = staged(self.candidates(low), "candidates").where("ordinal >= 0")
        found = self.texts().join(near, ["slice", "ordinal"])
        return found.where(F.col("said").contains(low)).select("ordinal")


def build_search_index(products: DataFrame, said: Column, folder: str, buckets: int = BUCKETS, ordinal: str = "ordinal") -> SearchIndex:
    """Writes the index of ``products`` (ordinal: from 0 on, each once) over the text ``said``, null as empty, below ``folder``.

    ``folder`` must be one that the driver and all executors share. Ordinals should be dense: a
    slice holds 32,768 of them. Rows without an ordinal aren't found.
    """
    place = F.col(ordinal).cast("long")
    rows = products.where(place.isNotNull()).select(place.alias("ordinal"), F.lower(F.coalesce(said, F.lit(""))).alias("said"))
    sliced = rows.withColumn("slice", F.shiftright("ordinal", SLICE_BITS))
    parts = int(products.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sliced.repartitionByRange(parts, "slice", "ordinal").sortWithinPartitions("ordinal").write.mode("overwrite").partitionBy("slice").parquet(f"{folder}/texts")
    index = SearchIndex(products.sparkSession, folder, buckets)
    n = F.char_length("said") - GRAM + 1
    pieces = F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring("said", i, F.lit(GRAM)))))
    inside = F.col("ordinal").bitwiseAND((1 << SLICE_BITS) - 1).cast("int")
    each = index.texts().select("slice", inside.alias("place"), F.explode(pieces).alias("gram"))
    lists = each.groupBy("gram", "slice").agg(F.array_sort(F.collect_list("place")).alias("places"))
    kept = lists.withColumn("bucket", _bucket(F.col("gram"), buckets))
    kept.repartitionByRange(parts, "bucket", "gram", "slice").sortWithinPartitions("gram", "slice").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")
    return index
