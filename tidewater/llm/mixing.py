"""Mixing sources to target weights by hash-threshold histograms, without sorting rows.

Each source gets a number of whole copies, and for what is left of its target those documents
whose hash is below a threshold. The threshold comes from a histogram of sizes over hash
buckets; only the bucket on the boundary is refined, twice by 12 further bits. Thresholds
nest: a larger target takes the same documents and more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.shared import WORD, own, staged

BITS, LEVELS = 12, 3
#: Source tables up to this many rows are broadcast; larger ones are joined by shuffling.
MAX_BROADCAST_SOURCES = 100_000


def word_count(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def ticket(seed: str, doc_id: Column, text: Column) -> Column:
    """36 bits that decide a document's place in every mix of this seed, from its id and its text."""
    named = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))), F.lit(seed))
    return F.conv(F.substring(F.md5(named), 1, BITS * LEVELS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """(source, source_size) to targets: ``share`` of the total, by weight, none above ``most`` times its source.

    Sources in code point order, null last, take the weights in turn. What a capped source
    can't take is shared again by weight. In the order of cap over weight, the capped sources
    come first, so that running sums find the level that the others share.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    cap = F.col("source_size") * most
    fill = Window.orderBy((cap / F.col("weight")), F.col("source").asc_nulls_last())
    before, after, whole = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    left = F.sum("source_size").over(whole) * F.lit(share) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    level = weighed.withColumn("level", left / F.sum("weight").over(after))
    capped = level.withColumn("open", F.col("weight") * F.col("level") < cap)
    final = F.max(F.when(F.col("open"), F.col("level"))).over(whole)
    # The first open source has the highest level of the open ones: the one that they all share.
    return capped.withColumn("final", final).select(
        "source", "source_size", F.coalesce(F.least(cap.cast("double"), F.col("weight") * F.col("final")), cap.cast("double")).alias("target")
    )


def _by_source(rows: DataFrame, facts: DataFrame, few: bool) -> DataFrame:
    facts = facts.withColumnRenamed("source", "_of")
    return rows.join(F.broadcast(facts) if few else facts, F.col("source").eqNullSafe(F.col("_of"))).drop("_of")


def mix_plan(sized: DataFrame, weights: tuple[int, ...], share: float, most: int) -> tuple[DataFrame, bool]:
    """(source, size, ticket) rows to (source, source_size, target, copies, bound), and whether that table may be broadcast.

    A document of the source is taken ``copies`` times, and once more if its ticket is below ``bound``.
    """
    histogram = staged(sized.groupBy("source", F.shiftright("ticket", BITS * (LEVELS - 1)).alias("bucket")).agg(F.sum("size").alias("size")), "histogram")
    sources = targets(histogram.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = staged(sources.withColumn("copies", copies).withColumn("left", F.col("target") - F.col("copies") * F.col("source_size")), "targets")
    few = plan.count() <= MAX_BROADCAST_SOURCES
    edge = plan.select("source", F.lit(0).cast("long").alias("floor"), F.col("left").cast("double").alias("left"))
    for depth in range(LEVELS):
        # Whole buckets are taken while they fit; the first that doesn't is opened further.
        at = Window.partitionBy("source").orderBy("bucket")
        filled = _by_source(histogram, edge, few).withColumn("sum", F.sum("size").over(at)).where(F.col("sum") > F.col("left"))
        first = filled.groupBy("source").agg(F.min(F.struct("bucket", (F.col("left") - (F.col("sum") - F.col("size"))).alias("left"))).alias("edge"))
        edge = staged(first.select("source", F.col("edge.bucket").alias("floor"), F.col("edge.left").alias("left")), "edge")
        if depth + 1 < LEVELS:
            shift = BITS * (LEVELS - 2 - depth)
            inside = _by_source(sized, edge.select("source", "floor"), few).where(F.shiftright("ticket", shift + BITS) == F.col("floor"))
            histogram = inside.groupBy("source", F.shiftright("ticket", shift).alias("bucket")).agg(F.sum("size").alias("size"))
    # Of the last bucket, one place in the order, the nearer side of the target.
    last = _by_source(sized, edge, few).where(F.col("ticket") == F.col("floor")).groupBy("source", "floor", "left").agg(F.sum("size").alias("size"))
    bound = last.select(F.col("source").alias("_of"), (F.col("floor") + F.when(2 * F.col("left") >= F.col("size"), 1).otherwise(0)).alias("bound"))
    final = plan.join(bound, F.col("source").eqNullSafe(F.col("_of")), "left")
    open_ = (F.col("left") > 0) & (F.col("copies") < most)
    final = final.select("source", "source_size", "target", "copies", F.when(open_, F.coalesce("bound", F.lit(1 << (BITS * LEVELS)))).otherwise(0).cast("long").alias("bound"))
    return staged(final, "bounds"), few


def _sized(docs: DataFrame, seed: str) -> DataFrame:
    return own(docs, "doc_id", "source", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count().alias("size"), ticket(seed, F.col("doc_id"), F.col("text")).alias("ticket"))


def _times(ticket_: Column) -> Column:
    return F.col("copies") + F.when(ticket_ < F.col("bound"), 1).otherwise(0)


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: str = "") -> DataFrame:
    """One row for each row of ``docs`` (doc_id, source, text, any more): doc_id, size, source_size, target, taken.

    size: words of the text (null: 0). source_size and target: of the row's source; a null
    source is a source of its own, last in order. taken: words that the mix takes of the
    document, repeats counted: a multiple of its size, at most ``most`` times it. A source's
    taken words come within one document (or rows that share its doc_id and text, which share
    their place in the order) of its target. Texts without words are never taken. Any rerun with the
    same seed takes the same. Extra columns are ignored; an empty table gives an empty result.
    """
    sized = staged(_sized(docs, seed), "sized")
    plan, few = mix_plan(sized, weights, share, most)
    return _by_source(sized, plan, few).select("doc_id", "size", "source_size", "target", (F.col("size") * _times(F.col("ticket"))).cast("long").alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: str = "") -> DataFrame:
    """The mix itself: rows of ``docs`` with all their columns, each as often as the mix takes it, without moving a text.

    Which rows is as in ``mix_sources``: null sources are a source, rows without words (null, empty) are never
    taken, repeated rows are taken alike, null ids are told apart by their texts. Columns keep
    their values whatever their names; an empty table gives an empty result.
    """
    plan, few = mix_plan(staged(_sized(docs, seed), "sized"), weights, share, most)
    facts = plan.select(F.col("source").alias("of"), "copies", "bound")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).where(F.col("row.text").rlike(WORD))
    joined = packed.join(F.broadcast(facts) if few else facts, F.col("row.source").eqNullSafe(F.col("of")))
    times = _times(ticket(seed, F.col("row.doc_id").cast("long"), F.col("row.text")))
    return joined.select("row", F.explode(F.array_repeat(F.lit(True), times.cast("int")))).select("row.*")
