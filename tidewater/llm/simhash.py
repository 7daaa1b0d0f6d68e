"""Document fingerprints: SimHash by weighted votes of term hashes, and block tables for neighbours."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.shared import SPACES, own, staged

#: A term's weight is its length in code points, up to this.
MAX_WEIGHT = 12
#: Neighbours are found by id ranges; about so many at most, and each of about so many documents or more.
MAX_RANGES, RANGE_ROWS = 1 << 16, 256
#: Ids that are sampled for each range to place its bounds, and hash values by which the rows of a frequent id are dealt.
SAMPLES, TIES = 16, 1 << 16
_LANES = 0x0000000100000001


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` and the column ``fingerprint`` (long) of each row; ``keys`` must tell rows apart.

    Terms are words. Each adds its weight to the tally of every bit that its hash has set; a bit of the
    fingerprint is set if its tally is over half of all weight. A long holds the tallies of
    two bits, so that 32 sums count all 64. A text without words has fingerprint 0.
    """
    terms = texts.select(*keys, F.explode(F.split(F.coalesce(F.col(text), F.lit("")), SPACES)).alias("term"))
    votes = terms.select(*keys, F.xxhash64("term").alias("h"), F.least(F.char_length("term"), F.lit(MAX_WEIGHT)).cast("long").alias("w"))
    tallies = [F.sum(F.shiftrightunsigned("h", k).bitwiseAND(F.lit(_LANES)) * F.col("w")).alias(f"t{k}") for k in range(32)]
    summed = votes.groupBy(*keys).agg(F.sum("w").alias("total"), *tallies)
    low = [(k, F.col(f"t{k}").bitwiseAND(F.lit(0xFFFFFFFF))) for k in range(32)]
    high = [(k + 32, F.shiftrightunsigned(f"t{k}", 32)) for k in range(32)]
    bits = [F.when(tally * 2 > F.col("total"), F.lit(1 << k if k < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")) for k, tally in low + high]
    return summed.select(*keys, reduce(lambda a, b: a.bitwiseOR(b), bits).alias("fingerprint"))


def likeness(a: str, b: str) -> Column:
    """1 less the share of bits that differ."""
    return 1 - F.bit_count(F.col(a).bitwiseXOR(F.col(b))) / F.lit(64)


def hexed(column: str) -> Column:
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))


def near_fingerprints(queries: DataFrame, table: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """All (query, fingerprint, distance) with a Hamming distance up to ``radius``, both sides distinct fingerprints.

    The 64 bits are cut into ``blocks``; whichever ``radius`` blocks hold the differences, the
    others agree. So there is a table for each choice of ``blocks - radius`` blocks, keyed by
    their bits, and no pair within the radius is missed. Equal fingerprints count once, so
    that groups of copies don't multiply.
    """
    if not 0 < blocks - radius:
        raise ValueError("blocks must exceed radius")
    edges = [64 * k // blocks for k in range(blocks + 1)]
    masks = [sum(((1 << (edges[b + 1] - edges[b])) - 1) << edges[b] for b in chosen) for chosen in combinations(range(blocks), blocks - radius)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    tables = F.explode(F.array(*[F.struct(F.lit(i).alias("table"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for i, m in enumerate(signed)]))

    def keyed(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(F.col("fingerprint").alias("fp")).where("fp is not null").distinct().select(F.col("fp").alias(name), tables.alias("at")).select(name, "at.table", "at.key")

    met = keyed(queries, "query").join(keyed(table, "fingerprint"), ["table", "key"])
    distance = F.bit_count(F.col("query").bitwiseXOR(F.col("fingerprint"))).cast("int")
    return met.select("query", "fingerprint", distance.alias("distance")).where(F.col("distance") <= radius).distinct()


def range_starts(docs: DataFrame) -> tuple[list[tuple[int, int]], list[int]]:
    """Where ranges of about equal numbers of rows begin, as (doc_id, tie), and the ids that fill several ranges.

    Rows of each id are counted; of the counts, a hash of the id picks ``SAMPLES`` for each range, a
    million at most, and all ids of more than four ranges' rows are kept. Their running sum places the
    starts. Only the balance of the ranges, never a result, depends on what is picked.
    """
    total = docs.agg(F.count("doc_id")).first()[0]
    ranges = min(MAX_RANGES, max(1, total // RANGE_ROWS))
    if ranges == 1:
        return [], []
    step, every = -(-total // ranges), max(1, total // (SAMPLES * ranges))
    heavy = F.col("n") > 4 * step
    sizes = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    picked = sizes.where(heavy | (F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)).withColumn("heavy", heavy)
    order = Window.orderBy("doc_id")
    weight = F.when(heavy, F.col("n")).otherwise(F.col("n") * every)
    placed = picked.withColumn("upto", F.sum(weight).over(order)).withColumn("at", F.floor(F.coalesce(F.lag("upto").over(order), F.lit(0)) / step))
    first = F.col("at") > F.coalesce(F.lag("at").over(order), F.lit(0))
    found = placed.withColumn("first", first).where("first or heavy").select("doc_id", "n", "heavy").orderBy("doc_id").collect()
    starts = []
    for doc_id, n, hot in found:
        parts = min(TIES, -(-n // step)) if hot else 1
        starts += [(doc_id, TIES * k // parts) for k in range(parts)]
    return starts, [doc_id for doc_id, _, hot in found if hot]


def _range(starts: list[tuple[int, int]], doc_id: Column, tie: Column) -> Column:
    """How many ranges begin up to a row, by binary search."""
    if not starts:
        return F.lit(0).cast("long")
    ids, ties = (F.split(F.lit(",".join(str(s[i]) for s in starts)), ",").cast("array<bigint>") for i in (0, 1))
    top = len(starts).bit_length() - 1

    def step(upto: Column, size: Column) -> Column:
        at = upto + size - 1
        begun = (F.get(ids, at) < doc_id) | ((F.get(ids, at) == doc_id) & (F.get(ties, at) <= tie))
        return F.when(begun, upto + size).otherwise(upto)

    return F.aggregate(F.array(*[F.lit(1 << k) for k in range(top, -1, -1)]), F.lit(0), step).cast("long")


def with_next(docs: DataFrame) -> DataFrame:
    """Each row of (doc_id, text) with the next document's text, in ascending doc_id, after the last the first.

    Ids are cut into ranges of about equal numbers of rows, however they lie. The first document of each
    range is also sent to the range before, so that every next text is at hand after a single
    shuffle by range. The broadcast table has a row for each range: a few MB at most. Returns range,
    orphan, nth (which together tell rows apart), copy, doc_id, text, next_text. Ties in
    doc_id follow the text, those of an id that fills several ranges a hash of the text first;
    only rows equal in both stay together. Rows without doc_id (orphan) have no next document.
    """
    starts, hot = range_starts(docs)
    tie = F.when(F.col("doc_id").isin(hot), F.pmod(F.xxhash64("text"), F.lit(TIES))).otherwise(0).cast("long") if hot else F.lit(0).cast("long")
    by_range = docs.select("doc_id", "text", tie.alias("tie")).withColumn("range", F.when(F.col("doc_id").isNotNull(), _range(starts, F.col("doc_id"), F.col("tie"))))
    firsts = by_range.where("doc_id is not null").groupBy("range").agg(F.min(F.struct("doc_id", "tie")).alias("first"))
    before = F.coalesce(F.lag("range").over(Window.orderBy("range")), F.max("range").over(Window.partitionBy()))
    places = F.when(F.col("first").isNotNull(), F.array(F.struct("range", F.lit(False).alias("copy")), F.struct(F.col("before").alias("range"), F.lit(True).alias("copy"))))
    alone = F.array(F.struct(F.coalesce("range", F.pmod(F.xxhash64("text"), F.lit(MAX_RANGES))).alias("range"), F.lit(False).alias("copy")))
    sent = by_range.join(F.broadcast(firsts.select("first", before.alias("before"))), F.struct("doc_id", "tie") == F.col("first"), "left").select(
        "doc_id", "text", "tie", F.col("doc_id").isNull().alias("orphan"), F.explode(F.coalesce(places, alone)).alias("place")
    )
    order = Window.partitionBy("range", "orphan").orderBy("copy", "doc_id", "tie", "text")
    rows = sent.select("place.range", "orphan", "place.copy", "doc_id", "tie", "text").withColumn("nth", F.row_number().over(order))
    return rows.withColumn("next_text", F.when(~F.col("orphan"), F.lead("text").over(order))).drop("tie")


def near_counts(queries: DataFrame, table: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """(query, n_near): how many rows of ``table`` lie within ``radius`` of each distinct fingerprint of ``queries``."""
    sizes = table.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"))
    return near_fingerprints(queries, sizes, radius, blocks).join(sizes, "fingerprint").groupBy("query").agg(F.sum("n").alias("n_near"))


def document_fingerprints(docs: DataFrame, search_every: int = 50, radius: int = 3, blocks: int = 6) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text, any more), compared with an edit of itself and with the next document.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, n_near. The edit replaces the last floor(n_chars / 2) code points by the first as
    many of the next document. n_near counts the rows, itself included, whose fingerprint lies
    within ``radius``; the searched rows are those whose doc_id ``search_every`` divides, and
    others have null. A null text counts as empty. A row without doc_id has no next document:
    its edit only drops the half, and near_next is null. The rows of a repeated doc_id follow
    each other. Extra columns are ignored.
    """
    rows = own(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    made = staged(_compared(rows), "fingerprints")
    asked = F.coalesce(F.col("doc_id") % search_every == 0, F.lit(False))
    prints = made.select(F.col("own").alias("fingerprint"))
    near = near_counts(made.where(asked).select(F.col("own").alias("fingerprint")), prints, radius, blocks)
    searched = made.where(asked).join(near, F.col("own") == F.col("query"), "left").drop("query")
    every = searched.unionByName(made.where(~asked).withColumn("n_near", F.lit(None).cast("long")))
    return every.select(
        "doc_id", "n_chars", "edited_sha256", hexed("own").alias("fingerprint"), hexed("edit").alias("edited_fingerprint"), likeness("own", "edit").alias("near_edited"), likeness("own", "ahead").alias("near_next"), "n_near"
    )


def _compared(rows: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, own, edit, ahead): fingerprints of each text, its edit and the next text."""
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    key = ["range", "orphan", "nth"]
    told = ["copy", "doc_id", "n_chars", "edited_sha256"]
    paired = with_next(rows).select(*key, "copy", "doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    sides = paired.select(*key, "copy", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.explode(F.array(F.struct(F.lit(0).alias("side"), "text"), F.struct(F.lit(1).alias("side"), F.col("edited").alias("text")))).alias("of"))
    voted = fingerprints(sides.select(*key, *told, "of.side", "of.text"), [*key, *told, "side"])
    both = voted.groupBy(*key, *told).agg(F.max(F.when(F.col("side") == 0, F.col("fingerprint"))).alias("own"), F.max(F.when(F.col("side") == 1, F.col("fingerprint"))).alias("edit"))
    ahead = F.when(~F.col("orphan"), F.lead("own").over(Window.partitionBy("range", "orphan").orderBy("nth")))
    return both.withColumn("ahead", ahead).where(~F.col("copy")).select("doc_id", "n_chars", "edited_sha256", "own", "edit", "ahead")
