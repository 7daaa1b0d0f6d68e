"""Importance resampling towards a target distribution, by hashed runs of words.

1. Each text becomes one row of a sparse matrix: how often each bucket is hit by its runs of
   one to three words. The matrix is persisted as blocks of compressed sparse rows (CSR): a
   table row holds the ids, row starts, bucket numbers and counts of some dozens of documents,
   numbers packed in as few bytes as hold them.
2. Column sums of the blocks give the raw distribution, those of the target's texts the other
   one; both are one number for each bucket, whatever the size of the corpus.
3. The blocks times the vector of gains (log ratios) give each document's weight.
4. A Gumbel key for each document turns the weights into a draw without replacement: the
   highest keys are taken. They are ranked over ranges of keys, not by one task, and only those
   near enough to the top to be drawn are ranked at all.

Texts are cut into words a megabyte at a time, so that a very long one needs no more memory
than its own bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.shared import map_batches, own, staged
from tidewater.operators.ranks import ranked

BUCKETS, LONGEST = 10_000, 3
#: A block is closed when it has so many entries.
BLOCK_ENTRIES = 1 << 16
_PIECE = 1 << 20
#: Bytes that stand in words: digits, a to z and everything beyond ASCII; all others separate them.
_SEPARATED = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_MATRIX = "doc_ids array<long>, digests array<long>, n_words array<long>, starts binary, buckets binary, counts binary, widths array<int>"


def _words(text: str) -> Iterator[list[bytes]]:
    flat, at = text.encode().lower().translate(_SEPARATED), 0  # bytes.lower knows A to Z only
    while at < len(flat):
        end = flat.find(b" ", at + _PIECE)
        end = len(flat) if end < 0 else end
        yield flat[at:end].split()
        at = end


def _hits(words: list[bytes], starts: int, longest: int, buckets: int) -> np.ndarray:
    """Buckets of the runs that start at one of the first ``starts`` words."""
    spaced = [b" " + w for w in words]
    state = [crc32(w) for w in words[:starts]]
    codes = state
    for k in range(1, longest):
        state = list(map(crc32, spaced[k : k + starts], state))  # the run so far and one word more
        codes = codes + state
    return np.array(codes, np.int64) % buckets


def row_counts(text: str | None, longest: int = LONGEST, buckets: int = BUCKETS) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of words, buckets that are hit (ascending), and how often."""
    total, held, n = np.zeros(buckets, np.int64), [], 0
    for words in _words(text or ""):
        n += len(words)
        held += words
        starts = max(0, len(held) - (longest - 1))
        total += np.bincount(_hits(held, starts, longest, buckets), minlength=buckets)
        held = held[starts:]
    total += np.bincount(_hits(held, len(held), longest, buckets), minlength=buckets)
    hit = np.flatnonzero(total)
    return n, hit, total[hit]


def _packed(numbers: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the fewest bytes."""
    most = int(numbers.max(initial=0))
    return numbers.astype(f"<u{next(w for w in (1, 2, 4, 8) if most < 1 << (8 * w))}")


def count_matrix(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, name: str = "matrix") -> DataFrame:
    """``docs`` (doc_id, text, any more) to a persisted matrix: one table row for each block of documents.

    Row i of a block has the entries ``starts[i]:starts[i + 1]`` of ``buckets`` and ``counts``;
    widths has their numbers' bytes. digests tell texts apart where a doc_id repeats.
    """

    def block(rows: list[tuple]) -> pa.RecordBatch:
        ids, digests, n_words, hits, counts = zip(*rows, strict=True)
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, pa.int64())) for x in (ids, digests, n_words)]
        packed = [_packed(x) for x in (np.concatenate([[0], np.cumsum([len(x) for x in hits])]), np.concatenate(hits), np.concatenate(counts))]
        widths = pa.array([[x.itemsize for x in packed]], pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([*lists, *(pa.array([x.tobytes()], pa.binary()) for x in packed), widths], ["doc_ids", "digests", "n_words", "starts", "buckets", "counts", "widths"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, entries = [], 0
        for batch in batches:
            for doc_id, digest, text in zip(*(batch.column(k) for k in range(3)), strict=True):
                n, hit, times = row_counts(text.as_py(), longest, buckets)
                rows.append((doc_id.as_py(), digest.as_py(), n, hit, times))
                entries += len(hit) + 1
                if entries >= BLOCK_ENTRIES:
                    yield block(rows)
                    rows, entries = [], 0
        if rows:
            yield block(rows)

    texts = own(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"), "text")
    return staged(texts.mapInArrow(run, _MATRIX), name)


def _entries(batch: pa.RecordBatch, i: int) -> list[np.ndarray]:
    """starts, buckets and counts of a block."""
    widths = batch.column("widths")[i].as_py()
    return [np.frombuffer(batch.column(c)[i].as_buffer(), f"<u{w}").astype(np.int64) for c, w in zip(("starts", "buckets", "counts"), widths, strict=True)]


def column_sums(matrix: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket is hit in all rows: ``buckets`` numbers, summed in tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                _, hit, times = _entries(batch, i)
                # Sums of a block are far below 2^53, so that doubles are exact.
                total += np.bincount(hit, times, buckets).astype(np.int64)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(total[hit])], ["bucket", "n"])

    found = matrix.select("starts", "buckets", "counts", "widths").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(buckets, np.int64)
    total[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return total


def log_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln(p / q)) for each bucket, p and q its smoothed shares of target and raw."""
    buckets, whole, aim = len(raw), float(raw.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(t) + 1) * (whole + buckets) / ((float(s) + 1) * (aim + buckets)))) for s, t in zip(raw, target, strict=True)], np.int64)


def row_weights(matrix: DataFrame, gains: np.ndarray) -> DataFrame:
    """The matrix times the gains: doc_id, digest, n_words, n_features, weight for each document."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i in range(batch.num_rows):
            starts, hit, counts = _entries(batch, i)
            sums = [np.concatenate([[0], np.cumsum(x)])[starts] for x in (counts, counts * gains[hit])]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c)[i].values for c in ("doc_ids", "digests", "n_words")), *(pa.array(np.diff(x)) for x in sums)],
                ["doc_id", "digest", "n_words", "n_features", "weight"],
            )

    return map_batches(matrix, run, "doc_id long, digest long, n_words long, n_features long, weight long")


def importance_ranks(docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, seed: int = 42, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text, any more): doc_id, digest, n_words, n_features, weight, score, rank.

    ``target`` has a column text. Of the N rows with at least ``min_words`` words, floor(percent
    * N / 100) are drawn: those of the highest score, ties to the smaller doc_id (null last),
    then to the smaller digest of the text. rank counts them from 1, in that order, and is null
    for all others. A null or empty text has no words, no features and the weight 0. Rows that
    share a doc_id share its random part; repeated rows have neighbouring ranks. A null doc_id is hashed
    as an empty one. Empty tables of documents give an empty result; without any target text all
    target shares are equal. Extra columns are ignored.
    """
    matrix = count_matrix(docs, longest, buckets)
    aim = count_matrix(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), longest, buckets, "target")
    gains = log_gains(column_sums(matrix, buckets), column_sums(aim, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = staged(row_weights(matrix, gains).withColumn("score", F.col("weight") + gumbel), "scored")
    # A rank off by 1/10000 of all at most, so that one percent more is above the cut than is drawn.
    share = max(0.0, 1 - (percent + 1) / 100)
    n, cut = scored.where(F.col("n_words") >= min_words).agg(F.count(F.lit(1)), F.percentile_approx("score", share, 10_000)).head()
    near = (F.col("n_words") >= min_words) & (F.col("score") >= F.lit(cut if cut is not None else 0))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("digest").asc()]
    top = ranked(scored.where(near), order, "drawn")
    drawn = top.withColumn("rank", F.when(F.col("rank") < percent * n // 100, F.col("rank") + 1))
    return drawn.unionByName(scored.where(~near).withColumn("rank", F.lit(None).cast("long")))


def importance_resample(docs: DataFrame, target: DataFrame, **settings) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns, whatever their names; settings as in ``importance_ranks``.

    Texts that aren't drawn don't move: a join by doc_id and digest brings the draw to the
    documents. Rows that repeat with the same doc_id and text are drawn together; where the draw
    ends among such rows, as many of them as are drawn.
    """
    key = ["doc_id", "digest"]
    groups = staged(importance_ranks(docs, target, **settings).groupBy(*key).agg(F.count("rank").alias("drawn"), F.count(F.lit(1)).alias("copies")).where("drawn > 0"), "groups")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).select("row", F.col("row.doc_id").cast("long").alias("id"), F.xxhash64("row.text").alias("hash"))

    def of(chosen: DataFrame) -> DataFrame:
        return rows.join(chosen, rows.id.eqNullSafe(chosen.doc_id) & (rows.hash == chosen.digest), "left_semi").select("row.*")

    out = of(groups.where("drawn = copies"))
    for last in groups.where("drawn < copies").take(1):  # ranks of equal rows are neighbours: one group at most
        out = out.unionByName(of(groups.where("drawn < copies")).limit(last.drawn))
    return out
