"""License scans by canonical digest lookup: whole texts, and single lines, against known digests."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.licence_texts import EQUIVALENTS, LICENCES, NOTICES
from tidewater.llm.shared import own

#: Longest catalogue that is broadcast; a longer one is joined by shuffling.
MAX_BROADCAST_ROWS = 100_000
#: A line that begins with a copyright statement, behind any comment marks.
COPYRIGHT_LINE = r"\n[\x20\t/*#;>.-]*(copyright[\x20\t:,]*(\(c\)|©|[0-9]{4}|<|\[)|\(c\)[\x20\t]*(copyright|[0-9]{4})|©|all rights reserved)[^\n]*"
NOT_WORDS = r"[^\p{L}\p{N}]+"
#: Any of the spellings that are replaced; a look at the first letter passes over most words.
_VARIANTS = " (?=[" + "".join(sorted({ours[0] for ours, _ in EQUIVALENTS})) + "])(?:" + "|".join(ours.replace(" ", "  ") for ours, _ in EQUIVALENTS) + ") "
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words that a replacement may bring about, or that a spelling of several words covers; their spellings are looked for in every text that has a variant.
_COVERED = {w for _, theirs in EQUIVALENTS for w in theirs.split()} | {w for ours, _ in EQUIVALENTS if " " in ours for w in ours.split()}


def _lower(text: Column) -> Column:
    """``text`` with A-Z lower-cased, by the faster function where there are no other letters to change."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def canonical(text: Column) -> Column:
    """A text without case, copyright lines and punctuation, in one spelling; each word between single blanks of its own.

    A text is searched once for all spellings, and only those that it has are replaced.
    """
    lower = F.concat(F.lit("\n"), _lower(text))
    words = F.concat(F.lit(" "), F.regexp_replace(F.regexp_replace(lower, COPYRIGHT_LINE, "\n"), NOT_WORDS, "  "), F.lit(" "))
    blank = lambda x: F.lit(f" {x.replace(' ', '  ')} ")
    spellings = F.array(*[F.struct(blank(ours).alias("ours"), blank(theirs).alias("theirs"), F.lit(" " in ours or ours in _COVERED).alias("covered")) for ours, theirs in EQUIVALENTS])

    def spelled(x: Column) -> Column:
        due = F.filter(spellings, lambda s: F.array_contains(x["said"], s["ours"]) | (s["covered"] & (F.size(x["said"]) > 0)))
        return F.trim(F.aggregate(due, x["words"], lambda out, s: F.replace(out, s["ours"], s["theirs"])))

    said = F.transform(F.array(words), lambda w: F.struct(w.alias("words"), F.regexp_extract_all(w, F.lit(_VARIANTS), F.lit(0)).alias("said")))
    return F.get(F.transform(said, spelled), F.lit(0))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def catalogue(spark: SparkSession, texts: Iterable[tuple[str, str]]) -> DataFrame:
    """(digest, license) of known texts; of one digest under two identifiers, the first in order. Broadcast while it is short."""
    known = list(texts)
    rows = spark.createDataFrame(known, "license string, text string")
    named = rows.groupBy(digest(F.col("text")).alias("digest")).agg(F.min("license").alias("license"))
    return F.broadcast(named) if len(known) <= MAX_BROADCAST_ROWS else named


def license_scan(docs: DataFrame, licences: Iterable[tuple[str, str]] = LICENCES, notices: Iterable[tuple[str, str]] = NOTICES) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text, any more): doc_id, digest, license, notices, n_notices.

    digest: SHA-256 of the whole text's canonical form. license: the known licence with that
    digest, else null. notices: identifiers, each once and in order, comma-joined, of the
    licences that a line names whose own canonical digest is known; n_notices counts such
    lines. Both are hash joins with catalogues of digests. Lines without "licen" in any case are
    never notices. A null text counts as empty, and an empty canonical form is no licence.
    Repeated rows get the same result each; extra columns are ignored.
    """
    spark = docs.sparkSession
    rows = own(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("key"))
    said = F.posexplode(F.filter(F.split("text", "\n"), lambda x: F.lower(x).contains("licen")))
    lines = rows.where(F.col("text").rlike("(?i)licen")).select("doc_id", "key", said.alias("pos", "line")).select("doc_id", "key", "pos", digest(F.col("line")).alias("digest"))
    hits = lines.join(catalogue(spark, notices), "digest")
    # By text, so that repeated rows are counted once, and found again together.
    named = hits.groupBy(F.col("doc_id").alias("_doc"), F.col("key").alias("_key")).agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("notices"), F.countDistinct("pos").alias("n_notices"))
    whole = rows.select("doc_id", "key", digest(F.col("text")).alias("digest")).join(catalogue(spark, licences), "digest", "left")
    joined = whole.join(named, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_key")), "left")
    return joined.select("doc_id", "digest", "license", F.coalesce("notices", F.lit("")).alias("notices"), F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"))
