"""A corpus from raw documents to piece ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; between stages the rows are
written as Parquet and read again. Every stage takes an empty table to an empty result and
ignores columns beyond those of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidewater.llm.mixing import mixed
from tidewater.llm.near_dedup import drop_near_duplicates
from tidewater.llm.pii import redact_pii
from tidewater.llm.quality import keep_good
from tidewater.llm.sentencepiece_codec import encode_pieces
from tidewater.llm.shared import documents, staged

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: SQL can express neither the line labels nor the pieces: the stages are tested against brute force instead.
ORACLE_SQL: str | None = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; null and empty texts are among them. Repeated rows share a verdict."""
    return keep_good(docs.select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, similarity 0.8 or more.

    Of repeated rows one stays; rows without doc_id, and texts without words, stay all.
    """
    return drop_near_duplicates(docs.select(*COLUMNS), words=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to their kinds in angle brackets; null texts stay null, repeated rows stay."""
    return redact_pii(docs.select(*COLUMNS))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stands as often as the mix takes it; those without words are never taken, a null source is one of its own."""
    return mixed(docs.select(*COLUMNS), weights=(5, 2, 1), share=1.5, most=2)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text; none of a null or empty one. Repeated rows stay."""
    return encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("personal data", personal_data),
    ("mixing", mixture),
    ("sentencepiece", pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
