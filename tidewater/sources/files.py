"""Files: JSON envelopes, CSV with sorted headers, binary content, and the JSON columns of stored rows."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from tidewater.functions.text import strip_script
from tidewater.operators.ranks import ranked

MAX_BYTES = 25 * 1024 * 1024
QUEUE = (
    "insurer_id string, insurer_name string, document_id string, document_type string, product_id string, product_name string, "
    "source_url string, page_url string, anchor_text string, discovery_method string, extension string"
)


def json_sorted(entries: Column) -> Column:
    """A map as JSON with its keys in order; null stays null."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries))))


def json_or(text: Column, schema: str, default: Column) -> Column:
    """Parsed JSON, or the default where it is null, empty or malformed."""
    return F.coalesce(F.from_json(text, schema), default)


def sorted_columns(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in sorted(df.columns)])


def key_union(maps: DataFrame, column: str) -> DataFrame:
    """(pos, key): the sorted distinct keys of a map column."""
    keys = maps.select(F.explode(F.map_keys(column)).alias("key")).distinct().agg(F.array_sort(F.collect_list("key")).alias("keys"))
    return keys.select(F.posexplode("keys").alias("pos", "key"))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a sorted header; nulls become empty."""
    sorted_columns(df).na.fill("").write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').schema(schema).csv(path)


def write_json(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).json(path)


def envelope(records: DataFrame, stamp: str, label: str, order: str, **more: Column) -> DataFrame:
    """One JSON document around all records: a stamp, their number, and the records in order. Only for records that fit one document."""
    body = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*[F.col(f"`{c}`") for c in records.columns if c != order]).alias("r")))), lambda x: x["r"])
    parts = [F.lit(stamp).alias("generated_at"), F.count(F.lit(1)).alias("record_count"), *[c.alias(n) for n, c in more.items()], body.alias(label)]
    return records.agg(*parts)


def write_envelope(records: DataFrame, path: str, stamp: str, label: str, order: list[str]) -> None:
    """One JSON document around all records, in order, as the parts of a folder, whatever their number.

    The parts' lines, put one after the other, are what ``envelope`` would give: a first line with the stamp and the
    number of records, a line for each record, and a last one that closes. Records are dealt
    by ranges of ``order``, so that no task holds them all.
    """
    body = F.to_json(F.struct(*[F.col(f"`{c}`") for c in records.columns]))
    lines = ranked(records.select(*order, body.alias("record")), [F.col(c) for c in order], "envelope")
    n = lines.count()
    head = json.dumps({"generated_at": stamp, "record_count": n})[:-1] + f', "{label}": ['
    ends = records.sparkSession.createDataFrame([(-1, head), (n, "]}")], "rank long, line string")
    each = lines.select("rank", F.concat(F.when(F.col("rank") > 0, ",").otherwise(""), "record").alias("line"))
    parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends.unionByName(each).repartitionByRange(parts, "rank").sortWithinPartitions("rank").select("line").write.mode("overwrite").text(path)


def read_envelope(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The records of a folder that ``write_envelope`` has written, each line by itself."""
    record = F.regexp_replace("value", "^,", "")
    inside = ~(F.col("value").startswith('{"generated_at": ') & F.col("value").endswith("[")) & (F.col("value") != "]}")
    return spark.read.text(path).where(inside).select(F.from_json(record, schema).alias("r")).select("r.*")


def _in_parts(spark: SparkSession, path: str) -> bool:
    parts = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/part-*.txt")
    return len(parts.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(parts) or []) > 0


def read_queue(spark: SparkSession, path: str) -> DataFrame:
    """Queue entries of an envelope: one file, or the parts that ``write_envelope`` has written."""
    if _in_parts(spark, path):
        return _filled(read_envelope(spark, path, QUEUE))
    return queue_entries(spark.read.option("multiLine", True).schema(f"documents array<struct<{QUEUE.replace(' string', ':string')}>>").json(path))


def queue_entries(envelopes: DataFrame) -> DataFrame:
    """The name falls back on the id, and an empty product is none."""
    return _filled(envelopes.select(F.explode("documents").alias("d")).select("d.*"))


def _filled(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"insurer_name": F.coalesce("insurer_name", "insurer_id"), "product_id": F.nullif("product_id", F.lit(""))})


def file_listing(spark: SparkSession, path: str) -> DataFrame:
    """(path) of the files below a folder; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")


def within_size(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Files (path, length, content) up to the size limit; of others not a byte is read."""
    return files.where(F.col("length") <= max_bytes)


def file_hashes(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, content_hash) of files up to the size limit."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return within_size(files, max_bytes).select("path", F.sha2("content", 256).alias("content_hash"))


def text_of(path: Column, content: Column, extractors: dict[str, Callable[[bytes], str]] | None = None) -> Column:
    """A file's text by its suffix; empty where there is no extractor or it fails.

    By default ``.pdf`` is read with pdfminer where that is installed.
    """
    chosen = dict(extractors) if extractors is not None else _pdf_extractor()

    @F.pandas_udf(StringType())
    def run(path: pd.Series, content: pd.Series) -> pd.Series:
        def one(p: str, c: bytes) -> str:
            reader = chosen.get("." + p.rsplit(".", 1)[-1].lower())
            try:
                return reader(c) if reader and c is not None else ""
            except Exception:  # noqa: BLE001 - a broken file has no text
                return ""

        return pd.Series([one(p, c) for p, c in zip(path, content, strict=True)])

    return strip_script(run(path, content))


def extract_text(files: DataFrame, extractors: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """(path, content) to (path, extracted_text)."""
    return files.select("path", text_of(F.col("path"), F.col("content"), extractors).alias("extracted_text"))


def _pdf_extractor() -> dict[str, Callable[[bytes], str]]:
    try:
        from io import BytesIO

        from pdfminer.high_level import extract_text as read
    except ImportError:
        return {}
    return {".pdf": lambda content: read(BytesIO(content))}
