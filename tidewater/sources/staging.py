"""Intermediate tables in the folder that a cluster's driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, for this application; removed when the driver's JVM ends.

    Where the setting is unset, a local session gets a temporary folder; on a cluster that
    would lose data, so it is an error there.
    """
    context = spark.sparkContext
    if context.applicationId in _made:
        return _made[context.applicationId]
    root = context.getConf().get("spark.checkpoint.dir")
    if not root:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidewater-")
    folder = f"{root.rstrip('/')}/tidewater-{context.applicationId}"
    fs, path = _files(spark, folder)
    fs.mkdirs(path)
    # The file system does this as the JVM ends, whether or not the session was stopped before.
    fs.deleteOnExit(path)
    _made[context.applicationId] = folder
    return folder


def _files(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: lineage ends there, and executors may be lost."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    vars(out)["_staged_at"] = path
    return out


def kept_at(df: DataFrame, path: str) -> DataFrame:
    """``df`` as the table at ``path``: written there, or, where an earlier run has written it whole, read without being computed."""
    fs, marker = _files(df.sparkSession, f"{path}/_SUCCESS")
    if not fs.exists(marker):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unstaged(*tables: DataFrame) -> None:
    """Removes staged tables that nothing will read any more; others are left alone."""
    for df in tables:
        if "_staged_at" in vars(df):
            fs, folder = _files(df.sparkSession, vars(df)["_staged_at"])
            fs.delete(folder, True)
