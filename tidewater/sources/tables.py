"""Stored Parquet tables whose commits become visible at once.

A table is a folder of data folders and of manifests. A manifest names the folder of each bucket
of keys, and the one of the highest number is the table. A commit writes its data beside what
there is and then publishes one small manifest; a job that dies before that leaves the table as
it was, and the next commit removes what it left. Nothing that the last two manifests name is
ever removed, so that reads that began before a commit end well. One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET = "tidewater_bucket"


@dataclass(frozen=True)
class StoredTable:
    """``keys`` tell a row's bucket of ``buckets``; without keys there is one bucket."""

    path: str
    keys: tuple[str, ...] = ()
    buckets: int = 1

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int") if self.keys else F.lit(0)

    def read(self, spark: SparkSession, only: list[int] | None = None) -> DataFrame | None:
        """The table, or its buckets in ``only``; None before the first commit."""
        _, manifest = self._last(spark)
        if manifest is None:
            return None
        folders = [f"{self.path}/{f}" for b, f in manifest["folders"].items() if only is None or int(b) in only]
        schema = StructType.fromJson(manifest["schema"])
        return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)

    def replace(self, df: DataFrame) -> None:
        """The table is ``df`` from now on."""
        self._commit(df, None)

    def rewrite(self, df: DataFrame, buckets: list[int]) -> None:
        """The rows of ``buckets`` are those of ``df`` from now on; other buckets stay untouched."""
        self._commit(df, buckets)

    def _commit(self, df: DataFrame, touched: list[int] | None) -> None:
        spark = df.sparkSession
        number, old = self._last(spark)
        folder = f"data-{uuid.uuid4().hex}"
        # A bucket's rows come together, so that tasks don't write a file each for every bucket; large buckets are dealt over several.
        dealt = df.withColumn(BUCKET, self.bucket()).hint("rebalance", F.col(BUCKET))
        dealt.write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
        fs, root = _files(spark, self.path)
        written = [s.getPath().getName() for s in fs.listStatus(_path(spark, f"{self.path}/{folder}")) if s.isDirectory()]
        folders = {} if touched is None or old is None else {b: f for b, f in old["folders"].items() if int(b) not in touched}
        folders |= {name.split("=")[1]: f"{folder}/{name}" for name in written if name.startswith(f"{BUCKET}=")}
        self._publish(spark, number + 1, {"buckets": self.buckets, "keys": list(self.keys), "schema": df.schema.jsonValue(), "folders": folders})
        self._clean(spark, number + 1)

    def _last(self, spark: SparkSession) -> tuple[int, dict | None]:
        numbers = self._numbers(spark)
        if not numbers:
            return 0, None
        manifest = self._manifest(spark, numbers[-1])
        if (manifest["buckets"], tuple(manifest["keys"])) != (self.buckets, self.keys):
            raise ValueError(f"{self.path} has {manifest['buckets']} buckets of {manifest['keys']}")
        return numbers[-1], manifest

    def _numbers(self, spark: SparkSession) -> list[int]:
        fs, root = _files(spark, f"{self.path}/manifests")
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def _manifest(self, spark: SparkSession, number: int) -> dict:
        fs, file = _files(spark, f"{self.path}/manifests/{number:09d}.json")
        stream = fs.open(file)
        try:
            return json.loads(bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def _publish(self, spark: SparkSession, number: int, manifest: dict) -> None:
        fs, file = _files(spark, f"{self.path}/manifests/{number:09d}.json")
        draft = _path(spark, f"{self.path}/manifests/{uuid.uuid4().hex}.draft")
        out = fs.create(draft)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if fs.exists(file) or not fs.rename(draft, file):
            raise RuntimeError(f"another writer has committed number {number} of {self.path}")

    def _clean(self, spark: SparkSession, number: int) -> None:
        last = [self._manifest(spark, n) for n in self._numbers(spark)[-2:]]
        named = {f for m in last for f in m["folders"].values()}
        fs, root = _files(spark, self.path)
        for status in fs.listStatus(root):
            folder = status.getPath().getName()
            if folder.startswith("data-"):
                inside = [p.getPath() for p in fs.listStatus(status.getPath()) if p.isDirectory()]
                if not any(f"{folder}/{p.getName()}" in named for p in inside):
                    fs.delete(status.getPath(), True)
                else:
                    for p in inside:
                        if f"{folder}/{p.getName()}" not in named:
                            fs.delete(p, True)
        for old in self._numbers(spark)[:-2]:
            fs.delete(_path(spark, f"{self.path}/manifests/{old:09d}.json"), False)


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    found = _path(spark, path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found
