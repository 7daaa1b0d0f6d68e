"""Documents as files: a data source that writes one file for each row, all of them or none, and a listing made in tasks."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import BinaryType, StructType

from tidewater.sources.staging import staged, unstaged

#: Files that are renamed at a time as a job is committed.
MOVERS = 16
#: Tasks that read stored files, for each core.
READERS = 4
#: Names of a folder that go to Spark at a time, and bytes of contents that a task holds before they do.
NAMES, HELD = 10_000, 4 << 20


@dataclass
class Written(WriterCommitMessage):
    """What one task wrote, below the folder's incoming place."""

    part: str
    files: int


class DocumentWriter(DataSourceArrowWriter):
    """Each task writes into a place of its own; the commit renames the files of the tasks that count into the folder.

    A task that dies leaves its place to be removed with the job's, and a job that fails leaves nothing.
    The driver sees names, one task's at a time, and no contents.
    """

    def __init__(self, folder: str) -> None:
        self.folder = folder
        self.incoming = f".incoming-{uuid.uuid4().hex}"

    def _root(self) -> tuple[fs.FileSystem, str]:
        files, root = fs.FileSystem.from_uri(self.folder)
        return files, root.rstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = self._root()
        part, n, made = uuid.uuid4().hex, 0, set()
        for batch in iterator:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                name = path.as_py()
                steps = name.split("/") if name else [""]
                if any(s in ("", ".", "..") for s in steps):
                    raise ValueError(f"not a path below the folder: {name!r}")
                place = f"{root}/{self.incoming}/{part}/{name}"
                if (parent := place.rsplit("/", 1)[0]) not in made:
                    files.create_dir(parent, recursive=True)
                    made.add(parent)
                with files.open_output_stream(place) as sink:
                    sink.write(content.as_buffer() if content.is_valid else b"")
                n += 1
        return Written(part, n)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = self._root()
        with ThreadPoolExecutor(MOVERS) as pool:
            for message in messages:
                if message is not None and message.files:
                    base = f"{root}/{self.incoming}/{message.part}/"
                    found = [x for x in files.get_file_info(fs.FileSelector(base, recursive=True)) if x.type == fs.FileType.File]
                    names = [x.path[x.path.index(f"{message.part}/") + len(message.part) + 1 :] for x in found]
                    for parent in {n.rsplit("/", 1)[0] for n in names if "/" in n}:
                        files.create_dir(f"{root}/{parent}", recursive=True)
                    list(pool.map(lambda n, base=base: files.move(base + n, f"{root}/{n}"), names))
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        files, root = self._root()
        if files.get_file_info(f"{root}/{self.incoming}").type == fs.FileType.Directory:
            files.delete_dir(f"{root}/{self.incoming}")


class DocumentFiles(DataSource):
    """Rows (path string, content binary) as files below ``path``, an address that all executors share."""

    @classmethod
    def name(cls) -> str:
        return "document_files"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> DocumentWriter:
        if sorted(schema.names) != ["content", "path"]:
            raise ValueError(f"document files have a path and a content, not {schema.names}")
        return DocumentWriter(self.options["path"])


def write_documents(df: DataFrame, folder: str, path: str = "path", content: str = "content") -> None:
    """Writes ``content`` of each row to ``path`` below ``folder``: all files appear, or none does.

    A file that is there already gives way. A null content is an empty file; a path that leaves the
    folder is an error. Rows should have different paths: of several, one is kept.
    """
    spark = df.sparkSession
    spark.dataSource.register(DocumentFiles)
    df.select(F.col(path).alias("path"), F.col(content).cast("binary").alias("content")).write.format(DocumentFiles.name()).mode("append").save(folder)


def _hidden(name: str) -> bool:
    """As Spark's readers see it."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _children(root: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(path) of folders below ``root`` to (path, length, folder) of what is in them, hidden names left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(root)
        base = base.rstrip("/")
        for batch in batches:
            for name in batch.column("path").to_pylist():
                inside = f"{name}/" if name else ""
                found = [x for x in files.get_file_info(fs.FileSelector(f"{base}/{name}")) if not _hidden(x.base_name)]
                for start in range(0, len(found), NAMES):
                    some = found[start : start + NAMES]
                    parts = [pa.array([inside + x.base_name for x in some]), pa.array([x.size or 0 for x in some], pa.int64()), pa.array([x.type == fs.FileType.Directory for x in some])]
                    yield pa.RecordBatch.from_arrays(parts, ["path", "length", "folder"])

    return run


def _listing(spark: SparkSession, root: str, tasks: int) -> DataFrame:
    """(path, length) of the files below ``root``, as a staged table dealt over ``tasks`` files. Each level of folders is listed at once, a folder in one task."""
    level, levels = spark.createDataFrame([("",)], "path string"), []
    while not level.isEmpty():
        levels.append(staged(level.repartition(tasks).mapInArrow(_children(root), "path string, length long, folder boolean"), "level"))
        level = levels[-1].where("folder").select("path")
    files = reduce(DataFrame.unionByName, levels).where("NOT folder AND length > 0").select("path", "length")
    listed = staged(files.repartition(tasks), "listing")
    unstaged(*levels)
    return listed


def _content(root: str, path: Column) -> Column:
    """The bytes of the file at ``path`` below ``root``, a few files at a time, however many paths a batch has."""

    @F.pandas_udf(BinaryType())
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        files, base = fs.FileSystem.from_uri(root)
        base = base.rstrip("/")
        for names in batches:
            held, size = [], 0
            for name in names:
                with files.open_input_stream(f"{base}/{name}") as source:
                    held.append(source.read())
                size += len(held[-1])
                if size > HELD:
                    yield pd.Series(held, dtype=object)
                    held, size = [], 0
            if held:
                yield pd.Series(held, dtype=object)

    return read(path)


def stored_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, content) of the files below ``folder``, paths relative to it, as they are now; contents are read only where they are used.

    Tasks list the folder and read the files: of neither names nor contents anything is held by the driver.
    A folder that isn't there is empty. Hidden files and those without a byte aren't listed. Joins with
    the list are sort merges: names take little room in a file, by which Spark would choose to broadcast them, and much in the driver's memory.
    """
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(place):
        return spark.createDataFrame([], "path string, length long, content binary")
    uri = system.resolvePath(place).toUri()
    root = uri.getPath() if uri.getScheme() == "file" else folder
    tasks = READERS * spark.sparkContext.defaultParallelism
    return _listing(spark, root, tasks).coalesce(tasks).select("path", "length", _content(root, F.col("path")).alias("content")).hint("merge")
