"""Files under names of their own, written, listed and read by tasks in a folder that all executors share."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from shelfspark.session import materialize

#: Spark puts about 32 small files in a task; folders of very many are listed, or read with their contents, by so many tasks at most.
LISTING_TASKS, CONTENT_TASKS = 200, 1000
#: Files of a listing that a task holds at once.
LISTED_ROWS = 10_000

_FOUND = "root string, path string, length bigint, modified bigint, folder boolean"


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or of an absolute path; local ones are taken as Spark names them, with no sign of theirs decoded."""
    if (local := re.sub("^file:/*", "/", uri)).startswith("/"):
        return fs.LocalFileSystem(), local.rstrip("/") or "/"
    return fs.FileSystem.from_uri(uri)


def _hidden(name: str) -> bool:
    """Names that Spark's readers leave out."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _entries(store: fs.FileSystem, path: str) -> Iterator[tuple[str, int, int, bool]]:
    """(name, length, time of change in ms, whether it is a folder) of what lies in a folder; the name of a file itself is empty.

    A local folder is gone through with nothing held; of another store's the task holds the listing.
    """
    if isinstance(store, fs.LocalFileSystem):
        if not os.path.isdir(path):
            stat = os.stat(path)
            yield "", stat.st_size, stat.st_mtime_ns // 10**6, False
            return
        with os.scandir(path) as found:
            for entry in found:
                try:
                    stat = entry.stat()
                except FileNotFoundError:  # a link to nothing, or a file that went meanwhile
                    continue
                yield entry.name, stat.st_size, stat.st_mtime_ns // 10**6, entry.is_dir()
        return
    own = store.get_file_info(path)
    for info in [own] if own.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path)):
        yield "" if info is own else info.base_name, info.size or 0, (info.mtime_ns or 0) // 10**6, info.type == fs.FileType.Directory


def listing(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """(root, path, length, modified) of the files of a folder, or below it, whose names match; ``path`` is relative to ``root``.

    The listing is made by tasks, folder by folder and level by level, and stored; neither a name nor a task per file reaches the driver. As with
    Spark's own sources ``folder`` may be a glob, and hidden names (dot, underscore) and files without content are not listed.
    """
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    roots = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target)
    if not roots:
        raise AnalysisException(f"[PATH_NOT_FOUND] Path does not exist: {folder}.")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*held, strict=True)) or [()] * 5
            held.clear()
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                              names=["root", "path", "length", "modified", "folder"])

        for batch in batches:
            for root, path in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                for name, length, modified, is_folder in _entries(*located(f"{root}/{path}")):
                    if not _hidden(name) and (recursive or not is_folder):
                        held.append((root, "/".join(filter(None, (path, name))), length, modified, is_folder))
                    if len(held) >= LISTED_ROWS:
                        yield flush()
        yield flush()

    start = [(s.getPath().getParent().toString().rstrip("/"), s.getPath().getName()) if s.isFile() else (s.getPath().toString().rstrip("/"), "")
             for s in roots]
    level, files = spark.createDataFrame(start, "root string, path string"), []
    while True:
        found = materialize(level.mapInArrow(scan, _FOUND), "listing")
        files.append(found.filter("NOT folder AND length > 0").drop("folder"))
        below = found.filter("folder").select("root", "path")
        n = below.count() if recursive else 0
        if not n:
            break
        level = below.repartition(min(n, LISTING_TASKS))
    glob = spark._jvm.org.apache.hadoop.fs.GlobPattern(pattern).compiled().pattern()
    named = reduce(DataFrame.unionByName, files).filter(F.element_at(F.split("path", "/"), -1).rlike(rf"(?s)\A(?:{glob})\z"))
    return named.withColumn("modified", F.timestamp_millis("modified"))


def deal(files: DataFrame, most: int) -> DataFrame:
    """A stored listing dealt to as many tasks as Spark's own sources would have for the files, and at most ``most``."""
    spark = files.sparkSession
    conf = spark._jsparkSession.sessionState().conf()
    opening = conf.filesOpenCostInBytes()
    total = files.agg(F.sum(F.col("length") + opening)).first()[0] or 0
    a_task = min(conf.filesMaxPartitionBytes(), max(opening, total // spark.sparkContext.defaultParallelism))
    return files.repartition(max(1, min(most, -(-total // a_task))))


def write_files(df: DataFrame, folder: str, name: str, content: str) -> int:
    """One file per row below ``folder``; returns their number. Rows without name or content have nothing to write.

    A file gets its name when it is whole, so attempts that were lost leave no half files, and one that runs again writes the same.
    """
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    wanted = df.select(F.col(name).alias("name"), F.col(content).cast("binary").alias("content")).filter("name IS NOT NULL AND content IS NOT NULL")
    # Dealt by number: a table of few row groups would have its files written by few tasks, one after the other.
    wanted = wanted.repartition(tasks, F.xxhash64("name"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = located(folder)
        attempt, n, known = TaskContext.get().taskAttemptId(), 0, set()
        for batch in batches:
            for name_, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                path = f"{root}/{name_}"
                if (parent := path.rsplit("/", 1)[0]) not in known:
                    store.create_dir(parent, recursive=True)
                    known.add(parent)
                with store.open_output_stream(f"{path}.{attempt}.part") as out:
                    out.write(data.as_buffer())
                store.move(f"{path}.{attempt}.part", path)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    return wanted.mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def with_file_bytes(df: DataFrame, uri: str, bytes_column: str, flush_bytes: int = 32 << 20, root: str | None = None) -> DataFrame:
    """``df`` with the content of the file that column ``uri`` names, null where it names none; read where the row lies.

    Where column ``root`` names a folder, ``uri`` is a path below it, of any signs.
    """
    at, below = df.columns.index(uri), None if root is None else df.columns.index(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stores: dict[str, tuple[fs.FileSystem, str]] = {}
        for batch in batches:
            start, held, size = 0, [], 0
            folders = [None] * batch.num_rows if below is None else batch.column(below).to_pylist()
            for k, (place, folder) in enumerate(zip(batch.column(at).to_pylist(), folders, strict=True)):
                data = None
                if place is not None:
                    if folder is None:
                        store, path = located(place)
                    else:
                        if folder not in stores:
                            stores[folder] = located(folder)
                        store, path = stores[folder][0], f"{stores[folder][1].rstrip('/')}/{place}"
                    with store.open_input_file(path) as file:
                        data = file.read()
                held.append(data)
                size += len(data or b"")
                if size >= flush_bytes or k == batch.num_rows - 1:
                    part = batch.slice(start, len(held))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(held, pa.binary())], names=[*part.schema.names, bytes_column])
                    start, held, size = k + 1, [], 0

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(bytes_column, BinaryType())]))
