"""Folders of small files read once: a ledger of the files taken so far, and reading tasks dealt by bytes.

A file is known by name, length and time, so one that was rewritten is new again. A run's entries lie under its number: a run that is repeated
does not count itself as earlier, finds the same files again and replaces what it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfspark.session import materialize
from shelfspark.sinks.files import LISTING_TASKS, deal, listing, with_file_bytes
from shelfspark.sinks.tables import exists

#: Bytes of files that one task reads, about, and what opening a file counts for: 512 small files a task.
TASK_BYTES, OPEN_BYTES = 2 << 30, 4 << 20

_KEY = ["file_name", "length", "modified"]
_LEDGER = "file_name string, length bigint, modified timestamp, run bigint"


def listed(spark: SparkSession, folder: str, pattern: str = "*.json") -> DataFrame:
    """(file_name, length, modified, uri) of the files of a folder, without those below it; contents are not read, and files without any are not listed.

    The folder is listed by a task, and the listing stored: the driver of a folder of millions of files holds none of them.
    """
    files = deal(listing(spark, folder, pattern), LISTING_TASKS)
    return files.select(F.col("path").alias("file_name"), "length", "modified", F.concat("root", F.lit("/"), "path").alias("uri"))


def pending(files: DataFrame, ledger: str, run: int) -> DataFrame:
    """The listed files that no earlier run has taken. The ledger is read without an ``uri`` or content, a narrow row a file."""
    spark = files.sparkSession
    if not exists(spark, ledger):
        return files
    earlier = spark.read.schema(_LEDGER).parquet(ledger).filter(F.col("run") < run).select(*_KEY)
    return files.join(earlier, _KEY, "left_anti")


def texts(files: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """(value, source_file): the whole text of each file, read by as many tasks as the files' bytes ask for, many small files in one task."""
    planned = materialize(files, "planned")
    total = planned.agg(F.sum(F.col("length") + OPEN_BYTES)).first()[0] or 0
    dealt = planned.repartition(max(1, -(-total // task_bytes)), F.xxhash64("uri"))
    return with_file_bytes(dealt, "uri", "content").select(F.col("content").cast("string").alias("value"), F.col("file_name").alias("source_file"))


def record(files: DataFrame, ledger: str, run: int) -> None:
    """Enter the files a run has taken, once what it read from them is stored."""
    files.select(*_KEY).write.mode("overwrite").parquet(f"{ledger}/run={run}")
