"""Parquet sinks whose reruns replace what the same run or batch wrote before."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from shelfspark.operators.ranking import rank_in_group
from shelfspark.operators.upsert import absent_from, fold_changes, one_per_key


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, asked of the file system it lives on."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def children(spark: SparkSession, path: str, mark: str = "") -> list[str]:
    """Names of the folders below ``path`` that hold ``mark``, in order; none if there is no such path."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(target):
        return []
    return sorted(s.getPath().getName() for s in system.listStatus(target) if s.isDirectory() and mark in s.getPath().getName())


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder that no frame reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def move(spark: SparkSession, path: str, to: str) -> None:
    """Put a written folder in the place of another of the same file system."""
    source, target = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, to))
    system = source.getFileSystem(spark._jsc.hadoopConfiguration())
    system.delete(target, True)
    system.mkdirs(target.getParent())
    if not system.rename(source, target):
        raise OSError(f"{path} could not be moved to {to}")


def append_stage(df: DataFrame, root: str, stage: str, run_id: str) -> str:
    """Store the metadata of a stage without image bytes; a rerun of ``run_id`` replaces its own rows only."""
    df.drop("image_data", "data").write.mode("overwrite").parquet(f"{root}/{stage}/run_id={run_id}")
    return f"{root}/{stage}"


def write_content(df: DataFrame, root: str, run_id: str, path_column: str, bytes_columns: Sequence[str]) -> str:
    """Store bytes beside their path as a content table; rows without bytes have nothing to store.

    Files are cut by record count so that one of them stays within reach of one task.
    """
    columns = [F.col(path_column).alias("path"), *bytes_columns]
    stored = df.filter(F.col(path_column).isNotNull() & F.col(bytes_columns[-1]).isNotNull()).select(*columns)
    stored.write.mode("overwrite").option("maxRecordsPerFile", 20_000).parquet(f"{root}/run_id={run_id}")
    return root


def insert_absent(df: DataFrame, path: str, keys: Sequence[str], run_id: str, order: Sequence[str] = ()) -> str:
    """Append rows whose key no earlier run stored; of several with one key the first by ``order`` (all columns without it)."""
    spark = df.sparkSession
    if exists(spark, path):
        # With the schema given, a run id that looks like a number stays the text it is.
        stored = spark.read.schema(T.StructType([*df.schema, T.StructField("run_id", T.StringType())])).parquet(path)
        earlier = stored.filter(F.col("run_id") != run_id)
        df = absent_from(df, earlier, keys)
    one_per_key(df, keys, order).write.mode("overwrite").parquet(f"{path}/run_id={run_id}")
    return path


def log_changes(df: DataFrame, path: str, batch: int, order: Sequence[str] = ()) -> None:
    """Add one batch to a change log; writing the batch again replaces it, so replays are harmless.

    Several changes of one key in a batch need an order: the columns ``order``, by which rows are numbered (column ``seq``), or a ``seq`` of
    the caller's. How a frame happens to lie is no order; without one such changes are refused when the log is folded (:func:`current`).
    """
    numbered = rank_in_group(df, [], order, "seq") if order else df
    numbered.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(path)


def current(spark: SparkSession, path: str, keys: Sequence[str], version: Sequence[str] = ("batch", "seq")) -> DataFrame:
    """The log folded to one row per key: the newest non-null value of every column.

    Changes are ordered by batch and ``seq`` in it, or by ``version`` where the rows say themselves which is newer.
    """
    changes = read_changes(spark, path)
    if "seq" not in changes.columns:
        changes = changes.withColumn("seq", F.lit(None).cast("bigint"))
    if "seq" in version:
        unordered = changes.filter("seq IS NULL").groupBy(*keys, "batch").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").first()
        if unordered:
            raise ValueError(f"{unordered.n} changes of one key in batch {unordered.batch} without an order: {unordered.asDict()}")
    return fold_changes(changes.drop(*{"batch", "seq"}.difference(version)), keys, version)


def save_state(state: DataFrame, path: str, run: int) -> None:
    """Keep the resume state of a run: one row per key, only what changed."""
    log_changes(state, path, run)


def load_state(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame | None:
    """The resume state after all saved runs; None before the first."""
    return current(spark, path, keys) if exists(spark, path) else None


def compact(spark: SparkSession, path: str, keys: Sequence[str], into: str) -> None:
    """Write the folded log as the first batch of a new log at ``into``."""
    log_changes(current(spark, path, keys), into, 0)
