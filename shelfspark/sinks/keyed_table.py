"""Tables of one row per key in buckets by the key, of which a run reads and writes those that its own keys fall into.

A run's files lie below its number, a folder for each bucket it touched, and are never changed by another run. A merge writes its touched buckets anew,
so a bucket is what the newest whole run that has it says; an insertion adds rows only, so a bucket is what all runs together say. A run
that is repeated sees the runs before it and replaces its own files; one that is lost leaves nothing that is read.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfspark.operators.upsert import absent_from, fold_changes, one_per_key, upsert
from shelfspark.session import materialize
from shelfspark.sinks.tables import children, delete, exists

_META = "keys array<string>, buckets int, merged boolean"


def create(spark: SparkSession, path: str, keys: Sequence[str], buckets: int, merged: bool = True) -> None:
    """Lay down a table unless it is there. A bucket is written by one task, so ``buckets`` goes by the size that the table will have.

    Its rows are merged by key, or with ``merged`` false only inserted.
    """
    if not exists(spark, f"{path}/meta/_SUCCESS"):
        spark.createDataFrame([(list(keys), buckets, merged)], _META).coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def _meta(spark: SparkSession, path: str):
    return spark.read.schema(_META).parquet(f"{path}/meta").first()


def _runs(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n.split("=")[1]) for n in children(spark, f"{path}/rows", "run=") if exists(spark, f"{path}/rows/{n}/_SUCCESS"))


def _folders(spark: SparkSession, path: str, merged: bool, before: int | None = None, only: Sequence[int] | None = None) -> list[str]:
    """Folders of the buckets as the runs before ``before`` left them."""
    current: dict[object, str] = {}
    for run in _runs(spark, path):
        if before is None or run < before:
            for name in children(spark, f"{path}/rows/run={run}", "bucket="):
                bucket = int(name.split("=")[1])
                if only is None or bucket in only:
                    current[bucket if merged else (run, bucket)] = f"{path}/rows/run={run}/{name}"
    return list(current.values())


def read(spark: SparkSession, path: str, before: int | None = None, only: Sequence[int] | None = None) -> DataFrame | None:
    """The rows, of some buckets only and as they were before a run if asked for, with column ``run``; None where there are none.

    The folders are listed once, when this is called; later runs do not change what the frame says.
    """
    folders = _folders(spark, path, _meta(spark, path).merged, before, only)
    if not folders:
        return None
    return spark.read.option("basePath", f"{path}/rows").option("mergeSchema", True).parquet(*folders).drop("bucket")


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    known = F.assert_true(reduce(and_, [F.col(k).isNotNull() for k in keys]), F.lit("a row without a key"))
    return F.when(known.isNull(), F.pmod(F.xxhash64(*keys), F.lit(buckets))).cast("int")


def _dealt(new: DataFrame, keys: Sequence[str], buckets: int) -> tuple[DataFrame, list[int]]:
    """Rows stored with their bucket, and the numbers of the buckets, which are no more than the table has."""
    dealt = materialize(new.withColumn("bucket", _bucket(keys, buckets)), "dealt")
    return dealt, sorted(r.bucket for r in dealt.select("bucket").distinct().collect())


def _write(df: DataFrame, path: str, run: int) -> None:
    df.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows/run={run}")


def merge(new: DataFrame, path: str, run: int, version: Sequence[str] = ()) -> list[int]:
    """Upsert rows by key and return the numbers of the buckets that were rewritten.

    Non-null fields override, absent ones survive, unknown keys are added. Several changes of one key are folded by ``version``, and refused without
    one, as are rows without a key.
    """
    spark = new.sparkSession
    meta = _meta(spark, path)
    if version:
        changes = fold_changes(new, meta["keys"], version)
    else:
        rest = [c for c in new.columns if c not in meta["keys"]]
        counted = new.groupBy(*meta["keys"]).agg(F.max_by(F.struct(*rest, F.lit(0).alias("_")), F.lit(0)).alias("_row"), F.count(F.lit(1)).alias("_n"))
        single = F.assert_true(F.col("_n") == 1, F.lit("several changes of one key without an order"))
        changes = counted.filter(single.isNull()).select(*meta["keys"], *[F.col(f"_row.{c}").alias(c) for c in rest])
    dealt, touched = _dealt(changes, meta["keys"], meta.buckets)
    stored = read(spark, path, before=run, only=touched)
    if stored is not None:
        dealt = upsert(stored.drop("run"), dealt.drop("bucket"), meta["keys"]).withColumn("bucket", _bucket(meta["keys"], meta.buckets))
    _write(dealt, path, run)
    return touched


def insert(new: DataFrame, path: str, run: int, order: Sequence[str] = ()) -> list[int]:
    """Add rows whose key no earlier run has, of several the first by ``order``; returns the numbers of the buckets that were looked into.

    Of the stored rows only the keys are read, and only in the buckets of new keys.
    """
    spark = new.sparkSession
    meta = _meta(spark, path)
    dealt, touched = _dealt(one_per_key(new, meta["keys"], order), meta["keys"], meta.buckets)
    stored = read(spark, path, before=run, only=touched)
    _write(dealt if stored is None else absent_from(dealt, stored, meta["keys"]), path, run)
    return touched


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete the folders that newer runs have replaced and return their number. No frame may be reading them, and no run before the newest be repeated."""
    if not _meta(spark, path).merged:
        return 0
    current = set(_folders(spark, path, True))
    found = [f"{path}/rows/run={run}/{name}" for run in _runs(spark, path) for name in children(spark, f"{path}/rows/run={run}", "bucket=")]
    old = [folder for folder in found if folder not in current]
    for folder in old:
        delete(spark, folder)
    return len(old)
