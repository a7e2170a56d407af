"""The published vector index: a metadata row, and points in buckets by their id.

Every publication is a batch of its own, below it a folder for each bucket that has points. A publish checks its points
against the buckets it touches, before anything is written, and reads no others. Compaction folds buckets into a base; its rows keep the
number of the batch they came from, so that base and batches may overlap without a change to what is read: neither a lost
job nor one that runs again between the two steps does harm.

A packed form for searching can be stored under the number of the newest batch it holds; the highest one that is whole is the published version.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfspark.operators.neighbours import PackedIndex, load_packed, pack_index, store_packed
from shelfspark.operators.upsert import fold_rows
from shelfspark.session import materialize
from shelfspark.sinks.tables import children, delete, exists, move

#: Buckets of an index unless it is created with another number: a publish writes up to so many files, and rewrites or checks by bucket.
BUCKETS = 16
_META = "name string, dim int, metric string, model string, buckets int"


def ensure_index(spark: SparkSession, path: str, name: str, dim: int, model: str = "", buckets: int = BUCKETS) -> None:
    """Create the index if it is absent; an existing one must have the same dimension and model, and keeps its number of buckets."""
    meta = f"{path}/meta"
    if not exists(spark, meta):
        spark.createDataFrame([(name, dim, "cosine", model, buckets)], _META).write.parquet(meta)
        return
    found = read_meta(spark, path).first()
    if (found.dim, found.model) != (dim, model):
        raise ValueError(f"index {name} holds {found.dim}-dimensional vectors of model {found.model!r}")


def read_meta(spark: SparkSession, *paths: str) -> DataFrame:
    """The metadata rows of indexes."""
    return spark.read.schema(_META).parquet(*[f"{path}/meta" for path in paths])


def rows(spark: SparkSession, path: str, buckets: Sequence[int] | None = None) -> DataFrame | None:
    """(point_id, vector, payload, batch, layer, bucket) of base and batches, of some buckets only; None before the first publication."""
    parts = []
    for layer, kind in enumerate(("base", "points")):
        folders = [f"{path}/{kind}/{name}" for name in children(spark, f"{path}/{kind}", "=") if children(spark, f"{path}/{kind}/{name}", "bucket=")]
        if folders:
            found = spark.read.option("basePath", f"{path}/{kind}").parquet(*folders)
            parts.append(found.select("point_id", "vector", "payload", F.col("batch").cast("bigint").alias("batch"), F.lit(layer).alias("layer"), "bucket"))
    if not parts:
        return None
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return found if buckets is None else found.filter(F.col("bucket").isin(list(buckets)))


def publish(points: DataFrame, path: str, batch: int, order: Sequence[str] = ()) -> None:
    """Upsert points by id. A vector of another dimension or an id collision fails the job, and then nothing is published.

    Of several points of one id in a batch the last by ``order`` stays; without an order they are refused. Points are written beside the
    batches, checked against the rows stored in the buckets they touch, and moved to their place. Publishing a batch again replaces it.
    """
    stage(points, path, batch, order)
    place(points.sparkSession, path, batch)


def stage(points: DataFrame, path: str, batch: int, order: Sequence[str] = ()) -> None:
    """The first half of :func:`publish`: write a batch aside and check it."""
    spark = points.sparkSession
    meta = read_meta(spark, path).first()
    row, name = F.struct("vector", "payload"), F.col("payload.sub_id")
    last = F.max_by(row, F.struct(*order)) if order else F.max_by(row, F.lit(0))
    folded = points.groupBy("point_id").agg(last.alias("row"), F.min(name).alias("least"), F.max(name).alias("greatest"), F.count(F.lit(1)).alias("n"))
    one_name = F.assert_true(F.col("least") == F.col("greatest"), F.concat(F.lit("a point id stands for "), "least", F.lit(" and "), "greatest"))
    ordered = F.assert_true((F.col("n") == 1) | F.lit(bool(order)), F.concat("least", F.lit(" comes several times in a batch without an order")))
    fits = F.assert_true(F.size("row.vector") == meta.dim, F.lit(f"vector without {meta.dim} dimensions"))
    checked = folded.filter(one_name.isNull() & ordered.isNull() & fits.isNull())
    bucket = F.pmod(F.xxhash64("point_id"), F.lit(meta.buckets)).cast("int").alias("bucket")
    staging = _staging(path, batch)
    checked.select("point_id", "row.*", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(staging)
    touched = [_number(name) for name in children(spark, staging, "bucket=")]
    stored = rows(spark, path, touched) if touched else None
    if stored is not None:
        own = spark.read.parquet(staging).select("point_id", F.col("payload.sub_id").alias("own"))
        clash = (stored.filter(F.col("batch") != batch).join(own, "point_id").filter("payload.sub_id <> own")
                 .select("point_id", "payload.sub_id", "own").first())
        if clash:
            raise ValueError(f"point id {clash.point_id} stands for {clash.sub_id} and {clash.own}")


def place(spark: SparkSession, path: str, batch: int) -> None:
    """The second half of :func:`publish`: put a checked batch in its place."""
    move(spark, _staging(path, batch), f"{path}/points/batch={batch}")


def _staging(path: str, batch: int) -> str:
    return f"{path}/staging/batch={batch}"


def read_points(spark: SparkSession, path: str, columns: Sequence[str] = ("vector", "payload")) -> DataFrame:
    """The newest row of every point as a whole: vector and payload of one publication, or one of them."""
    return fold_rows(rows(spark, path).select("point_id", *columns, "batch", "layer"), ["point_id"], ["batch", "layer"])


def newest_batch(spark: SparkSession, path: str) -> int | None:
    """The highest batch that has points; compacted ones count."""
    stored = rows(spark, path)
    return None if stored is None else stored.agg(F.max("batch")).first()[0]


def compact(spark: SparkSession, path: str) -> list[int]:
    """Fold the buckets that batches have touched into the base; returns their numbers.

    The folded buckets are written beside what there is, and only then what they replace is deleted. No search may be under way on the deleted files.
    """
    batches = children(spark, f"{path}/points", "=")
    touched = sorted({_number(name) for batch in batches for name in children(spark, f"{path}/points/{batch}", "bucket=")})
    if touched:
        folds = children(spark, f"{path}/base", "fold=")
        old = [f"{path}/base/{fold}/{name}" for fold in folds for name in children(spark, f"{path}/base/{fold}", "bucket=") if _number(name) in touched]
        newest = F.max_by(F.struct("vector", "payload", "bucket", "batch"), F.struct("batch", "layer")).alias("_row")
        folded = rows(spark, path, touched).groupBy("point_id").agg(newest).select("point_id", "_row.*")
        number = max(map(_number, folds), default=-1) + 1
        folded.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/base/fold={number}")
        for gone in [*[f"{path}/points/{batch}" for batch in batches], *old]:
            delete(spark, gone)
    return touched


def _number(folder: str) -> int:
    return int(folder.split("=")[1])


def publish_packed(spark: SparkSession, path: str, pivots: int | None = None) -> int:
    """Pack the points as they are and publish them as a version: the number of their newest batch. A version that is there already is left as it is."""
    version = newest_batch(spark, path)
    if version is None:
        raise ValueError("the index holds no points")
    if not exists(spark, f"{path}/packed/version={version}/ready"):
        packed = pack_index(materialize(read_points(spark, path, ["vector"]).select("point_id", "vector"), "points"), pivots)
        if packed is None:
            raise ValueError("the index holds no usable vectors")
        store_packed(packed, f"{path}/packed/version={version}")
        spark.range(1).write.mode("overwrite").parquet(f"{path}/packed/version={version}/ready")
    return version


def packed_version(spark: SparkSession, path: str) -> int | None:
    """The published version: the highest one that is whole."""
    found = [_number(name) for name in children(spark, f"{path}/packed", "version=") if exists(spark, f"{path}/packed/{name}/ready/_SUCCESS")]
    return max(found, default=None)


def read_packed(spark: SparkSession, path: str, version: int) -> PackedIndex:
    return load_packed(spark, f"{path}/packed/version={version}")
