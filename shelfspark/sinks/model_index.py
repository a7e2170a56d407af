"""Vectors of several models side by side, for a change of the embedding model or a fallback to another one.

Each registered model has a part of its own, a vector index (:mod:`~shelfspark.sinks.vector_index`) of its dimension, and all parts share the ids
of their points. Queries name the model that made them and meet its part only, for scores of different models say nothing about each other.
Work per model is started in a loop over the registered models, of which there are a handful; rows never pass through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from shelfspark.operators import neighbours
from shelfspark.session import scratch_path
from shelfspark.sinks import vector_index
from shelfspark.sinks.tables import children


def part_path(path: str, model: str) -> str:
    return f"{path}/parts/m-{quote(model, safe='')}"


def register(spark: SparkSession, path: str, model: str, dim: int, buckets: int = vector_index.BUCKETS) -> None:
    """Add a model; one that is there must have the same dimension."""
    if not model:
        raise ValueError("a model needs a name")
    vector_index.ensure_index(spark, part_path(path, model), model, dim, model, buckets)


def models(spark: SparkSession, path: str) -> dict[str, int]:
    """Registered models with their dimensions, in order of their names."""
    parts = children(spark, f"{path}/parts", "m-")
    if not parts:
        raise ValueError(f"no model is registered at {path}")
    found = vector_index.read_meta(spark, *[f"{path}/parts/{part}" for part in parts]).select("model", "dim").collect()
    return {row.model: row.dim for row in sorted(found)}


def _by_model(rows: DataFrame, known: dict[str, int]) -> dict[str, DataFrame]:
    """Rows stored once by their ``model``, so that each part reads its own only. A null or unregistered model fails the job."""
    message = F.concat(F.lit("model "), F.coalesce("model", F.lit("null")), F.lit(" is not registered"))
    path = scratch_path(rows.sparkSession, "by-model")
    checked = rows.filter(F.assert_true(F.coalesce(F.col("model").isin(list(known)), F.lit(False)), message).isNull())
    checked.write.partitionBy("model").parquet(path)
    stored = rows.sparkSession.read.schema(rows.schema).parquet(path)
    return {model: stored.filter(F.col("model") == model).drop("model") for model in known}


def publish(points: DataFrame, path: str, batch: int, order: Sequence[str] = ()) -> None:
    """Upsert (model, point_id, vector, payload, ...) into the parts of their models.

    Every part is staged and checked before the first one is put in its place, so vectors of another dimension, colliding ids and unknown
    models leave all parts as they were. Publishing a batch again replaces it in every part, also where it ended between two of them.
    """
    spark = points.sparkSession
    by_model = _by_model(points, models(spark, path))
    for model, mine in by_model.items():
        vector_index.stage(mine, part_path(path, model), batch, order)
    for model in by_model:
        vector_index.place(spark, part_path(path, model), batch)


def publish_packed(spark: SparkSession, path: str) -> dict[str, int]:
    """Pack every part that holds points as it is; the version of each."""
    parts = {model: part_path(path, model) for model in models(spark, path)}
    return {model: vector_index.publish_packed(spark, part) for model, part in parts.items() if vector_index.newest_batch(spark, part) is not None}


def _points(spark: SparkSession, path: str, known: dict[str, int]) -> DataFrame:
    """(model, point_id, sub_id) of all stored rows; neither vectors nor other payload are read."""
    parts = [spark.createDataFrame([], "model string, point_id bigint, sub_id string")]
    for model in known:
        stored = vector_index.rows(spark, part_path(path, model))
        if stored is not None:
            parts.append(stored.select(F.lit(model).alias("model"), "point_id", "payload.sub_id"))
    return reduce(DataFrame.unionByName, parts)


def backlog(spark: SparkSession, path: str, model: str) -> DataFrame:
    """(point_id, sub_id) of the points that other models know and ``model`` has yet to embed."""
    known = models(spark, path)
    if model not in known:
        raise ValueError(f"model {model} is not registered")
    own = F.bool_or(F.col("model") == model)
    return _points(spark, path, known).groupBy("point_id").agg(F.min("sub_id").alias("sub_id"), own.alias("own")).filter("NOT own").drop("own")


def status(spark: SparkSession, path: str) -> DataFrame:
    """Per model its dimension, the points it holds, and those that only other models hold."""
    known = models(spark, path)
    places = list(enumerate(known.items()))
    held = [F.max((F.col("model") == model).cast("bigint")).alias(f"_{i}") for i, (model, _) in places]
    by_point = _points(spark, path, known).groupBy("point_id").agg(*held)
    n = [F.coalesce(F.sum(f"_{i}"), F.lit(0).cast("bigint")) for i, _ in places]
    rows = [F.struct(F.lit(model).alias("model"), F.lit(dim).alias("dim"), n[i].alias("n_points"), (F.count(F.lit(1)) - n[i]).alias("n_missing"))
            for i, (model, dim) in places]
    return by_point.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def nearest(queries: DataFrame, path: str, k: int = 3, threshold: float | None = 0.6, packed: bool = False) -> DataFrame:
    """Each query's ``k`` best points of its own model: (model, query_id, point_id, score, match_rank).

    ``queries`` is (model, query_id, vector) and has a query id once per model. The points are searched as they are, or as their published packed version has
    them. A model without points has no matches; null, empty and zero vectors match nothing.
    """
    spark = queries.sparkSession
    known = models(spark, path)
    found = [spark.createDataFrame([], "model string, query_id bigint, point_id bigint, score double, match_rank int")]
    for model, asked in _by_model(queries.select("model", "query_id", "vector"), known).items():
        part = part_path(path, model)
        if vector_index.newest_batch(spark, part) is None:
            continue
        if packed:
            version = vector_index.packed_version(spark, part)
            if version is None:
                raise ValueError(f"no packed version is published of model {model}")
            index = vector_index.read_packed(spark, part, version)
        else:
            index = vector_index.read_points(spark, part, ["vector"]).select("point_id", "vector")
        found.append(neighbours.nearest(asked, index, k, threshold).withColumn("model", F.lit(model)))
    return reduce(DataFrame.unionByName, found)


def preferred(matches: DataFrame, order: Sequence[str]) -> DataFrame:
    """Of each query the matches of the first model in ``order`` that has any; models not named there are left out."""
    place = F.array_position(F.array(*[F.lit(model) for model in order]), F.col("model"))
    first = F.min("_place").over(Window.partitionBy("query_id"))
    named = matches.filter(F.col("model").isin(list(order))).withColumn("_place", place)
    return named.withColumn("_first", first).filter("_place = _first").drop("_place", "_first")
