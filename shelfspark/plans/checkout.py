"""Batch checkout over a table of basket images."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from shelfspark.functions.ids import hash63, sub_id
from shelfspark.operators.checkout import ACCEPT, cart_items, carts
from shelfspark.operators.detections import CONFIDENCE
from shelfspark.operators.inference import Detector, Embedder, detect, embed


def basket_vectors(images: DataFrame, detector: Callable[[], Detector], embedder: Callable[[], Embedder],
                   confidence: float = CONFIDENCE) -> DataFrame:
    """``cart_id, query_id, vector`` of every detection, plus a row with nulls for each image without any.

    ``images`` has ``cart_id, image_id`` and raster columns. All detections count, not the best only.
    """
    found = detect(images, detector, confidence, keep=("cart_id", "image_id"), with_crop=True)
    vectors = embed(found, embedder).select(
        "cart_id", hash63(sub_id(F.col("image_id"), F.col("det_idx"))).alias("query_id"),
        F.col("embedding").alias("vector"))
    nothing = images.select("cart_id", F.lit(None).cast("bigint").alias("query_id"),
                            F.lit(None).cast("array<float>").alias("vector"))
    return vectors.unionByName(nothing)


def checkout(images: DataFrame, index: DataFrame, payload: DataFrame, detector: Callable[[], Detector],
             embedder: Callable[[], Embedder], scratch: str, accept: float = ACCEPT) -> tuple[DataFrame, DataFrame]:
    """Items and carts of basket images. The vectors are stored in ``scratch`` first, so that models run once."""
    found = basket_vectors(images, detector, embedder).withColumn("search_id", F.monotonically_increasing_id())
    found.write.mode("overwrite").parquet(scratch)
    vectors = images.sparkSession.read.parquet(scratch)
    items = cart_items(vectors.filter(F.col("query_id").isNotNull()), index, payload, accept)
    return items, carts(vectors, items)
