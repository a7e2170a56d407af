"""Selection, labelling and metadata of detected objects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from shelfspark.functions import ids
from shelfspark.functions.text import first_truthy, number_or_null
from shelfspark.operators.ranking import rank_in_group, top_per_group

CONFIDENCE = 0.5


def confident(df: DataFrame, threshold: float = CONFIDENCE) -> DataFrame:
    return df.filter(F.col("confidence") >= threshold)


def best_per_image(df: DataFrame, order: Sequence[str] = ("det_idx",)) -> DataFrame:
    """The most confident detection of each image; on ties the first."""
    return top_per_group(df, ["image_id"], [F.desc("confidence"), *[F.col(c) for c in order]])


def nearest_to_centre(df: DataFrame, order: Sequence[str] = ("det_idx",)) -> DataFrame:
    """The detection whose box centre is nearest to the image centre (needs ``width`` and ``height``)."""
    box = F.col("bbox")
    dx = (box[0] + box[2]) / 2 - F.col("width") / 2
    dy = (box[1] + box[3]) / 2 - F.col("height") / 2
    return top_per_group(df.withColumn("_d2", dx * dx + dy * dy), ["image_id"],
                         [F.col("_d2"), *[F.col(c) for c in order]]).drop("_d2")


def number_detections(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """0-based ``det_idx`` inside each image. Detections that arrive as an array get theirs by ``posexplode``."""
    return (rank_in_group(df, ["image_id"], order, "_rank")
            .withColumn("det_idx", (F.col("_rank") - 1).cast("int")).drop("_rank"))


def box_to_int(bbox: Column) -> Column:
    """Coordinates truncated toward zero."""
    return F.transform(bbox, lambda x: x.cast("int"))


def clamp_box(bbox: Column, width: Column, height: Column) -> Column:
    """Integer box cut to the image; null where nothing is left of it."""
    box = box_to_int(bbox)

    def inside(value: Column, limit: Column) -> Column:
        return F.least(F.greatest(value, F.lit(0)), limit)

    x1, y1 = inside(box[0], width), inside(box[1], height)
    x2, y2 = inside(box[2], width), inside(box[3], height)
    return F.when((x2 > x1) & (y2 > y1), F.array(x1, y1, x2, y2))


def metadata_expressions(products: DataFrame) -> dict[str, Column]:
    """What an object inherits from its product; real defaults for missing values."""
    def text_or_empty(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")) if name in products.columns else F.lit("")

    return {
        "original_id": ids.original_id(products),
        "sku": ids.sku_or_product(products),
        "name": F.coalesce(first_truthy(products, ["name", "title"]), F.lit("")),
        "price": number_or_null(F.col("price")),
        "platform": text_or_empty("platform"),
        "image_path": text_or_empty("image_path"),
    }


def product_metadata(products: DataFrame) -> DataFrame:
    """The inherited columns, keyed by ``image_id``."""
    return products.select("image_id", *[c.alias(n) for n, c in metadata_expressions(products).items()])


def object_metadata(detections: DataFrame, products: DataFrame) -> DataFrame:
    """Detections with the metadata of their product, ``sub_id`` and ``point_id``."""
    joined = detections.join(product_metadata(products), "image_id")
    joined = joined.withColumn("sub_id", ids.sub_id(F.col("original_id"), F.col("det_idx")))
    out = joined.withColumn("point_id", ids.point_id(F.col("sub_id")))
    if "embedding" in detections.columns:
        out = out.withColumn("embedding_dim", F.greatest(F.size("embedding"), F.lit(0)))
    return out


def label_detections(detections: DataFrame, products: DataFrame) -> DataFrame:
    """Every detection with the sku of its product as label."""
    labels = products.select(
        "image_id", first_truthy(products, ["_id", "product_id"], "unknown_id").alias("original_id"),
        ids.sku_or_product(products).alias("sku_label"))
    return (detections.join(labels, "image_id")
            .withColumn("sub_id", ids.sub_id(F.col("original_id"), F.col("det_idx"))))


def points(objects: DataFrame) -> DataFrame:
    """Index points ``(point_id, vector, payload)``; objects with an empty vector are left out."""
    payload = [c for c in objects.columns if c not in ("embedding", "point_id")]
    return (objects.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0))
            .select(ids.point_id(F.col("sub_id")).alias("point_id"), F.col("embedding").alias("vector"),
                    F.struct(*payload).alias("payload")))


def id_collisions(points_df: DataFrame) -> DataFrame:
    """Point ids shared by different sub ids; empty unless the hash collided."""
    return (points_df.groupBy("point_id")
            .agg(F.min("payload.sub_id").alias("first_sub_id"), F.max("payload.sub_id").alias("last_sub_id"))
            .filter("first_sub_id <> last_sub_id"))
