"""From product images to a published vector index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from shelfspark.operators.detections import points
from shelfspark.operators.inference import Detector, Embedder, object_records
from shelfspark.operators.neighbours import index_dimension
from shelfspark.schemas import OBJECT_META
from shelfspark.sinks.tables import append_stage, write_content
from shelfspark.sinks.vector_index import ensure_index, publish


def build_index(images: DataFrame, detector: Callable[[], Detector], embedder: Callable[[], Embedder], out: str,
                name: str, run_id: str, batch: int, model: str = "") -> int:
    """Detect, crop, embed and publish; returns the number of objects.

    Objects are written once (models run once); crops, metadata and points come from that table.
    Without any object nothing is published.
    """
    spark = images.sparkSession
    objects_path = f"{out}/objects/run_id={run_id}"
    object_records(images, detector, embedder).write.mode("overwrite").parquet(objects_path)
    objects = spark.read.parquet(objects_path)
    found = objects.count()
    if not found:
        return 0
    write_content(objects, f"{out}/crops", run_id, "object_path",
                  ["crop_height", "crop_width", "crop_channels", "crop_data"])
    metadata = objects.select(*[F.col(f.name).cast(f.dataType) for f in OBJECT_META])
    append_stage(metadata, f"{out}/metadata", "objects", run_id)
    ensure_index(spark, f"{out}/index/{name}", name, index_dimension(metadata, "embedding"), model)
    publish(points(metadata), f"{out}/index/{name}", batch)
    return found
