"""Staged preprocessing: extract, clean, integrate, transform; every stage is stored and read back."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from shelfspark.functions import ids
from shelfspark.functions.text import s3_path, stage_object_name
from shelfspark.operators import clean, images, integrate
from shelfspark.operators.matching import spread_nulls
from shelfspark.operators.reports import counted
from shelfspark.schemas import RASTER, STATE_OK
from shelfspark.sinks.tables import append_stage


def extract(products: DataFrame, rasters: DataFrame, path_column: str = "image_path") -> DataFrame:
    """Products that pass the metadata filter, with the raster at their path.

    The filter runs before the join, so no image is moved for a row that is dropped anyway.
    """
    wanted = clean.clean_stage(products, path_column).withColumn("_path", spread_nulls(F.col(path_column)))
    stored = rasters.select(F.col("path").alias("_path"), *RASTER.names)
    return wanted.join(stored, "_path", "left").drop("_path")


def clean_step(df: DataFrame, repair_glare: images.ImageStep | None = None, codec: images.Codec | None = None) -> DataFrame:
    return images.clean_images(clean.with_bytes(df, "data"), repair_glare, codec=codec)


def integrate_step(df: DataFrame) -> DataFrame:
    """Canonical columns with the raster and the paths of earlier stages carried along."""
    paths = [c for c in df.columns if c.endswith("_path") and c != "image_path"]
    return integrate.canonical(df, carry=[*RASTER.names, "is_encoded", *paths])


def transform_step(df: DataFrame, foreground: Callable[[DataFrame], DataFrame], codec: images.Codec | None = None) -> DataFrame:
    """White background, given a function that adds the 0/1 mask column ``foreground``; states packed."""
    return integrate.pack_states(images.whiten_background(foreground(df), codec=codec).drop("foreground"))


def with_stage_path(df: DataFrame, step: str, bucket: str = "products") -> DataFrame:
    """Computed path of a stage image: row count kept, nothing joined back."""
    name = stage_object_name(step, ids.upload_id(df))
    return df.withColumn(f"{step}_path", s3_path(bucket, name))


@dataclass
class StagedRun:
    """Where the stages of a run were stored, how many rows each had, and the last frame."""

    frames: dict[str, str] = field(default_factory=dict)
    metadata: dict[str, str] = field(default_factory=dict)
    rows: dict[str, int] = field(default_factory=dict)
    last: DataFrame | None = None


def run_stages(products: DataFrame, rasters: DataFrame, foreground: Callable[[DataFrame], DataFrame], out: str,
               run_id: str, only_success: bool = False, bucket: str = "products",
               repair_glare: images.ImageStep | None = None, codec: images.Codec | None = None) -> StagedRun:
    """Run and store all stages.

    A stage is written once, with its rasters, and read back: the stored frame is the stage's
    content table (``<step>_path`` and the raster columns) and the next stage's input, so a lost executor costs one
    stage at most. The metadata is appended apart, without bytes. Failed images stay in
    the flow unless ``only_success``. With a codec the stored images are its files where ``is_encoded`` says so; ``foreground`` is given them as they are stored.
    """
    spark = products.sparkSession
    run = StagedRun()
    frame = extract(products, rasters)
    steps: dict[str, tuple[Callable[[DataFrame], DataFrame], str | None]] = {
        "clean": (lambda df: clean_step(df, repair_glare, codec), "cleaning_state"),
        "integrate": (integrate_step, None),
        "transform": (lambda df: transform_step(df, foreground, codec), "pipeline_state.transform_state"),
    }
    for step, (apply, state) in steps.items():
        frame = with_stage_path(apply(frame), step, bucket)
        if only_success and state:
            frame = frame.filter(F.col(state) == STATE_OK)
        observed, seen = counted(frame, f"{step}-{run_id}")
        run.frames[step] = f"{out}/frames/{step}/run_id={run_id}"
        observed.write.mode("overwrite").parquet(run.frames[step])
        run.rows[step] = seen.get["rows"]
        frame = spark.read.parquet(run.frames[step])
        run.metadata[step] = append_stage(frame, f"{out}/metadata", step, run_id)
    run.last = frame
    return run
