"""Projection of any product table onto the canonical schema, and the packing of stage states."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from shelfspark.functions.text import display_name, first_present, full_image_path, number_or_null
from shelfspark.schemas import STATE_OK, STATE_UNKNOWN


def canonical(df: DataFrame, carry: Sequence[str] = ("image_data",)) -> DataFrame:
    """The canonical product columns, and those of ``carry`` that the frame has."""
    columns = [
        first_present(df, ["product_id", "_id"]).alias("product_id"),
        first_present(df, ["platform", "source"], "unknown").alias("platform"),
        F.col("sku").cast("string").alias("sku"),
        display_name(df).alias("name"),
        number_or_null(F.col("price")).alias("price"),
        first_present(df, ["image_path"]).alias("image_path"),
        first_present(df, ["cleaning_state"], STATE_UNKNOWN).alias("cleaning_state"),
        F.lit(STATE_OK).alias("integrate_state"),
    ]
    return df.select(*columns, *[c for c in carry if c in df.columns])


def pack_states(df: DataFrame) -> DataFrame:
    """Replace the three state columns by one struct."""
    states = ["cleaning_state", "integrate_state", "transform_state"]
    return df.withColumn("pipeline_state", F.struct(*states)).drop(*states)


def unpack_result(df: DataFrame, result: str, columns: dict[str, str]) -> DataFrame:
    """Spread fields of the struct column ``result`` (field name -> column name), then drop it."""
    return df.withColumns({to: F.col(f"{result}.{field}") for field, to in columns.items()}).drop(result)


def state_counts(df: DataFrame, state: str) -> DataFrame:
    return df.groupBy(F.col(state).alias("state")).agg(F.count(F.lit(1)).alias("n"))


def with_image_location(df: DataFrame, bucket: str = "storage_refs.bucket") -> DataFrame:
    """Add the absolute image path and the kind of image the later stages tell apart."""
    return df.withColumns({
        "full_image_path": full_image_path(F.col(bucket), F.col("image_path")),
        "image_type": F.lit("single_object"),
    })
