"""Metadata cleaning: required fields, identity, prices, projections of unneeded columns."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Literal

from pyspark.sql import DataFrame, functions as F

from shelfspark.functions.text import price_or_zero, strip_strings
from shelfspark.operators.dedupe import first_per_identifier, with_identifier


def required_fields(df: DataFrame, path_column: str = "image_path") -> DataFrame:
    """Rows with a path, a sku, a price and a title or a name (the sku stands in if there is neither column)."""
    naming = [c for c in ("title", "name") if c in df.columns]
    named = F.col(naming[0] if naming else "sku").isNotNull()
    for column in naming[1:]:
        named = named | F.col(column).isNotNull()
    return df.filter(
        F.col(path_column).isNotNull() & F.col("sku").isNotNull() & F.col("price").isNotNull() & named)


def has_identity(df: DataFrame, path_column: str = "image_path") -> DataFrame:
    """Drop rows without both ``product_id`` and ``sku``, and rows whose path is null or empty."""
    identified = F.col("product_id").isNotNull() | F.col("sku").isNotNull()
    return df.filter(identified & F.col(path_column).isNotNull() & (F.col(path_column) != ""))


def with_bytes(df: DataFrame, column: str = "image_data") -> DataFrame:
    return df.filter(F.col(column).isNotNull())


def normalize_values(df: DataFrame, on_null_price: Literal["keep", "drop"] = "keep") -> DataFrame:
    """Strip all strings and turn the price into a double.

    ``on_null_price="drop"`` loses records whose price is null, ``"keep"`` leaves the null.
    """
    out = strip_strings(df)
    if "price" not in df.columns:
        return out
    if on_null_price == "drop":
        out = out.filter(F.col("price").isNotNull())
    return out.withColumn("price", price_or_zero(F.col("price")))


def clean_records(df: DataFrame, order: Sequence[str] = ("source_file",),
                  on_null_price: Literal["keep", "drop"] = "keep") -> DataFrame:
    """Collection-time cleaning of product records: dedupe on the raw identifier, then normalise the values."""
    return normalize_values(first_per_identifier(with_identifier(df), order).drop("identifier"), on_null_price)


def keep_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Those of ``names`` that exist, in the given order."""
    return df.select(*[n for n in names if n in df.columns])


def clean_stage(df: DataFrame, path_column: str = "image_path") -> DataFrame:
    """Metadata side of the cleaning stage; the path ends up under its standard name as well."""
    out = required_fields(df, path_column)
    return out if path_column == "image_path" else out.withColumn("image_path", F.col(path_column))
