"""Duplicate elimination on product identifiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from shelfspark.functions.text import first_truthy
from shelfspark.operators.ranking import top_per_group

IDENTIFIER_COLUMNS = ("id", "product_id", "barcode")


def with_identifier(df: DataFrame, columns: Sequence[str] = IDENTIFIER_COLUMNS) -> DataFrame:
    return df.withColumn("identifier", first_truthy(df, columns))


def first_per_identifier(df: DataFrame, order: Sequence[str] = ("source_file",)) -> DataFrame:
    """Keep the first row per ``identifier``; rows without one all pass.

    The two kinds are handled apart, so that missing identifiers never form one large group.
    """
    named = df.filter(F.col("identifier").isNotNull())
    unnamed = df.filter(F.col("identifier").isNull())
    return top_per_group(named, ["identifier"], [F.col(c) for c in order]).unionByName(unnamed)
