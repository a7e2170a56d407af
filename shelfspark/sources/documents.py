"""Scans of product documents, collections, folders and checkpoints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfspark.schemas import RAW_PRODUCT


def _read_text_files(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(path)
            .select(F.col("value"), F.col("_metadata.file_name").alias("source_file")))


def parse_documents(texts: DataFrame) -> DataFrame:
    """``(value, source_file)`` to RAW_PRODUCT columns; ``body`` is null where the text is no JSON object.

    Everything the document holds stays in ``body``, objects and arrays of any shape included.
    """
    body = F.when(F.ltrim("value").startswith("{"), F.try_parse_json("value"))
    parsed = texts.select("source_file", body.alias("body"))
    named = [f.name for f in RAW_PRODUCT if f.name not in ("source_file", "body", "image_path")]
    return parsed.select(
        "source_file", *[F.try_variant_get("body", f"$.{n}", "string").alias(n) for n in named],
        F.lit(None).cast("string").alias("image_path"), "body")


def read_products(spark: SparkSession, path: str) -> DataFrame:
    """One row per readable ``*.json`` file of a folder; unreadable and empty ones are dropped."""
    return parse_documents(_read_text_files(spark, path)).filter(F.col("body").isNotNull())


def unreadable_products(spark: SparkSession, path: str) -> DataFrame:
    """Names of the files with a content that :func:`read_products` drops."""
    return parse_documents(_read_text_files(spark, path)).filter(F.col("body").isNull()).select("source_file")


def read_historic(spark: SparkSession, path: str) -> DataFrame:
    """Old products as ``(product_id, primary_category_path)``; the id is the file name without ``.json``."""
    return read_products(spark, path).select(
        F.regexp_replace("source_file", r"\.json", "").alias("product_id"),
        F.coalesce("primary_category_path", F.lit("")).alias("primary_category_path"))


def read_collection(spark: SparkSession, path: str, exclude: Sequence[str] = ("ld_json",),
                    source_format: str = "parquet", partitions: int | None = None) -> DataFrame:
    """A stored collection without the excluded columns; they are pruned from the scan.

    ``source_format`` may name any installed connector. ``partitions`` spreads the rows
    before heavy Python stages; otherwise AQE sizes the shuffles.
    """
    df = spark.read.format(source_format).load(path).drop(*exclude)
    return df.repartition(partitions) if partitions else df


def first_rows(df: DataFrame, order: Sequence[str], n: int | None = None) -> DataFrame:
    """The trial-run limit: first ``n`` rows by key, or everything (the default)."""
    return df if n is None else df.orderBy(*order).limit(n)


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Names, paths, sizes and times of the files of a folder; of equal names the newest. Contents are not read."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
             .load(path).select("path", "length", "modificationTime"))
    named = files.withColumn("file_name", F.element_at(F.split("path", "/"), -1))
    newest = F.max_by(F.struct("path", "length", "modificationTime"), F.struct("modificationTime", "path"))
    return named.groupBy("file_name").agg(newest.alias("f")).select("file_name", "f.*")


def find_one(df: DataFrame, predicate: Column) -> DataFrame:
    """One row that satisfies ``predicate``, if any."""
    return df.filter(predicate).limit(1)


def find_file(files: DataFrame, name: str) -> DataFrame:
    return find_one(files, F.col("file_name") == name)


def checkpoint_of(collection: DataFrame) -> DataFrame:
    """``source_file`` and image path of the stored documents that came from a file, a row a file.

    A file stored several times has its image if any of them has (the greatest path).
    """
    return collection.filter(F.col("source_file").isNotNull()).groupBy("source_file").agg(F.max("image_path").alias("image_path"))


def with_listing_id(listings: DataFrame, column: str = "id") -> DataFrame:
    """Listing rows with a usable id."""
    text = F.col(column).cast("string")
    return listings.filter(text.isNotNull() & ~text.isin("", "0"))
