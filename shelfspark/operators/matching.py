"""Joins of products with image files, checkpoints, stage paths and enrichment sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from shelfspark.functions.text import IMAGE_EXTENSIONS, base_name, extension, normalize_path
from shelfspark.operators.upsert import one_per_key, overlay


def spread_nulls(key: Column) -> Column:
    """A join key whose nulls match nothing and do not all meet in one task."""
    return F.coalesce(key, F.concat(F.lit("\u0000"), F.spark_partition_id().cast("string")))


def preferred_image(files: DataFrame, name: str = "file_name") -> DataFrame:
    """One image per base name: the best extension wins, others (upper case too) do not count."""
    known = F.array(*[F.lit(e) for e in IMAGE_EXTENSIONS])
    rank = F.array_position(known, extension(F.col(name))).cast("int")
    best = (files.select(base_name(F.col(name)).alias("base"), rank.alias("_rank")).filter("_rank > 0")
            .groupBy("base").agg(F.min("_rank").alias("_rank")))
    # The name is put together again: a minimum of integers is a hash aggregate, one of names would sort.
    return best.select("base", F.concat("base", F.element_at(known, F.col("_rank"))).alias("image_file"))


def match_images(products: DataFrame, files: DataFrame, source_file: str = "source_file") -> DataFrame:
    """Products with the image of the same base name, or null."""
    return (products.withColumn("base", base_name(F.col(source_file)))
            .join(preferred_image(files), "base", "left").drop("base"))


def ingest_status(incoming: DataFrame, checkpoint: DataFrame, files: DataFrame) -> DataFrame:
    """What to do with each incoming document.

    ``skip_done``: stored with its image; ``skip_wait``: stored, no image yet and none to be had;
    ``update``: stored, and its image has turned up; ``new``: not stored.
    """
    known = (checkpoint.groupBy("source_file").agg(F.max("image_path").alias("_stored"))
             .withColumn("_known", F.lit(True)))
    status = (F.when(F.col("_known").isNull(), "new")
              .when(F.col("_stored").isNotNull(), "skip_done")
              .when(F.col("image_file").isNull(), "skip_wait")
              .otherwise("update"))
    return (match_images(incoming, files).join(known, "source_file", "left")
            .withColumn("status", status).drop("_known", "_stored"))


def join_on_path(df: DataFrame, content: DataFrame, path_column: str, bytes_column: str = "image_data") -> DataFrame:
    """Attach the bytes stored under a path; null where there are none.

    ``content`` has ``path`` and ``content``, one row per path.
    """
    store = content.select(normalize_path(F.col("path")).alias("_path"), F.col("content").alias(bytes_column))
    return (df.withColumn("_path", spread_nulls(normalize_path(F.col(path_column))))
            .join(store, "_path", "left").drop("_path"))


def join_paths(df: DataFrame, paths: DataFrame, path_column: str, key: str = "product_id") -> DataFrame:
    """Attach stored paths by product: one path per key, so the row count of ``df`` is kept."""
    single = (paths.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key"))
              .agg(F.min(path_column).alias(path_column)))
    return df.withColumn("_key", spread_nulls(F.col(key).cast("string"))).join(single, "_key", "left").drop("_key")


def merge_open(older: Column, newer: Column) -> Column:
    """Two open records (variant objects) in one: every key of ``newer`` wins, those with a null value too."""
    def fields(record: Column) -> Column:
        return F.coalesce(F.try_variant_get(record, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))

    kept = F.map_filter(fields(older), lambda key, _: ~F.map_contains_key(fields(newer), key))
    return F.to_variant_object(F.map_concat(kept, fields(newer)))


def enrich(listing: DataFrame, detail: DataFrame, structured: DataFrame, key: str = "id") -> DataFrame:
    """Listing rows enriched by the detail record, else by structured page data, else left alone.

    Non-null detail fields override listing fields of the same name and add the others. Where there
    is no detail, the page data (column ``ld_json``) is nested. ``data_source`` says which it was. Of several records of
    a key the first by their columns counts, so listings are never multiplied.
    """
    fields: Sequence[str] = [c for c in detail.columns if c != key]
    detail, structured = one_per_key(detail, [key]), one_per_key(structured.select(key, "ld_json"), [key])
    d = detail.select(key, *[F.col(c).alias(f"_d_{c}") for c in fields], F.lit(True).alias("_has_detail"))
    s = structured.select(key, F.col("ld_json").alias("_ld"))
    joined = listing.join(d, key, "left").join(s, key, "left")
    merged = {c: overlay(F.col(f"_d_{c}"), F.col(c)) if c in listing.columns else F.col(f"_d_{c}") for c in fields}
    by_page = F.col("_has_detail").isNull() & F.col("_ld").isNotNull()
    # The labels of the three sources.
    label = (F.when(F.col("_has_detail"), "api_detail").when(by_page, "requests_ld_json").otherwise("listing_only"))
    return (joined.withColumns({**merged, "ld_json": F.when(by_page, F.col("_ld")), "data_source": label})
            .drop("_has_detail", "_ld", *[f"_d_{c}" for c in fields]))
