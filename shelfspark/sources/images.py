"""Image bytes and decoded rasters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfspark.functions.text import normalize_path
from shelfspark.operators.images import from_image_source
from shelfspark.operators.matching import join_on_path, spread_nulls
from shelfspark.session import materialize
from shelfspark.sinks.files import CONTENT_TASKS, LISTING_TASKS, deal, listing, with_file_bytes

#: Bytes of files that one task reads, about, and what opening a file counts for: 1024 small files a task.
TASK_BYTES, OPEN_BYTES = 256 << 20, 256 << 10


def read_content(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``(path, content)`` of the files below ``path``: one distributed listing and read, paths relative to it.

    The size of the contents does not show in a plan, hence the hint: nothing of them is broadcast, however short the listing.
    """
    files = deal(listing(spark, path, pattern, recursive=True), CONTENT_TASKS).select("root", "path")
    return with_file_bytes(files, "path", "content", root="root").select("path", "content").hint("merge")


def _relative(path: str) -> Column:
    """Column ``path`` without what leads to the folder."""
    root = path.rstrip("/").split("://")[-1].removeprefix("file:")
    return F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/+", "/"), f"^.*\\Q{root.lstrip('/')}\\E/", "")


def manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``(path, uri, length)`` of the files below ``path``, paths relative to it. Contents are not read; files without any are not listed."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
             .load(path).select("path", "length"))
    return files.select(_relative(path).alias("path"), F.col("path").alias("uri"), "length").coalesce(LISTING_TASKS)


def with_stored_bytes(df: DataFrame, files: DataFrame, path_column: str = "image_path", task_bytes: int = TASK_BYTES,
                      open_bytes: int = OPEN_BYTES) -> DataFrame:
    """Add ``image_data``: the bytes of the file at the row's path, null where there is none; ``files`` is a :func:`manifest`.

    Rows meet the manifest first, then tasks are dealt by the lengths and number of the files they want, and each reads its own: what nobody wants is
    not read, and no byte is shuffled.
    """
    known = files.select(normalize_path(F.col("path")).alias("_path"), F.col("uri").alias("_uri"), F.col("length").alias("_length"))
    found = df.withColumn("_path", spread_nulls(normalize_path(F.col(path_column)))).join(known, "_path", "left").drop("_path")
    planned = materialize(found, "wanted")
    total, wanted = planned.agg(F.coalesce(F.sum(F.col("_length") + open_bytes), F.lit(0)), F.count("_length")).first()
    # A task has a file at least, however few bytes it is to have.
    dealt = planned.repartition(max(1, min(wanted, -(-total // task_bytes))), F.col("_uri"), F.monotonically_increasing_id())
    return with_file_bytes(dealt, "_uri", "image_data").drop("_uri", "_length")


def with_image_bytes(df: DataFrame, content: DataFrame, path_column: str = "image_path") -> DataFrame:
    """Add ``image_data``: the bytes at the row's path, null where there are none."""
    return join_on_path(df, content, path_column)


def with_any_bytes(df: DataFrame, content: DataFrame) -> DataFrame:
    """Bytes in the row, else those at its transformed path (its image path if it has none); rows without are dropped.

    Rows that carry their bytes skip the join.
    """
    empty = F.col("image_data").isNull() | (F.octet_length("image_data") == 0)
    options = [F.nullif(F.col(c), F.lit("")) for c in ("transform_path", "image_path") if c in df.columns]
    complete = df.filter(~empty)
    lacking = df.filter(empty).drop("image_data").withColumn("_source_path", F.coalesce(*options))
    fetched = join_on_path(lacking.filter("_source_path IS NOT NULL"), content, "_source_path")
    usable = fetched.filter(F.octet_length("image_data") > 0)
    return complete.unionByName(usable.select(*df.columns))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded rasters; files that cannot be decoded stay, with height -1."""
    return from_image_source(spark.read.format("image").option("dropInvalid", False).load(path))
