"""Identifiers and fingerprints, all stable across runs, workers and engines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from shelfspark.functions.text import first_truthy

# The URL namespace of name-based UUIDs, the site prefix of listing ids,
# and the range a leaf's target is drawn from.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
SITE_PREFIX = "tiki_"
LEAF_TARGET_MIN = 9000
LEAF_TARGET_MAX = 11000


def hash63(text: Column) -> Column:
    """A non-negative bigint from the first 64 bits of the md5 of ``text``."""
    unsigned = F.conv(F.substr(F.md5(text.cast("string")), F.lit(1), F.lit(16)), 16, 10).cast("decimal(20,0)")
    return (unsigned % F.lit(str(2**63)).cast("decimal(20,0)")).cast("bigint")


def sub_id(original_id: Column, index: Column) -> Column:
    return F.concat(original_id, F.lit("_obj"), index.cast("string"))


def point_id(sub: Column) -> Column:
    return hash63(sub)


def uuid5(namespace: str, name: Column) -> Column:
    """Name-based UUID, version 5."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))

    def part(start: int, length: int) -> Column:
        return F.substr(digest, F.lit(start), F.lit(length))

    variant = F.translate(part(17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3),
        F.lit("-"), part(21, 12),
    )


def product_uuid(listing_id: Column) -> Column:
    return uuid5(URL_NAMESPACE, F.concat(F.lit(SITE_PREFIX), listing_id.cast("string")))


def upload_id(df: DataFrame) -> Column:
    """Identifier used in stage object names; falls back to a UUID of the image path, so reruns agree."""
    fallback = uuid5(URL_NAMESPACE, F.coalesce(F.col("image_path"), F.lit(""))) if "image_path" in df.columns \
        else F.lit("unknown")
    return F.coalesce(first_truthy(df, ["product_id", "_id", "sku"]), fallback)


def original_id(df: DataFrame) -> Column:
    return first_truthy(df, ["_id", "product_id"], "unknown")


def sku_or_product(df: DataFrame) -> Column:
    return first_truthy(df, ["sku", "product_id"], "unknown_sku")


def sorted_json(columns: Sequence[str]) -> Column:
    """One JSON object over ``columns`` in key order, with ``", "`` and ``": "`` as separators."""
    def value(name: str) -> Column:
        wrapped = F.to_json(F.struct(F.col(name).alias("v")))
        return F.when(F.col(name).isNull(), F.lit("null")).otherwise(
            F.substr(wrapped, F.lit(6), F.length(wrapped) - 6))

    parts = [F.concat(F.lit(f'"{name}": '), value(name)) for name in sorted(columns)]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def utc_iso(run_time: Column) -> Column:
    """ISO text of a run's time stamp, which is a parameter of the run and not the clock of a task."""
    return F.date_format(F.to_utc_timestamp(run_time, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def utc_day(run_time: Column) -> Column:
    return F.date_format(F.to_utc_timestamp(run_time, F.current_timezone()), "yyyy-MM-dd")


def storage_refs(document: Column, bucket: str, object_name: Column, stored_at: Column) -> Column:
    """Where a document is stored, with the size and md5 of its JSON text."""
    return F.struct(
        F.lit(bucket).alias("bucket"),
        object_name.alias("object_name"),
        F.octet_length(document).cast("bigint").alias("size"),
        F.md5(document).alias("etag"),
        stored_at.alias("timestamp"),
    )


def leaf_target(leaf: Column, seed: int = 0, low: int = LEAF_TARGET_MIN, high: int = LEAF_TARGET_MAX) -> Column:
    """A target in ``[low, high]`` that depends on the leaf and the seed only, so it needs no saved state."""
    drawn = hash63(F.concat(leaf.cast("string"), F.lit(f":{seed}")))
    return (F.lit(low) + F.pmod(drawn, F.lit(high - low + 1))).cast("bigint")
