"""Column expressions over product text, prices and paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Fixed value: the extensions an image may have, best first.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png")

_DIGITS = r"\d(?:_?\d)*"
_NUMBER = rf"^[+-]?(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?$"
_SPECIAL = r"(?i)^[+-]?(?:nan|inf|infinity)$"


def strip_text(value: Column) -> Column:
    """Remove white space of any kind from both ends (``trim`` would remove blanks only)."""
    return F.regexp_replace(value, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def strip_strings(df: DataFrame, except_for: Sequence[str] = ()) -> DataFrame:
    """Strip every string column of ``df``."""
    names = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in except_for]
    return df.withColumns({name: strip_text(F.col(name)) for name in names})


def number_or_null(value: Column) -> Column:
    """Text to double; null where it is no decimal number, whatever the ANSI setting."""
    text = strip_text(value.cast("string"))
    plain = F.regexp_replace(text, "_", "")
    return F.when(text.rlike(_NUMBER) | text.rlike(_SPECIAL), plain.try_cast("double"))


def price_or_zero(value: Column) -> Column:
    """A price that does not parse becomes 0.0; an absent price stays null."""
    return F.when(value.isNotNull(), F.coalesce(number_or_null(value), F.lit(0.0)))


def truthy(df: DataFrame, name: str) -> Column:
    """The column as text, with empty strings and numeric zeros turned to null."""
    value = F.col(name)
    if isinstance(df.schema[name].dataType, T.NumericType):
        return F.when(value != 0, value.cast("string"))
    text = value.cast("string")
    return F.when(text != "", text)


def first_truthy(df: DataFrame, names: Sequence[str], default: str | None = None) -> Column:
    """First truthy value among those of ``names`` that ``df`` has."""
    options = [truthy(df, name) for name in names if name in df.columns]
    return F.coalesce(*options, F.lit(default).cast("string"))


def first_present(df: DataFrame, names: Sequence[str], default: str | None = None) -> Column:
    """The first column of ``names`` that ``df`` has (its nulls included), else a constant."""
    for name in names:
        if name in df.columns:
            return F.col(name).cast("string")
    return F.lit(default).cast("string")


def display_name(df: DataFrame) -> Column:
    """Name, or title where the name is null; a column that is missing counts as null."""
    options = [F.col(c).cast("string") for c in ("name", "title") if c in df.columns]
    return F.coalesce(*options) if options else F.lit(None).cast("string")


def strip_scheme(path: Column) -> Column:
    return F.replace(path, F.lit("s3://"), F.lit(""))


def split_bucket(path: Column) -> Column:
    """``bucket/object`` or ``s3://bucket/object`` to a struct; null where there is no ``/``."""
    plain = strip_scheme(path)
    cut = F.locate("/", plain)
    return F.when(
        cut > 0,
        F.struct(
            F.substr(plain, F.lit(1), cut - 1).alias("bucket"),
            F.substr(plain, cut + 1).alias("object_name"),
        ),
    )


def normalize_path(path: Column) -> Column:
    """One form, ``bucket/object``, for every path; null where the path has no object part."""
    return F.when(F.locate("/", strip_scheme(path)) > 0, strip_scheme(path))


def s3_path(bucket: str, object_name: Column) -> Column:
    return F.concat(F.lit(f"s3://{bucket}/"), object_name)


def stage_object_name(step: str, identifier: Column) -> Column:
    return F.concat(F.lit(f"preprocessing/{step}/"), identifier, F.lit(".jpg"))


def crop_object_name(sku: Column, sub_id: Column) -> Column:
    return F.concat(F.lit("processing/objects/"), sku, F.lit("/"), sub_id, F.lit(".jpg"))


def document_object_name(source: str, day: Column, product_id: Column) -> Column:
    return F.concat(F.lit(f"{source}/"), day, F.lit("/products/"), product_id, F.lit(".json"))


def _has_extension(name: Column) -> Column:
    return name.rlike(r"(?s)^\.*[^.].*\.[^.]*$")


def base_name(name: Column) -> Column:
    """File name without its last extension; leading dots do not start one."""
    return F.when(_has_extension(name), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def extension(name: Column) -> Column:
    """Last extension with its dot, or the empty string."""
    return F.when(_has_extension(name), F.regexp_extract(name, r"(\.[^.]*)$", 1)).when(
        name.isNotNull(), F.lit(""))


def jpg_name(name: Column) -> Column:
    return F.concat(base_name(name), F.lit(".jpg"))


def last_segment(path: Column) -> Column:
    """Leaf identifier of a category path; null for an empty path."""
    return F.when(path != "", F.element_at(F.split(path, "/"), -1))


def large_thumbnail(url: Column) -> Column:
    return F.replace(url, F.lit("/cache/280x280/"), F.lit("/cache/w1200/"))


def full_image_path(bucket: Column, path: Column) -> Column:
    return F.concat_ws("/", bucket, path)


def price_label(price: Column) -> Column:
    return F.format_string("$%.2f", price)


def sku_label(sku: Column) -> Column:
    return F.concat(F.lit("SKU: "), F.coalesce(F.nullif(sku, F.lit("")), F.lit("N/A")))


def listing_url(endpoint: str, leaf: Column, keyword: Column, page: Column, page_size: int = 40) -> Column:
    """Request address of one listing page; the keyword part is left out when it is empty."""
    query = F.when(keyword != "", F.concat(F.lit("&q="), F.url_encode(keyword))).otherwise(F.lit(""))
    return F.concat(
        F.lit(f"{endpoint}?limit={page_size}"), query, F.lit("&category="), leaf.cast("string"),
        F.lit("&page="), page.cast("string"),
    )
