"""From the vectors of a basket's detections to its priced cart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfspark.functions.text import price_label, sku_label
from shelfspark.operators.neighbours import PackedIndex, nearest
from shelfspark.operators.ranking import paged_lists
from shelfspark.session import materialize

# The acceptance threshold, the number of matches looked at, and the reply messages.
ACCEPT = 0.6
MATCHES = 3
MESSAGE_NONE = "Không tìm thấy sản phẩm nào trong ảnh"
MESSAGE_OK = "Thành công"


def reply_columns() -> list[Column]:
    """Name, price, sku and platform with the defaults of the reply; a null price is 0.0 and flagged."""
    return [
        F.coalesce("name", F.lit("Unknown Product")).alias("name"),
        F.coalesce(F.col("price"), F.lit(0.0)).alias("price"),
        F.col("price").isNull().alias("price_missing"),
        F.coalesce("sku", F.lit("")).alias("sku"),
        F.coalesce("platform", F.lit("")).alias("platform"),
    ]


def describe_matches(matches: DataFrame, payload: DataFrame) -> DataFrame:
    """Matches with the reply columns of their point; ``payload`` is keyed by ``point_id``. A match without payload gets the defaults."""
    joined = matches.join(payload.select("point_id", "name", "price", "sku", "platform"), "point_id", "left")
    return joined.select(*matches.columns, *reply_columns())


def with_search_ids(detections: DataFrame, label: str = "detections") -> DataFrame:
    """Detections stored with a row number ``search_id``, by which a search can tell all of them apart; it holds for the stored table only."""
    return materialize(detections.withColumn("search_id", F.monotonically_increasing_id()), label)


def cart_items(detections: DataFrame, index: DataFrame | PackedIndex, payload: DataFrame,
               accept: float = ACCEPT) -> DataFrame:
    """One item per detection whose best match scores above ``accept``; equal products stay separate items.

    ``detections`` has ``cart_id, query_id, vector``, with a null or empty vector where embedding failed; rows without a ``query_id`` match nothing.
    Query ids of any type may repeat: the search goes by ``search_id`` (:func:`with_search_ids`), which detections without it are given here.
    """
    asked = detections.filter(F.col("query_id").isNotNull())
    if "search_id" not in detections.columns:
        asked = with_search_ids(asked.select("cart_id", "query_id", "vector"))
    best = nearest(asked.select(F.col("search_id").alias("query_id"), "vector"), index, k=1, threshold=accept)
    found = best.select(F.col("query_id").alias("search_id"), "point_id", "score")
    matched = asked.select("cart_id", "query_id", "search_id").join(found, "search_id")
    return describe_matches(matched.select("query_id", "cart_id", "point_id", "score"), payload)


def carts(detections: DataFrame, items: DataFrame) -> DataFrame:
    """Number of items, total price and message per cart.

    The message depends on whether anything was detected, not on whether anything matched; a
    cart image without detections is a row with a null ``query_id``.
    """
    seen = detections.groupBy("cart_id").agg(F.count("query_id").alias("n_detections"))
    totals = items.groupBy("cart_id").agg(
        F.count(F.lit(1)).alias("n_items"), F.sum("price").alias("total_price"),
        F.count_if("price_missing").alias("n_price_missing"))
    zero = F.lit(0).cast("bigint")
    return seen.join(totals, "cart_id", "left").select(
        "cart_id", "n_detections",
        F.coalesce("n_items", zero).alias("n_items"),
        F.coalesce("total_price", F.lit(0.0)).alias("total_price"),
        F.coalesce("n_price_missing", zero).alias("n_price_missing"),
        F.when(F.col("n_detections") > 0, MESSAGE_OK).otherwise(MESSAGE_NONE).alias("message"))


def cart_pages(items: DataFrame, page_size: int = 1000) -> DataFrame:
    """The nested reply: items in detection order as an array, in pages so that no cart outgrows a row."""
    item = F.struct("name", "price", "score", "sku", "platform")
    return paged_lists(items, ["cart_id"], ["query_id"], item, page_size)


def cart_quantities(items: DataFrame) -> DataFrame:
    """Items of one product rolled up per cart."""
    return items.groupBy("cart_id", "point_id", "name", "sku", "platform").agg(
        F.count(F.lit(1)).alias("quantity"), F.sum("price").alias("amount"))


def cart_lines(items: DataFrame) -> DataFrame:
    """Display form of the items."""
    return items.select("cart_id", "query_id", "name", price_label(F.col("price")).alias("price_text"),
                        sku_label(F.col("sku")).alias("sku_text"))
