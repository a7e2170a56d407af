"""Continuous checkout: arriving basket detections matched to the published index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from shelfspark.operators.checkout import ACCEPT, cart_items, carts, with_search_ids
from shelfspark.sinks.tables import exists, log_changes, read_changes
from shelfspark.sinks.vector_index import packed_version, read_packed


def _version(spark: SparkSession, index: str, out: str, batch_id: int) -> int:
    """The index version of a batch: the published one when it first ran, and the same again when it is replayed."""
    path = f"{out}/versions/batch={batch_id}"
    if exists(spark, f"{path}/_SUCCESS"):
        return spark.read.schema("version bigint").parquet(path).first().version
    version = packed_version(spark, index)
    if version is None:
        raise ValueError(f"no packed version is published at {index}")
    spark.createDataFrame([(version,)], "version bigint").coalesce(1).write.mode("overwrite").parquet(path)
    return version


def checkout_stream(feed: DataFrame, index: str, payload: DataFrame, out: str, checkpoint: str,
                    accept: float = ACCEPT) -> StreamingQuery:
    """Write the detections seen and the items found of every batch.

    ``index`` is the path of a vector index; every batch searches the version published when it starts
    (:func:`~shelfspark.sinks.vector_index.publish_packed`), of which it reads the cells its vectors are routed to. Nothing is packed here, so a
    restart costs nothing. A basket may be spread over batches: carts are summed up when read (:func:`read_carts`).
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stored = with_search_ids(batch, "baskets")
        packed = read_packed(spark, index, _version(spark, index, out, batch_id))
        log_changes(stored.select("cart_id", "query_id"), f"{out}/detections", batch_id)
        log_changes(cart_items(stored, packed, payload, accept), f"{out}/items", batch_id)

    return (feed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def read_items(spark: SparkSession, out: str) -> DataFrame:
    return read_changes(spark, f"{out}/items").drop("batch", "seq")


def read_carts(spark: SparkSession, out: str) -> DataFrame:
    return carts(read_changes(spark, f"{out}/detections").drop("batch", "seq"), read_items(spark, out))
