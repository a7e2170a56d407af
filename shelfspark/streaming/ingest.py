"""Incremental ingestion and keyed dedupe of an unbounded feed."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfspark.operators.upsert import ordered_columns
from shelfspark.sinks.tables import log_changes


def ingest(feed: DataFrame, log_path: str, checkpoint: str,
           prepare: Callable[[DataFrame], DataFrame] = lambda batch: batch, report: str | None = None) -> StreamingQuery:
    """Add every unseen row of ``feed`` to a change log and stop when there are no more.

    Progress is kept in ``checkpoint``, whose batch numbers name the batches of the log: the two belong
    together. ``sinks.tables.current`` reads the upserted state. With ``report`` each batch also stores how many rows it scanned, how many
    ``prepare`` let through and how many it skipped (:func:`read_report`). Scanned rows are counted while the batch is written, not in a pass
    of their own. The row is written by the batch under its number, not by a listener, whose events may be lost or come twice.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        if report is None:
            log_changes(prepare(batch), log_path, batch_id)
            return
        spark, seen = batch.sparkSession, Observation()
        log_changes(prepare(batch.observe(seen, F.count(F.lit(1)).alias("scanned"))), log_path, batch_id)
        stored = spark.read.schema(_ANY).parquet(f"{log_path}/batch={batch_id}").count()
        scanned = seen.get["scanned"]
        row = spark.createDataFrame([(scanned, stored, scanned - stored)], _REPORT)
        row.coalesce(1).write.mode("overwrite").parquet(f"{report}/batch={batch_id}")

    return (feed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


_ANY = "_none string"
_REPORT = "scanned bigint, collected bigint, skipped bigint"


def read_report(spark: SparkSession, report: str) -> DataFrame:
    """(batch, scanned, collected, skipped) of the batches that :func:`ingest` reported."""
    return spark.read.schema(f"{_REPORT}, batch bigint").parquet(report)


def distinct_stream(feed: DataFrame, keys: Sequence[str], event_time: str | None = None,
                    delay: str = "1 hour") -> DataFrame:
    """First row per key of a stream.

    Without ``event_time`` every key seen is remembered, and the first row is the first to arrive. With it the first row is that of the
    least event time (ties by the other columns), whatever order rows arrive in, and the state is bounded: rows of a key of which
    each follows the one before within ``delay`` are copies and give one row, sent once nothing can join them any more, that is when the watermark,
    ``delay`` behind the newest event time, has passed the last of them by ``delay``; the key is forgotten then. Rows that
    come when their own time and ``delay`` lie behind the watermark are late and left out, and so are rows without an event time.
    """
    if event_time is None:
        return feed.dropDuplicates(list(keys))
    row, order = F.struct(*feed.columns), F.struct(event_time, *ordered_columns(feed, [event_time]))
    copies = feed.withWatermark(event_time, delay).groupBy(*keys, F.session_window(event_time, delay))
    return copies.agg(F.min_by(row, order).alias("_first")).select("_first.*")
