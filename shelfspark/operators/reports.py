"""Counters and run reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F


def counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The frame with its row count observed while it is written; no extra pass."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def outcome_report(df: DataFrame, outcome: str = "outcome") -> DataFrame:
    """Counts of the four outcomes of a collection run and the total collected."""
    def n(label: str):
        return F.count_if(F.col(outcome) == label)

    return df.agg(
        n("reused").alias("reused"), n("crawled").alias("crawled"), n("failed").alias("failed"),
        n("skipped").alias("skipped"), (n("reused") + n("crawled")).alias("total"))


def ingest_report(statuses: DataFrame) -> DataFrame:
    """Scanned, new and skipped documents of an ingestion."""
    skipped = F.col("status").startswith("skip")
    return statuses.agg(
        F.count(F.lit(1)).alias("scanned"), F.count_if(~skipped).alias("collected"),
        F.count_if(skipped).alias("skipped"))
