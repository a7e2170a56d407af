"""Filling leaf quotas from arriving products, with progress kept across runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfspark.operators.leaves import fill_quota, with_targets
from shelfspark.session import materialize
from shelfspark.sinks.tables import children, delete


def _held(spark: SparkSession, progress: str, batch_id: int) -> DataFrame:
    """(leaf, held) after the batches before ``batch_id``: the newest count table of theirs, none of the rows that it counts."""
    schema = "leaf string, held bigint"
    earlier = [n for n in (int(name.split("=")[1]) for name in children(spark, progress, "batch=")) if n < batch_id]
    if not earlier:
        return spark.createDataFrame([], schema)
    newest = max(earlier)
    for old in earlier:
        if old < newest:  # a replay never goes back behind the last committed batch
            delete(spark, f"{progress}/batch={old}")
    return spark.read.schema(schema).parquet(f"{progress}/batch={newest}")


def quota_stream(feed: DataFrame, targets: DataFrame, out: str, checkpoint: str,
                 product: str = "product_id", seed: int = 0) -> StreamingQuery:
    """Accept arriving products of each leaf until its ``target``; what earlier batches accepted counts.

    A product counts once per leaf, when it first arrives (of copies in one batch any one stands for all), so how many a leaf accepts does not
    depend on how its arrivals fall into batches; rows without a leaf have no quota and are left out. Which (leaf, product) have been seen is
    keyed state of the stream, spread by both, so that a hot leaf lies in every partition of it. How many a leaf holds is a
    table of one row a leaf, written by each batch beside the checkpoint and read by the next. No accepted row is read again. A replayed batch
    meets the same state and the same counts, and replaces what it wrote. Inside a batch leaves are cut by prefix counts (:func:`fill_quota`).
    """
    progress = f"{checkpoint.rstrip('/')}-held"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        arrived = materialize(batch, "arrivals")
        held = _held(spark, progress, batch_id)
        leaves = with_targets(arrived.select("leaf").distinct(), targets, seed).join(held, "leaf", "left")
        left = leaves.select("leaf", (F.col("target") - F.coalesce("held", F.lit(0))).alias("target"))
        candidates = arrived.withColumn("phase", F.lit(1)) if "phase" not in batch.columns else arrived
        accepted = fill_quota(candidates, materialize(left, "open"), product, seed)
        accepted.select(*batch.columns).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        taken = spark.read.schema(batch.schema).parquet(f"{out}/batch={batch_id}").groupBy("leaf").agg(F.count(F.lit(1)).alias("held"))
        counts = held.unionByName(taken).groupBy("leaf").agg(F.sum("held").alias("held"))
        counts.write.mode("overwrite").parquet(f"{progress}/batch={batch_id}")

    first = feed.filter(F.col("leaf").isNotNull()).dropDuplicates(["leaf", product])
    return (first.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
