"""Streaming queries, each run to the end of its input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfspark.session import scratch_path
from shelfspark.sinks.tables import current
from shelfspark.sinks.vector_index import ensure_index, publish, publish_packed
from shelfspark.streaming.checkout import checkout_stream, read_carts, read_items
from shelfspark.streaming.ingest import distinct_stream, ingest, read_report
from shelfspark.streaming.quota import quota_stream
from shelfspark.suite.adapters import baskets, cte, index_vectors, table, view


def _as_stream(df: DataFrame, files: int, label: str, *order: str) -> DataFrame:
    """The rows as a file stream of several batches."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.repartitionByRange(files, *order).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(path)


def _drain(query) -> None:
    query.awaitTermination()


def stream_ingest_equals_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Events upserted by user and type as they arrive; the last non-null value of each column stays."""
    rows = view(spark, sf, "event_rows").select(
        "event_id", "user_id", "event_type", F.when(F.col("value") >= 1, F.col("value")).alias("value"), "outcome")
    feed = _as_stream(rows, 4, "events", "event_id")
    out = scratch_path(spark, "log")
    _drain(ingest(feed, f"{out}/log", f"{out}/checkpoint"))
    return current(spark, f"{out}/log", ["user_id", "event_type"], version=["event_id"])


def _arrivals(rows: DataFrame, batches: int, label: str, run) -> None:
    """Rows appended to a feed by their column ``arrival``, which is dropped; ``run`` gets the feed after each and so starts anew on the same checkpoint."""
    spark = rows.sparkSession
    path = scratch_path(spark, label)
    for arrival in range(batches):
        rows.filter(F.col("arrival") == arrival).drop("arrival").write.mode("append").parquet(path)
        _drain(run(spark.readStream.schema(rows.drop("arrival").schema).parquet(path)))


def stream_ingest_report(spark, sf):
    """Events in three runs, of which those of some value are taken; what each batch scanned, took and skipped."""
    rows = table(spark, sf, "events").select("event_id", "user_id", "value", (F.col("event_id") % 3).alias("arrival"))
    out = scratch_path(spark, "reported")
    _arrivals(rows, 3, "events", lambda feed: ingest(
        feed, f"{out}/log", f"{out}/checkpoint", lambda batch: batch.filter("value >= 25"), f"{out}/report"))
    return read_report(spark, f"{out}/report")


#: Share of the events that arrive half a day late, in time to count.
_LATE = "CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 12 HOURS ELSE ts END"


def stream_distinct(spark, sf):
    """First event of each user and type by its time, a day being the delay. Some arrive after younger ones; in the last run copies that lie an hour
    before events of the first days come too late. Groups still open at the end are not sent yet."""
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = events.withColumn("arrival", F.expr(f"CASE WHEN {_LATE} < '2024-01-11' THEN 0 WHEN {_LATE} < '2024-01-21' THEN 1 ELSE 2 END"))
    late = events.filter("ts < '2024-01-05'").select(
        (-F.col("event_id")).alias("event_id"), F.expr("ts - INTERVAL 1 HOUR").alias("ts"), "user_id", "event_type", "value", "props", F.lit(2).alias("arrival"))
    out = scratch_path(spark, "distinct-out")

    def run(feed):
        first = distinct_stream(feed, ["user_id", "event_type"], "ts", "1 day")
        return (first.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint")
                .trigger(availableNow=True).start())

    _arrivals(rows.unionByName(late), 3, "distinct", run)
    return spark.read.parquet(f"{out}/rows").withColumn("ts", F.unix_micros("ts"))


def _published(spark, sf, path: str, batch: int, condition: str = "true") -> None:
    """Vectors of the table as index points, published and packed."""
    vectors = index_vectors(spark, sf).filter(condition)
    ensure_index(spark, path, "objects", 64)
    publish(vectors.withColumn("payload", F.struct(F.col("point_id").cast("string").alias("sub_id"))), path, batch)
    publish_packed(spark, path)


_CARTS = ["cart_id", "n_detections", "n_items", "round(total_price, 2) AS total_price", "n_price_missing", "message"]


def stream_checkout(spark, sf):
    feed = _as_stream(baskets(spark, sf), 4, "baskets", "cart_id")
    out = scratch_path(spark, "carts")
    _published(spark, sf, f"{out}/index", 0)
    _drain(checkout_stream(feed, f"{out}/index", view(spark, sf, "payload"), out, f"{out}/checkpoint"))
    return read_carts(spark, out).selectExpr(*_CARTS)


def stream_checkout_versions(spark, sf):
    """Baskets of even carts arrive while the index holds even points only, those of odd carts after the others were published."""
    out, rows = scratch_path(spark, "carts"), baskets(spark, sf)
    for batch in (0, 1):
        rows.filter(F.col("cart_id") % 2 == batch).write.mode("append").parquet(f"{out}/feed")
        feed = spark.readStream.schema(rows.schema).parquet(f"{out}/feed")
        _published(spark, sf, f"{out}/index", batch, f"point_id % 2 = {batch}")
        _drain(checkout_stream(feed, f"{out}/index", view(spark, sf, "payload"), out, f"{out}/checkpoint"))
    return read_items(spark, out).select("cart_id", "query_id", "point_id", F.round("score", 6).alias("score"))


def stream_quota(spark, sf):
    """Customers arriving in three runs fill their nation's quota; each comes twice at once, and some once more later."""
    rows = table(spark, sf, "customer").selectExpr("concat('N', c_nationkey) AS leaf", "c_custkey AS product_id", "cast(c_custkey % 5 AS int) DIV 2 AS arrival")
    later = rows.filter("arrival < 2 AND product_id % 3 = 0").withColumn("arrival", F.col("arrival") + 1)
    targets = table(spark, sf, "nation").selectExpr("concat('N', n_nationkey) AS leaf", "cast(20 + n_nationkey AS bigint) AS target")
    out = scratch_path(spark, "quota")
    _arrivals(rows.unionByName(rows).unionByName(later), 3, "arrivals",
              lambda feed: quota_stream(feed, targets, f"{out}/accepted", f"{out}/checkpoint"))
    return spark.read.parquet(f"{out}/accepted").groupBy("leaf").agg(F.count(F.lit(1)).alias("n_accepted"), F.count_distinct("product_id").alias("n_products"))


QUERIES = {f.__name__: f for f in (stream_ingest_equals_batch, stream_ingest_report, stream_distinct, stream_checkout, stream_checkout_versions, stream_quota)}

ORACLE = {
    "stream_ingest_equals_batch": cte("event_rows") + """SELECT user_id, event_type, arg_max(value, event_id) FILTER (value >= 1) AS value, arg_max(outcome, event_id) AS outcome
        FROM event_rows GROUP BY user_id, event_type""",
    "stream_checkout_versions": cte("query_vectors", "baskets") + """SELECT cart_id, query_id, point_id, round(score, 6) AS score FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rn FROM (
        SELECT b.cart_id, q.query_id, e.vec_id AS point_id, round(list_cosine_similarity(q.vector::double[], e.embedding::double[]), 9) AS score
        FROM baskets b JOIN query_vectors q USING (query_id) JOIN embeddings e ON b.cart_id % 2 = 1 OR e.vec_id % 2 = 0)) WHERE rn = 1 AND score > 0.6""",
    "stream_ingest_report": """SELECT event_id % 3 AS batch, count(*) AS scanned, count(*) FILTER (value >= 25) AS collected,
        count(*) - count(*) FILTER (value >= 25) AS skipped FROM events GROUP BY event_id % 3""",
    "stream_distinct": """WITH marked AS (SELECT *, coalesce(ts - lag(ts) OVER w > INTERVAL 1 DAY, true) AS starts FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts)),
        grouped AS (SELECT *, sum(starts::int) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g FROM marked),
        closed AS (SELECT user_id, event_type, g, min(ts) AS ts FROM grouped GROUP BY ALL
            HAVING max(ts) + INTERVAL 1 DAY <= (SELECT date_trunc('milliseconds', max(ts)) FROM events) - INTERVAL 1 DAY)
        SELECT event_id, epoch_us(ts) AS ts, user_id, event_type, value, props FROM grouped JOIN closed USING (user_id, event_type, g, ts)""",
    "stream_quota": """SELECT concat('N', c_nationkey) AS leaf, least(count(*), 20 + c_nationkey) AS n_accepted, least(count(*), 20 + c_nationkey) AS n_products
        FROM customer GROUP BY c_nationkey""",
}
