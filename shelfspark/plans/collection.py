"""Collection of product documents and their images into one collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfspark.functions.text import jpg_name
from shelfspark.operators.clean import clean_records
from shelfspark.operators.matching import ingest_status
from shelfspark.operators.upsert import fold_rows, upsert
from shelfspark.session import materialize
from shelfspark.sinks.tables import log_changes, read_changes
from shelfspark.sources.documents import checkpoint_of, parse_documents
from shelfspark.sources.file_ledger import listed, pending, record, texts


def with_status(incoming: DataFrame, collection: DataFrame, files: DataFrame) -> DataFrame:
    """Incoming documents with what the collection and the image folder say about them."""
    return ingest_status(incoming.drop("image_path"), checkpoint_of(collection), files)


def collect(incoming: DataFrame, collection: DataFrame, files: DataFrame, bucket: str = "products-images") -> DataFrame:
    """The collection after taking in what is new or has an image at last; documents are identified by file."""
    todo = with_status(incoming, collection, files).filter(F.col("status").isin("new", "update"))
    cleaned = clean_records(todo).withColumn(
        "image_path", F.when(F.col("image_file").isNotNull(),
                             F.concat(F.lit(f"{bucket}/"), jpg_name(F.col("image_file")))))
    return upsert(collection, cleaned.drop("image_file", "status", "body"), ["source_file"])


def ingest_folder(spark: SparkSession, folder: str, out: str, run: int, pattern: str = "*.json") -> None:
    """Take the files of a folder that no earlier run has taken, and store their documents, what was taken, and a report.

    Files are listed and met with the ledger before any is opened. Documents go to a change log under the number of the run; files that are no
    documents count as taken too and are read again only when they change. The ledger is written after the documents, so a run that was lost
    between the two is repeated under its number, and replaces what it stored.
    """
    files = materialize(listed(spark, folder, pattern), "listed")
    new = materialize(pending(files, f"{out}/ledger", run), "pending")
    parsed = materialize(parse_documents(texts(new)), "parsed")
    log_changes(parsed.filter("body IS NOT NULL"), f"{out}/log", run)
    record(new, f"{out}/ledger", run)
    none = F.lit(0).cast("bigint")
    counts = (files.agg(F.count(F.lit(1)).alias("scanned")).select("scanned", none.alias("taken"), none.alias("collected"))
              .unionByName(new.agg(F.count(F.lit(1)).alias("taken")).select(none.alias("scanned"), "taken", none.alias("collected")))
              .unionByName(parsed.agg(F.count("body").alias("collected")).select(none.alias("scanned"), none.alias("taken"), "collected"))
              .agg(*[F.sum(c).alias(c) for c in ("scanned", "taken", "collected")]))
    report = counts.select("scanned", "collected", (F.col("scanned") - F.col("taken")).alias("skipped"), (F.col("taken") - F.col("collected")).alias("broken"))
    report.coalesce(1).write.mode("overwrite").parquet(f"{out}/report/run={run}")


def folder_documents(spark: SparkSession, out: str) -> DataFrame:
    """The newest document of each file that :func:`ingest_folder` has taken, as a whole."""
    return fold_rows(read_changes(spark, f"{out}/log"), ["source_file"], ["batch"])


def folder_report(spark: SparkSession, out: str) -> DataFrame:
    """(run, scanned, collected, skipped, broken): files listed, documents stored, files known already and files that are no documents, a row a run."""
    return spark.read.schema("scanned bigint, collected bigint, skipped bigint, broken bigint, run bigint").parquet(f"{out}/report")
