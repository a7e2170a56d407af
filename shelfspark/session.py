"""Session settings and the shared folder in which long lineages are cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folders: dict[str, str] = {}


def build_session(
    app_name: str = "shelfspark", master: str | None = None, conf: dict[str, str] | None = None,
) -> SparkSession:
    """A session with the settings the operators were tuned for; ``conf`` adds to or overrides them.

    AQE must stay on: it coalesces small shuffles, splits skewed join partitions and
    turns a join into a broadcast only when the measured size of a side allows it. Sessions of a stream are merged before
    their shuffle, so a hot key reaches it as a row per task.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **(conf or {}),
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    A temporary folder is used only in local mode with the setting unset.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_folders:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        _own_folders[app] = tempfile.mkdtemp(prefix="shelfspark-")
    return _own_folders[app]


def run_folder(spark: SparkSession) -> str:
    """The run's own folder below the shared one, named for the application."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the run's folder."""
    return f"{run_folder(spark)}/{label}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession, application_id: str | None = None) -> bool:
    """Delete what a run has left in the shared folder, this run's own without ``application_id``. Frames that read it are void then."""
    folder = run_folder(spark) if application_id is None else f"{shared_folder(spark)}/{application_id}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage in a way that survives lost executors, and pins the rows where a
    plan must see the same partitioning twice.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
