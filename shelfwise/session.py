"""Session settings and lineage cuts shared by every job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows are dealt out by their number, so many to a task, from so many tasks on.
ROWS_PER_TASK, LEAST_TASKS = 250_000, 16

# Settings that matter for these jobs.  Partition sizes stay at Spark's defaults so that the
# cluster's own configuration decides them.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.maxMetadataStringLength": "1000",  # plans name whole paths
}


def build_session(app: str = "shelfwise", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``.  A temporary folder is used only in local
    mode, where driver and executors are one process.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
            folder = tempfile.mkdtemp(prefix="shelfwise-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the stored copy.

    Readers see the same rows in the same partitions even when executors are lost.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored_table(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: computed once, and of a size the planner knows."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks_for(rows: int) -> int:
    return -(-rows // ROWS_PER_TASK)


def dealt_out(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Deal ``rows`` rows out by ``keys``, a bounded number to each task; few rows stay as Spark has them.

    Spark's own partitions follow the cores and the compressed bytes, so the rows that a task holds in memory grow with the
    input.  The given number is kept when partitions are merged at run time.
    """
    tasks = tasks_for(rows)
    return df.repartition(tasks, *keys) if tasks >= LEAST_TASKS else df
