"""Low-stock alerts, appended once per run however often the run is tried.

Alerts are stored under their run and attempt.  An attempt that has written all of its rows enters itself in a ledger, a small
table with one row per committed attempt; the first attempt of a run that did so counts.  Readers join the stored rows with
the ledger, so rows of attempts that broke off, or that lost to another attempt at the same time, are never seen, and the
folders of such attempts are not opened.  A run that is in the ledger already is not computed again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import SCHEMAS
from ..sources.tables import Tables
from . import views

LEDGER = "run string, attempt string, alerts bigint, committed_at timestamp"
_STORED = T.StructType([*SCHEMAS["low_stock_alerts"].fields, T.StructField("run", T.StringType()), T.StructField("attempt", T.StringType())])


def _exists(spark: SparkSession, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """The attempt that counts of every run: ``run, attempt, alerts, committed_at``."""
    if not _exists(spark, f"{path}/ledger"):
        return spark.createDataFrame([], LEDGER)
    entries = spark.read.schema(LEDGER).parquet(f"{path}/ledger")
    place = F.row_number().over(Window.partitionBy("run").orderBy("committed_at", "attempt"))  # a run has few attempts
    return entries.withColumn("_place", place).filter(F.col("_place") == 1).drop("_place")


def low_stock(t: Tables) -> DataFrame:
    return views.product_inventory_health(t).filter("needs_reorder").select(
        "store_id", "product_id", "closing_stock", "reorder_level"
    )


def append_alerts(spark: SparkSession, alerts: DataFrame, path: str, run: str) -> bool:
    """Append the alerts of a run; False, and nothing done, if the run is committed already."""
    if not ledger(spark, path).filter(F.col("run") == run).isEmpty():
        return False
    attempt = uuid.uuid4().hex
    stamped = alerts.withColumns({"flagged_at": F.localtimestamp(), "run": F.lit(run), "attempt": F.lit(attempt)})
    stamped.write.mode("append").partitionBy("run", "attempt").parquet(f"{path}/rows")
    written = spark.read.schema(_STORED).parquet(f"{path}/rows").filter((F.col("run") == run) & (F.col("attempt") == attempt))
    entry = written.agg(F.count(F.lit(1)).alias("alerts")).select(
        F.lit(run).alias("run"), F.lit(attempt).alias("attempt"), "alerts", F.current_timestamp().alias("committed_at")
    )
    entry.write.mode("append").parquet(f"{path}/ledger")
    return True


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    """The alerts of all committed runs."""
    if not _exists(spark, f"{path}/rows"):
        return spark.createDataFrame([], SCHEMAS["low_stock_alerts"])
    rows = spark.read.schema(_STORED).parquet(f"{path}/rows")
    counted = ledger(spark, path).select("run", "attempt")
    return rows.join(counted, ["run", "attempt"], "left_semi").select(SCHEMAS["low_stock_alerts"].fieldNames())
