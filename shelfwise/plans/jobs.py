"""Jobs that write: the monthly revenue refresh and the low-stock alerts."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..sources.files import parquet_tables
from ..sources.tables import Tables
from . import alerts, views


def refresh_monthly_city_revenue(
    spark: SparkSession, t: Tables, folder: str, view: str = "monthly_city_revenue",
    months: list[str] | None = None, previous: str | None = None,
) -> str:
    """Rebuild the stored monthly table and point ``view`` at it; returns the new path.

    Each refresh writes a folder of its own and moves the view afterwards, so readers of the old version are
    never blocked or left with half a table.  With ``months`` only those are computed, and the other months
    are carried over from the ``previous`` path.
    """
    if months is None:
        fresh = views.monthly_city_revenue(t)
    else:
        if previous is None:
            raise ValueError("a refresh of some months needs the previous version")
        kept = spark.read.parquet(previous).filter(~F.col("order_month").isin(months))
        fresh = kept.unionByName(views.monthly_city_revenue(t, months))
    path = f"{folder}/monthly_city_revenue/{uuid.uuid4().hex}"
    fresh.write.parquet(path)
    spark.sql(f"CREATE OR REPLACE VIEW {view} AS SELECT * FROM parquet.`{path}`")
    return path


def refresh_stored_months(
    spark: SparkSession, stored: str, folder: str, months: list[str], previous: str, view: str = "monthly_city_revenue"
) -> str:
    """Refresh some months from the tables stored in a folder; other months' files are not opened."""
    return refresh_monthly_city_revenue(spark, parquet_tables(spark, stored, months), folder, view, months, previous)


def flag_low_stock(t: Tables, folder: str, run: str | None = None) -> str:
    """Append an alert for every store and product at or below its reorder level; returns the table's path.

    A ``run`` (say, its date) is appended once, also when it is tried again; without one, every call is a run of its own.
    """
    path, low = f"{folder}/low_stock_alerts", alerts.low_stock(t)
    alerts.append_alerts(low.sparkSession, low, path, run or uuid.uuid4().hex)
    return path


read_alerts = alerts.read_alerts
