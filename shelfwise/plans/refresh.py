"""A refresh that finds its own changes, and keeps a few versions.

Every version of the monthly revenue is a folder ``v<number>-<random>`` with the table, the manifest of the files it was made
from, and a mark that it is whole.  A manifest is a table of the stored files: the table they belong to, their month, path,
length and time.  It is made and compared by Spark, without opening a file.  A refresh lists the files first, takes the
difference to the manifest of the newest version, computes the months in which a file came, went or changed, and carries the
other months over from that version.  A changed file of a table that is not stored by month (cities, stores) changes all
months.  A file that changes while the refresh runs is found by the next one.

The view is moved when a version is whole.  Versions without a mark are never read; of the others the newest few stay, for
readers that still hold them.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import MONTH_OF, parquet_tables
from . import views

#: The stored tables that the monthly revenue is made from.
SOURCES = ("orders", "dark_stores", "cities")
MANIFEST = "table_name string, month string, path string, length bigint, modified timestamp"
_VERSION = re.compile(r"v(\d{8})-[0-9a-f]{32}")
_WHOLE = "whole"


@dataclass(frozen=True)
class Refresh:
    """``months`` are those computed: ``None`` for all, none if nothing had changed and the version is the one before."""

    path: str
    months: list[str] | None


def manifest(spark: SparkSession, stored: str, names: tuple[str, ...] = SOURCES) -> DataFrame:
    """The files of stored tables.  Listing and comparing is Spark's work; of a file only its status is read."""

    def files(name: str) -> DataFrame:
        listed = (
            spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
            .load(f"{stored}/{name}").select("path", "length", F.col("modificationTime").alias("modified"))
        )
        month = F.regexp_extract("path", r"/month=([^/]+)/[^/]+$", 1) if name in MONTH_OF else F.lit(None).cast("string")
        return listed.select(F.lit(name).alias("table_name"), month.alias("month"), "path", "length", "modified")

    return reduce(DataFrame.unionByName, [files(name) for name in names])


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(table_name, month)`` in which a file came, went, or has another length or time."""
    key, state = ["table_name", "month", "path"], ["length", "modified"]
    tagged = before.select(*key, *state, F.lit(0).alias("side")).unionByName(after.select(*key, *state, F.lit(1).alias("side")))
    per_file = tagged.groupBy(*key).agg(
        F.count(F.lit(1)).alias("sides"), *[F.min(c).alias(f"least_{c}") for c in state], *[F.max(c).alias(f"most_{c}") for c in state]
    )
    same = (F.col("sides") == 2) & (F.col("least_length") == F.col("most_length")) & (F.col("least_modified") == F.col("most_modified"))
    return per_file.filter(~same).select("table_name", "month").distinct()


def _folder(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def _all_versions(spark: SparkSession, folder: str) -> list[str]:
    system, base = _folder(spark, folder)
    names = sorted(status.getPath().getName() for status in system.listStatus(base)) if system.exists(base) else []
    return [f"{folder}/{name}" for name in names if _VERSION.fullmatch(name)]


def versions(spark: SparkSession, folder: str) -> list[str]:
    """Paths of the whole versions, oldest first."""
    return [path for path in _all_versions(spark, folder) if _folder(spark, path)[0].exists(_folder(spark, f"{path}/{_WHOLE}")[1])]


def table_of(spark: SparkSession, version: str) -> DataFrame:
    return spark.read.parquet(f"{version}/table")


def _expire(spark: SparkSession, folder: str, keep: int) -> None:
    """Remove all versions older than the newest ``keep`` whole ones, also those that broke off.

    The mark goes first, so that no one takes half a version for whole.
    """
    oldest = versions(spark, folder)[-keep:][0]
    for version in _all_versions(spark, folder):
        if version < oldest:
            for path in (f"{version}/{_WHOLE}", version):
                system, gone = _folder(spark, path)
                system.delete(gone, True)


def refresh_changed(
    spark: SparkSession, stored: str, folder: str, view: str = "monthly_city_revenue", keep: int = 3
) -> Refresh:
    """Bring the monthly revenue of the tables in ``stored`` up to date in a new version under ``folder``; move ``view`` to it."""
    if keep < 1:
        raise ValueError("at least the newest version stays")
    files = manifest(spark, stored)
    known = versions(spark, folder)
    path = f"{folder}/v{_next(known):08d}-{uuid.uuid4().hex}"
    files.write.parquet(f"{path}/manifest")  # the state before any row is read
    now = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    months: list[str] | None = None
    if known:
        before = spark.read.schema(MANIFEST).parquet(f"{known[-1]}/manifest")
        changed = [(row["table_name"], row["month"]) for row in changes(before, now).collect()]  # a row per month at most
        if all(name in MONTH_OF for name, _ in changed):
            months = sorted({month for _, month in changed})
    if months == []:
        system, unused = _folder(spark, path)
        system.delete(unused, True)
        path = known[-1]
    else:
        fresh = views.monthly_city_revenue(parquet_tables(spark, stored, months), months)
        if months is not None:
            kept = table_of(spark, known[-1]).filter(~F.col("order_month").isin(months))
            fresh = kept.unionByName(fresh)
        fresh.write.parquet(f"{path}/table")
        system, mark = _folder(spark, f"{path}/{_WHOLE}")
        system.mkdirs(mark)
    spark.sql(f"CREATE OR REPLACE VIEW {view} AS SELECT * FROM parquet.`{path}/table`")
    _expire(spark, folder, keep)
    return Refresh(path, months)


def _next(known: list[str]) -> int:
    return 1 + (int(_VERSION.fullmatch(known[-1].rsplit("/", 1)[1])[1]) if known else 0)
