"""The cleaning pipeline: duplicates, text, dates, required columns, defaults, in that order.

Missing text stays missing, so a row without a required text is dropped.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.calendar import moment_of
from ..schemas import CLEAN_DATES, CLEAN_REQUIRED, CLEAN_TEXT, CLEAN_ZERO_WHEN_MISSING, SCHEMAS, TEXT_LENGTHS
from ..session import shared_folder
from ..sources.files import csv_names, read_csv_text, typed_text, write_csv, write_table
from ..sources.inference import as_type, infer_types, present
from ..sources.tables import Tables

# Any white space, not only the blank that trim() removes.
_OUTER_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


REJECTED = "_rejected"

def _present(df: DataFrame, columns: list[str]) -> list[str]:
    return [c for c in columns if c in df.columns]


def drop_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def clean_text(df: DataFrame, name: str) -> DataFrame:
    """Strip the table's text columns and lower-case e-mail addresses."""
    trimmed = {c: F.regexp_replace(c, _OUTER_SPACE, "") for c in _present(df, CLEAN_TEXT.get(name, []))}
    if "email" in trimmed:
        trimmed["email"] = F.lower(trimmed["email"])
    return df.withColumns(trimmed) if trimmed else df


def parse_dates(df: DataFrame, name: str) -> DataFrame:
    """Turn the table's date columns into dates and timestamps; text that is neither becomes NULL."""

    def parsed(column: str) -> Column:
        moment = moment_of(F.col(column))
        return F.to_date(moment) if isinstance(SCHEMAS[name][column].dataType, T.DateType) else moment

    dates = {c: parsed(c) for c in _present(df, CLEAN_DATES.get(name, []))}
    return df.withColumns(dates) if dates else df


def drop_missing_required(df: DataFrame, name: str) -> DataFrame:
    required = _present(df, CLEAN_REQUIRED.get(name, []))
    return df.dropna(subset=required) if required else df


def fill_defaults(df: DataFrame) -> DataFrame:
    columns = _present(df, CLEAN_ZERO_WHEN_MISSING)
    return df.fillna(0, subset=columns) if columns else df


def clean_table(df: DataFrame, name: str) -> DataFrame:
    return (
        df.transform(drop_duplicates)
        .transform(clean_text, name)
        .transform(parse_dates, name)
        .transform(drop_missing_required, name)
        .transform(fill_defaults)
    )


def report_table(df: DataFrame, name: str) -> DataFrame:
    """Row counts before and after cleaning, from one pass: equal rows are counted while they are merged."""
    required = _present(df, CLEAN_REQUIRED.get(name, []))
    merged = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
    checked = parse_dates(clean_text(merged, name), name)
    missing = reduce(Column.__or__, [F.col(c).isNull() for c in required], F.lit(False))

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value), F.lit(0)).cast("bigint")

    return checked.agg(
        total(F.col("_copies")).alias("rows_in"),
        total(F.col("_copies") - 1).alias("duplicates_removed"),
        total(F.when(missing, 1).otherwise(0)).alias("rows_dropped_missing_required"),
        total(F.when(missing, 0).otherwise(1)).alias("rows_out"),
    ).select(F.lit(name).alias("table_name"), "*")


def report(t: Tables, names: list[str]) -> DataFrame:
    return reduce(DataFrame.unionByName, [report_table(t[name], name) for name in names])


def typed_leniently(text: DataFrame, name: str) -> DataFrame:
    """Text columns as the types of the table's columns, dates still as text; values that do not fit are listed in
    ``REJECTED`` and are NULL.  Markers of missing values are NULL everywhere.  Columns that no schema describes get the
    least type that all of their values fit, which takes a pass over them before."""
    dates = CLEAN_DATES.get(name, [])
    types = {f.name: f for f in SCHEMAS.get(name, T.StructType()) if f.name not in dates}
    inferred = infer_types(text, [c for c in text.columns if c not in types and c not in dates])
    kinds = {f.name: f.dataType for f in inferred}
    known = text.select(*[present(F.col(c)).alias(c) for c in text.columns])
    known = clean_text(known, name)  # outer blanks do not make a text too long
    typed = {
        c: typed_text(types[c], strict=False, longest=TEXT_LENGTHS.get((name, c))) if c in types
        else as_type(F.col(c), kinds.get(c, T.StringType()))
        for c in text.columns
    }
    unfit = [
        F.when(F.col(c).isNotNull() & typed[c].isNull(), F.concat(F.lit(f"{c}: "), F.col(c))) for c in text.columns if c in types
    ]
    return known.select(*[typed[c].alias(c) for c in text.columns], F.concat_ws("; ", *unfit).alias(REJECTED))


def clean_csv(spark: SparkSession, source: str, target: str, name: str, as_csv: bool = False) -> tuple:
    """Clean ``source/name.csv`` into ``target`` in one pass over the file; returns the table's line of the report.

    Equal rows are merged and counted, rows are cleaned, and all counts are observed while the result is staged in the
    shared folder: kept rows, and rejected rows with the reason.  The staged rows are then moved to ``target``, those
    rejected to ``target/rejected/name``.
    """
    text = read_csv_text(spark, f"{source}/{name}.csv")
    columns = text.columns
    merged = typed_leniently(text, name).groupBy(*columns, REJECTED).agg(F.count(F.lit(1)).alias("_copies"))
    checked = parse_dates(clean_text(merged, name), name)
    missing = reduce(Column.__or__, [F.col(c).isNull() for c in _present(checked, CLEAN_REQUIRED.get(name, []))], F.lit(False))
    kind = F.when(F.col(REJECTED) != "", "rejected").when(missing, "incomplete").otherwise("kept")
    seen = Observation()

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value), F.lit(0)).cast("bigint")

    counted = checked.withColumn("_kind", kind).observe(
        seen, total(F.col("_copies")).alias("rows_in"), total(F.col("_copies") - 1).alias("duplicates_removed"),
        *[total((F.col("_kind") == k).cast("int")).alias(k) for k in ("rejected", "incomplete", "kept")],
    )
    staged = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    out = counted.filter(F.col("_kind") != "incomplete").drop("_copies")
    out.write.partitionBy("_kind").parquet(staged)
    schema = T.StructType([f for f in out.schema if f.name != "_kind"] + [T.StructField("_kind", T.StringType())])
    rows = spark.read.schema(schema).parquet(staged)
    kept = fill_defaults(rows.filter("_kind = 'kept'").drop("_kind", REJECTED))
    (write_csv if as_csv else write_table)(kept, target, name)
    rows.filter("_kind = 'rejected'").drop("_kind").write.mode("overwrite").parquet(f"{target}/rejected/{name}")
    counts = seen.get
    return (name, counts["rows_in"], counts["duplicates_removed"], counts["rejected"], counts["incomplete"], counts["kept"])


def clean_csv_folder(
    spark: SparkSession, source: str, target: str, names: list[str] | None = None, as_csv: bool = False
) -> DataFrame:
    """Clean the named CSV tables, or all that ``source`` has, into ``target``; returns the report."""
    lines = [clean_csv(spark, source, target, name, as_csv) for name in names or csv_names(spark, source)]
    return spark.createDataFrame(
        lines, "table_name string, rows_in bigint, duplicates_removed bigint, rows_rejected bigint, "
        "rows_dropped_missing_required bigint, rows_out bigint",
    )


def rejected(spark: SparkSession, target: str, name: str) -> DataFrame:
    """Rows that the cleaner could not read as the table's types, with the reason in ``REJECTED``."""
    return spark.read.parquet(f"{target}/rejected/{name}")
