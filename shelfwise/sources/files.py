"""CSV and Parquet tables with fixed schemas."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import SCHEMAS, TEXT_LENGTHS
from ..session import stored_table, tasks_for
from .inference import infer_types, typed
from .tables import Tables

BASE_TABLES = [name for name in SCHEMAS if name != "low_stock_alerts"]

# Facts are stored by month, so date filters and refreshes read only the months they need.
MONTH_OF = {"orders": "order_datetime", "inventory": "stock_date"}

# In a catalog, tables are stored in buckets of the key they are joined or windowed on, so that neither needs
# a shuffle.
BUCKETS_OF = {
    "orders": ["order_id"],
    "order_items": ["order_id"],
    "deliveries": ["order_id"],
    "payments": ["order_id"],
    "inventory": ["store_id", "product_id"],
}


def read_csv_text(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file, or a folder of parts, with its columns by their names in the header and all values as text.

    Every part's header is checked against the first one's.
    """
    header = spark.read.csv(path, header=True, escape='"').columns
    schema = T.StructType([T.StructField(name, T.StringType(), True) for name in header])
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=False, escape='"', mode="FAILFAST")


def whole_number_text(column: Column) -> Column:
    """Whole numbers may be written as ``2.0``."""
    return F.regexp_replace(column, r"^(\s*[+-]?[0-9]+)\.0*(\s*)$", "$1$2")


def typed_text(field: T.StructField, strict: bool = True, longest: int | None = None) -> Column:
    """The text column of a field as its type; a value that does not fit stops the job, or is NULL if not ``strict``.

    Text of more than ``longest`` characters does not fit.
    """
    text = F.col(field.name)
    if longest is not None:
        refused = F.raise_error(F.concat(F.lit(f"{field.name} is longer than {longest}: "), text)) if strict else F.lit(None)
        text = F.when(F.length(text) > longest, refused).otherwise(text)
    if isinstance(field.dataType, T.IntegralType):
        text = whole_number_text(text)
    return (text.cast(field.dataType) if strict else text.try_cast(field.dataType)).alias(field.name)


def read_csv(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Read ``folder/name.csv`` with the table's schema, its columns found by name in any order.

    A missing column, or a value that does not fit its column, stops the job; further columns are not read.
    """
    df = read_csv_text(spark, f"{folder}/{name}.csv")
    if missing := [c for c in SCHEMAS[name].fieldNames() if c not in df.columns]:
        raise ValueError(f"{folder}/{name}.csv has no column {', '.join(missing)}")
    return df.select([typed_text(f, longest=TEXT_LENGTHS.get((name, f.name))) for f in SCHEMAS[name]])


def read_csv_inferred(spark: SparkSession, path: str, times: bool = False) -> DataFrame:
    """A CSV file, or a folder of parts, that no schema describes: types from a pass over all of its values."""
    text = read_csv_text(spark, path)
    return typed(text, infer_types(text, times=times))


def csv_names(spark: SparkSession, folder: str) -> list[str]:
    """Names of the CSV files, or folders of parts, in a folder that any of Spark's file systems holds."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/*.csv")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted(status.getPath().getName().removesuffix(".csv") for status in found)


def write_csv(df: DataFrame, folder: str, name: str) -> None:
    """Replace a CSV table; text keeps its outer blanks and times their microseconds."""
    options = {
        "header": True,
        "escape": '"',
        "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS",
        "ignoreLeadingWhiteSpace": False,
        "ignoreTrailingWhiteSpace": False,
    }
    df.write.mode("overwrite").options(**options).csv(f"{folder}/{name}.csv")


def write_table(df: DataFrame, folder: str, name: str) -> None:
    """Replace a Parquet table; orders and inventory are split by month."""
    path = f"{folder}/{name}"
    if name in MONTH_OF:
        month = F.date_format(MONTH_OF[name], "yyyy-MM").alias("month")
        # Months go to different tasks, but a large month to several of them.
        writer = df.select("*", month).hint("rebalance", "month").write.partitionBy("month")
    else:
        writer = df.write
    writer.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)


def read_table(spark: SparkSession, folder: str, name: str, months: list[str] | None = None) -> DataFrame:
    """A stored table; of one that is split by month only the given ``months`` (``yyyy-MM``), if any are."""
    schema = SCHEMAS[name]
    if name not in MONTH_OF:
        return spark.read.schema(schema).parquet(f"{folder}/{name}")
    stored = spark.read.schema(T.StructType([*schema.fields, T.StructField("month", T.StringType(), True)]))
    df = stored.parquet(f"{folder}/{name}")
    if months is not None:
        df = df.filter(F.col("month").isin(months))  # a filter on folders: other months are not opened
    return df.select(schema.fieldNames())


def load_csv_folder(spark: SparkSession, csv_folder: str, folder: str, names: Iterable[str] | None = None) -> None:
    """Bulk load of the named tables, or of those the folder has: parents before children, each replaced as a whole."""
    wanted = set(csv_names(spark, csv_folder) if names is None else names)
    if unknown := sorted(wanted - set(BASE_TABLES)):
        raise ValueError(f"no table for {', '.join(unknown)}")
    for name in BASE_TABLES:
        if name in wanted:
            write_table(read_csv(spark, csv_folder, name), folder, name)


def parquet_tables(spark: SparkSession, folder: str, months: list[str] | None = None) -> Tables:
    """The stored tables, orders and inventory of the given months only, if any are."""
    return Tables({name: lambda _t, name=name: read_table(spark, folder, name, months) for name in BASE_TABLES})


def csv_tables(spark: SparkSession, folder: str) -> Tables:
    return Tables({name: lambda _t, name=name: read_csv(spark, folder, name) for name in BASE_TABLES})


def _definition(name: str) -> str:
    """The table's columns for the catalog, texts with their bounds."""
    kinds = {f.name: f.dataType.simpleString() for f in SCHEMAS[name]}
    bounded = {column: f"VARCHAR({n})" for (table, column), n in TEXT_LENGTHS.items() if table == name}
    return ", ".join(f"{column} {kind}" for column, kind in {**kinds, **bounded}.items())


def save_tables(t: Tables, database: str, buckets: int, names: Iterable[str] = BASE_TABLES) -> None:
    """Store tables in a catalog database, parents first, the large ones in sorted buckets.

    There are ``buckets`` of them, or more, so that a bucket's rows stay few however large a table is.  Tables with the same
    key get the same number.  Bucketed tables are staged in the shared folder, where their rows are counted from the files.

    Texts have the lengths of the schema there: a longer one stops the job, and the table of before stays.  A session that
    has read a table before must refresh it to see the new one.
    """
    wanted = [known for known in BASE_TABLES if known in names]
    frames, number = {name: t[name].select(SCHEMAS[name].fieldNames()) for name in wanted}, {}
    for name, keys in BUCKETS_OF.items():
        if name in wanted:
            frames[name] = stored_table(frames[name])
            number[*keys] = max(number.get((*keys,), buckets), tasks_for(frames[name].count()))
    for name in wanted:
        df, keys, fresh = frames[name], BUCKETS_OF.get(name), f"{database}.{name}__fresh"
        spark, by, into = df.sparkSession, ", ".join(keys or []), number.get((*(keys or []),))
        clustered = f"CLUSTERED BY ({by}) SORTED BY ({by}) INTO {into} BUCKETS" if keys else ""
        spark.sql(f"DROP TABLE IF EXISTS {fresh}")
        spark.sql(f"CREATE TABLE {fresh} ({_definition(name)}) USING parquet {clustered}")
        (df.repartition(into, *keys) if keys else df).write.insertInto(fresh)
        spark.sql(f"DROP TABLE IF EXISTS {database}.{name}")
        spark.sql(f"ALTER TABLE {fresh} RENAME TO {database}.{name}")


def catalog_tables(spark: SparkSession, database: str) -> Tables:
    return Tables({name: lambda _t, name=name: spark.table(f"{database}.{name}") for name in BASE_TABLES})


def register_views(tables: Tables) -> None:
    """Make every table visible to ``spark.sql``."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
