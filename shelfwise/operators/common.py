"""Pieces that several questions share.

Facts are aggregated by id before names are joined on: the join then sees one row per id, whatever the
share of a single store, product or customer.  No join carries a broadcast hint on a table that grows with
the data; Spark broadcasts a side when its size is below ``spark.sql.autoBroadcastJoinThreshold``, and
shuffles otherwise.  Distinct ids are counted exactly; where ``Tables.unique`` knows an id to be unique, its rows are
counted instead and the id column is not even read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.distinct import memberships
from ..functions.exact import count_where
from ..sources.tables import Tables

COMPLETED = ["Delivered", "Delayed"]


def delivered_orders(t: Tables) -> DataFrame:
    return t["orders"].filter(F.col("order_status") == "Delivered")


def completed_deliveries(t: Tables) -> DataFrame:
    return t["deliveries"].filter(F.col("delivery_status").isin(COMPLETED))


def completed_with_store(t: Tables) -> DataFrame:
    """Completed deliveries with the store that packed the order."""
    return completed_deliveries(t).join(t["orders"].select("order_id", "store_id"), "order_id")


def on_time() -> Column:
    """A delivery without an actual time is not on time."""
    return F.col("actual_time_mins") <= F.col("promised_time_mins")


def delay() -> Column:
    return F.col("actual_time_mins") - F.col("promised_time_mins")


def store_names(t: Tables) -> DataFrame:
    return t["dark_stores"].select("store_id", "store_name")


def stores_with_city(t: Tables) -> DataFrame:
    return t["dark_stores"].select("store_id", "store_name", "city_id").join(t["cities"], "city_id")


def product_names(t: Tables) -> DataFrame:
    return t["products"].select("product_id", "product_name")


def revenue_by_store(t: Tables) -> DataFrame:
    """Delivered revenue and order count per store."""
    return delivered_orders(t).groupBy("store_id").agg(
        F.sum("total_amount").alias("revenue"), F.count(F.lit(1)).alias("orders")
    )


def delivered_order_places(t: Tables, **groups: Column) -> DataFrame:
    """Sets of stores, and of further ``groups``, that delivered orders stand in, with the number of orders of each set."""
    return memberships(
        delivered_orders(t), "order_id", {"store_id": F.col("store_id"), **groups}, unique="orders" in t.unique
    )


def delivery_counts_by_store(t: Tables) -> DataFrame:
    """Completed and on-time deliveries and the sum of delays per store."""
    return (
        completed_with_store(t)
        .groupBy("store_id")
        .agg(
            F.count(F.lit(1)).alias("trips"),
            count_where(on_time()).alias("on_time_trips"),
            F.sum(delay()).alias("delay_sum"),
            F.count(delay()).alias("delay_count"),
        )
    )


def stock_totals_by_store(t: Tables) -> DataFrame:
    return t["inventory"].groupBy("store_id").agg(
        F.sum("units_sold").alias("sold"),
        F.sum(F.col("opening_stock") + F.col("units_received")).alias("available"),
    )


def sales_by_product(t: Tables) -> DataFrame:
    """Units and revenue of delivered order lines per product."""
    return (
        t["order_items"]
        .select("order_id", "product_id", "quantity", "line_total")
        .join(delivered_orders(t).select("order_id"), "order_id")
        .groupBy("product_id")
        .agg(F.sum("quantity").alias("units_sold"), F.sum("line_total").alias("revenue"))
    )


def latest_stock(t: Tables) -> DataFrame:
    """The newest snapshot of every store and product.

    ``max_by`` combines within each task before the shuffle, which a row-number window cannot.  Dates are
    unique per store and product, so all columns come from the same snapshot.
    """
    return t["inventory"].groupBy("store_id", "product_id").agg(
        F.max_by("closing_stock", "stock_date").alias("closing_stock"),
        F.max_by("reorder_level", "stock_date").alias("reorder_level"),
        F.max("stock_date").alias("stock_date"),
    )


def left_lookup(rows: DataFrame, dimension: DataFrame, key: str, spread: str) -> DataFrame:
    """Left join on an id that may be missing.

    A shuffle would send all rows without the id to one task, so they get keys of their own made from the id
    column ``spread``; whatever such a key happens to find is discarded.
    """
    values = [c for c in dimension.columns if c != key]
    own_key = F.coalesce(F.col(key), -F.col(spread) - 1)
    joined = rows.withColumn("_key", own_key).join(dimension.withColumnRenamed(key, "_key"), "_key", "left")
    return joined.drop("_key").withColumns({c: F.when(F.col(key).isNotNull(), F.col(c)) for c in values})
