"""Views that dashboards and jobs build on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import month_start, year_month
from ..functions.distinct import count_by, ids_and_sums, members, memberships
from ..functions.exact import mean, mean_money, money
from ..operators.common import (
    COMPLETED, delay, delivered_orders, latest_stock, product_names, store_names, stores_with_city,
)
from ..sources.tables import Tables

STORED_MONEY = "decimal(24,2)"


def store_daily_performance(t: Tables) -> DataFrame:
    """Distinct orders, delivered revenue, cancellations and average delay per store and day.

    Revenue is NULL on a day without a delivered order.  Deliveries are summed per order first, so that the left join
    repeats no order, however often one was delivered.
    """
    done = F.when(F.col("delivery_status").isin(COMPLETED), delay())
    deliveries = t["deliveries"].groupBy("order_id").agg(F.sum(done).alias("delay_sum"), F.count(done).alias("delay_count"))
    status = F.col("order_status")
    daily = ids_and_sums(
        t["orders"].join(deliveries, "order_id", "left"), "order_id",
        {"store_id": F.col("store_id"), "order_date": F.to_date("order_datetime")},
        {
            "revenue": F.when(status == "Delivered", F.col("total_amount")),
            "cancelled_orders": F.when(status == "Cancelled", F.lit(1).cast("bigint")).otherwise(0),
            "delay_sum": F.col("delay_sum"),
            "delay_count": F.col("delay_count"),
        },
        unique="orders" in t.unique,
    ).withColumnRenamed("ids", "total_orders")
    return daily.join(stores_with_city(t), "store_id").select(
        "store_id", "store_name", "city_name", "order_date", "total_orders",
        money(F.col("revenue")).alias("total_revenue"), "cancelled_orders",
        mean(F.col("delay_sum"), F.col("delay_count")).alias("avg_delay_mins"),
    )


def product_inventory_health(t: Tables) -> DataFrame:
    """The newest stock of every store and product, flagged when at or below the reorder level."""
    return (
        latest_stock(t)
        .join(store_names(t), "store_id")
        .join(product_names(t), "product_id")
        .select(
            "store_id", "store_name", "product_id", "product_name", "closing_stock", "reorder_level", "stock_date",
            (F.col("closing_stock") <= F.col("reorder_level")).alias("needs_reorder"),
        )
    )


def _in_month(moment: Column, month: str) -> Column:
    """A range on the stored column, which file statistics can rule out; text of the month could not."""
    first = F.lit(f"{month}-01").cast("date")
    return (moment >= first.cast("timestamp_ntz")) & (moment < F.add_months(first, 1).cast("timestamp_ntz"))


def monthly_city_revenue(t: Tables, months: list[str] | None = None) -> DataFrame:
    """Delivered orders and revenue per city and month, of all months or of those given (``yyyy-MM``).

    Money stays decimal, so that the stored table can be rolled up exactly.
    """
    orders = delivered_orders(t)
    if months is not None:
        wanted = [_in_month(F.col("order_datetime"), month) for month in months]
        orders = orders.filter(reduce(Column.__or__, wanted, F.lit(False)))
    month, places = month_start(F.col("order_datetime")), stores_with_city(t)
    per_store = orders.groupBy("store_id", month.alias("month")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("total_amount").alias("revenue")
    )
    monthly = (
        per_store.join(places, "store_id")
        .groupBy("city_id", "city_name", "month")
        .agg(F.sum("rows").alias("rows"), F.sum("revenue").alias("revenue"))
    )
    if "orders" in t.unique:
        monthly = monthly.withColumn("total_orders", F.col("rows"))
    else:  # an order counts once per city and month, in whichever of the city's stores it stands
        sets = memberships(orders, "order_id", {"store_id": F.col("store_id"), "month": month})
        counted = count_by(members(sets).join(places, "store_id"), ["city_id", "month"], "total_orders")
        monthly = monthly.join(counted, ["city_id", "month"], "left").na.fill(0, ["total_orders"])
    return monthly.select(
        "city_id", "city_name", year_month(F.col("month")).alias("order_month"), "total_orders",
        F.col("revenue").cast(STORED_MONEY).alias("total_revenue"),
        mean_money(F.col("revenue"), F.col("rows")).cast(STORED_MONEY).alias("avg_order_value"),
    )


def monthly_city_revenue_shown(t: Tables) -> DataFrame:
    """The monthly revenue with money as plain numbers."""
    return shown(monthly_city_revenue(t))


def shown(monthly: DataFrame) -> DataFrame:
    return monthly.withColumns({c: money(F.col(c)) for c in ["total_revenue", "avg_order_value"]})


def register(t: Tables) -> None:
    """Offer the two views to ``spark.sql``."""
    store_daily_performance(t).createOrReplaceTempView("store_daily_performance")
    product_inventory_health(t).createOrReplaceTempView("product_inventory_health")
