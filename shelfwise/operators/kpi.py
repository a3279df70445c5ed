"""Operating KPIs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distinct import count_by, count_by_levels, members
from ..functions.exact import cents, count_where, mean, mean_money, money, percent, ratio
from ..sources.tables import Tables
from .common import (
    delivered_order_places, delivered_orders, delivery_counts_by_store, revenue_by_store, stock_totals_by_store,
    store_names, stores_with_city,
)


def fill_rate(t: Tables) -> DataFrame:
    """Units sold as a percentage of the units there were to sell, per store."""
    return (
        stock_totals_by_store(t)
        .join(store_names(t), "store_id")
        .select(
            "store_id", "store_name", F.col("sold").alias("total_units_sold"),
            F.col("available").alias("total_units_available"),
            percent(F.col("sold"), F.col("available")).alias("fill_rate_pct"),
        )
        .orderBy(F.desc_nulls_last("fill_rate_pct"), "store_id")
    )


def sla_by_store(t: Tables) -> DataFrame:
    """Percentage of completed deliveries within the promised time, per store."""
    return (
        delivery_counts_by_store(t)
        .join(store_names(t), "store_id")
        .select(
            "store_id", "store_name", F.col("trips").alias("total_deliveries"),
            F.col("on_time_trips").alias("on_time_deliveries"),
            percent(F.col("on_time_trips"), F.col("trips")).alias("sla_pct"),
        )
        .orderBy(F.desc_nulls_last("sla_pct"), "store_id")
    )


def inventory_turnover(t: Tables) -> DataFrame:
    """How often the average stock on hand was sold, per store."""
    stock = t["inventory"].groupBy("store_id").agg(
        F.sum("units_sold").alias("units_sold"),
        F.sum(F.col("opening_stock") + F.col("closing_stock")).alias("both_ends"),
        F.count(F.lit(1)).alias("snapshots"),
    )
    # The average of (opening + closing) / 2 is both_ends / (2 * snapshots).
    halves = F.col("snapshots").cast("decimal(38,0)") * 2
    return stock.select(
        "store_id", "units_sold", ratio(F.col("both_ends"), halves).alias("avg_stock_on_hand"),
        ratio(F.col("units_sold") * halves, F.col("both_ends")).alias("inventory_turnover"),
    ).orderBy(F.desc_nulls_last("inventory_turnover"), "store_id")


def out_of_stock_rate(t: Tables) -> DataFrame:
    """Percentage of snapshots that end at zero, per store."""
    stock = t["inventory"].groupBy("store_id").agg(
        F.count(F.lit(1)).alias("stock_days_tracked"),
        count_where(F.col("closing_stock") == 0).alias("stockout_days"),
    )
    return stock.withColumn(
        "out_of_stock_rate_pct", percent(F.col("stockout_days"), F.col("stock_days_tracked"))
    ).orderBy(F.desc_nulls_last("out_of_stock_rate_pct"), "store_id")


def revenue_lost_stockouts(t: Tables, limit: int = 25) -> DataFrame:
    """Stock-outs times the average sale of the other snapshots times the price: the largest losses.

    One pass over the snapshots; pairs that were never out of stock, or never in stock, drop out.
    """
    empty = F.col("closing_stock") == 0
    sold_in_stock = F.when(F.col("closing_stock") > 0, F.col("units_sold"))
    pairs = (
        t["inventory"]
        .groupBy("store_id", "product_id")
        .agg(
            count_where(empty).alias("stockout_day_count"),
            F.sum(sold_in_stock).alias("healthy_sold"),
            F.count(sold_in_stock).alias("healthy_days"),
        )
        .filter((F.col("stockout_day_count") > 0) & (F.col("healthy_days") > 0))
    )
    lost = F.col("stockout_day_count").cast("decimal(38,0)") * F.col("healthy_sold") * cents(F.col("unit_price"))
    return (
        pairs.join(t["products"].select("product_id", "product_name", "unit_price"), "product_id")
        .select(
            "store_id", "product_id", "product_name", "stockout_day_count",
            mean(F.col("healthy_sold"), F.col("healthy_days")).alias("est_daily_demand"),
            ratio(lost, F.col("healthy_days") * 100).alias("est_revenue_lost"),
        )
        .orderBy(F.desc_nulls_last("est_revenue_lost"), "store_id", "product_id")
        .limit(limit)
    )


def aov_by_store(t: Tables) -> DataFrame:
    """Average value of delivered orders, per store."""
    return (
        revenue_by_store(t)
        .join(store_names(t), "store_id")
        .select(
            "store_id", "store_name", F.col("orders").alias("total_orders"),
            mean_money(F.col("revenue"), F.col("orders")).alias("avg_order_value"),
        )
        .orderBy(F.desc_nulls_last("avg_order_value"), "store_id")
    )


def repeat_customer_rate(t: Tables) -> DataFrame:
    """Share of customers with more than one delivered order."""
    per_customer = delivered_orders(t).groupBy("customer_id").agg(F.count(F.lit(1)).alias("orders"))
    return per_customer.agg(
        F.count(F.lit(1)).alias("total_customers_with_orders"),
        count_where(F.col("orders") > 1).alias("repeat_customers"),
    ).withColumn(
        "repeat_customer_rate_pct", percent(F.col("repeat_customers"), F.col("total_customers_with_orders"))
    )


def revenue_by_store_city(t: Tables) -> DataFrame:
    """Delivered revenue per store, with its city."""
    return (
        revenue_by_store(t)
        .join(stores_with_city(t), "store_id")
        .select("store_id", "store_name", "city_name", money(F.col("revenue")).alias("total_revenue"))
        .orderBy(F.desc_nulls_last("total_revenue"), "store_id")
    )


def revenue_by_city(t: Tables) -> DataFrame:
    """Delivered revenue and distinct orders per city.

    Unique order ids are counted with the revenue; others are counted once per city, in whichever of its stores they are.
    """
    city, places = ["city_id", "city_name", "tier"], stores_with_city(t)
    per_city = (
        revenue_by_store(t).join(places, "store_id").groupBy(*city)
        .agg(F.sum("revenue").alias("revenue"), F.sum("orders").alias("total_orders"))
    )
    if "orders" not in t.unique:
        orders = count_by(members(delivered_order_places(t)).join(places, "store_id"), ["city_id"], "total_orders")
        per_city = per_city.drop("total_orders").join(orders, "city_id", "left").na.fill(0, ["total_orders"])
    return (
        per_city
        .select("city_id", "city_name", "tier", money(F.col("revenue")).alias("total_revenue"), "total_orders")
        .orderBy(F.desc_nulls_last("total_revenue"), "city_id")
    )


def orders_by_place(t: Tables) -> DataFrame:
    """Distinct delivered orders of every store, city and tier, and in all, from one state of the orders."""
    reached = members(delivered_order_places(t)).join(stores_with_city(t), "store_id")
    return count_by_levels(reached, ["tier", "city_id", "store_id"], "total_orders").select(
        F.element_at(F.array(*map(F.lit, ["all", "tier", "city", "store"])), F.col("level").cast("int") + 1).alias("level"),
        "tier", "city_id", "store_id", "total_orders",
    )


def cancellation_rate(t: Tables) -> DataFrame:
    """Percentage of all orders that were cancelled, per store."""
    counts = t["orders"].groupBy("store_id").agg(
        F.count(F.lit(1)).alias("total_orders"),
        count_where(F.col("order_status") == "Cancelled").alias("cancelled_orders"),
    )
    return (
        counts.join(store_names(t), "store_id")
        .select(
            "store_id", "store_name", "total_orders", "cancelled_orders",
            percent(F.col("cancelled_orders"), F.col("total_orders")).alias("cancellation_rate_pct"),
        )
        .orderBy(F.desc_nulls_last("cancellation_rate_pct"), "store_id")
    )


def return_rate(t: Tables) -> DataFrame:
    """Returned items as a percentage of the items customers received, each item and each return counted once.

    With unique ids, lines are counted per order before they meet the orders, and returns per item; only lines with a
    return are looked up.  Otherwise the ids that belong to such orders are reduced to distinct ones first.  The two one-row
    results are stacked and folded.
    """
    received = t["orders"].filter(F.col("order_status").isin("Delivered", "Returned")).select("order_id")
    items = t["order_items"].select("order_item_id", "order_id")
    if {"orders", "order_items", "returns"} <= t.unique:
        counted = items.groupBy("order_id").agg(F.count(F.lit(1)).alias("n")).join(received, "order_id")
        returns = t["returns"].groupBy("order_item_id").agg(F.count("return_id").alias("n"))
        returned = returns.join(items, "order_item_id").join(received, "order_id")
    else:
        bought = (
            items.filter(F.col("order_item_id").isNotNull()).distinct()
            .join(received, "order_id", "left_semi").select("order_item_id").distinct()
        )
        returns = t["returns"].select("return_id", "order_item_id").filter(F.col("return_id").isNotNull()).distinct()
        returned = returns.join(bought, "order_item_id", "left_semi").select("return_id").distinct()
        counted, returned = [ids.select(F.lit(1).cast("bigint").alias("n")) for ids in (bought, returned)]
    none = F.lit(None).cast("bigint")
    stacked = counted.agg(F.sum("n").alias("items"), F.max(none).alias("returns")).unionByName(
        returned.agg(F.max(none).alias("items"), F.sum("n").alias("returns"))
    )
    return (
        stacked.agg(
            F.coalesce(F.max("items"), F.lit(0)).cast("bigint").alias("delivered_items_count"),
            F.coalesce(F.max("returns"), F.lit(0)).cast("bigint").alias("returned_items_count"),
        )
        .withColumn("return_rate_pct", percent(F.col("returned_items_count"), F.col("delivered_items_count")))
    )
