"""The data behind the dashboard pages, and the measures they show."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import month_start, year_month
from ..functions.exact import cents, count_where, mean_money, money, percent, share, sum_where
from ..plans.views import product_inventory_health
from ..sources.tables import Tables
from .common import (
    COMPLETED, delivery_counts_by_store, on_time, stock_totals_by_store, store_names, stores_with_city,
)
from .sales import category_revenue


def total_revenue(t: Tables) -> DataFrame:
    """Revenue of all orders, whatever their status."""
    return t["orders"].agg(F.sum("total_amount").alias("revenue")).select(
        money(F.col("revenue")).alias("total_revenue")
    )


def _sla_counts(t: Tables) -> DataFrame:
    return t["deliveries"].agg(F.count(F.lit(1)).alias("deliveries"), count_where(on_time()).alias("on_time"))


def sla(t: Tables) -> DataFrame:
    """On-time deliveries as a fraction of all deliveries; one without an actual time is not on time."""
    return _sla_counts(t).select(share(F.col("on_time"), F.col("deliveries")).alias("sla"))


def _stock_counts(t: Tables) -> DataFrame:
    return t["inventory"].agg(
        F.sum("units_sold").alias("sold"),
        F.sum(F.col("opening_stock") + F.col("units_received")).alias("available"),
    )


def fill_rate(t: Tables) -> DataFrame:
    """Units sold as a fraction of the units there were to sell."""
    return _stock_counts(t).select(share(F.col("sold"), F.col("available")).alias("fill_rate"))


def cancellation_rate(t: Tables) -> DataFrame:
    """Cancelled orders as a fraction of all."""
    counts = t["orders"].agg(
        F.count(F.lit(1)).alias("orders"), count_where(F.col("order_status") == "Cancelled").alias("cancelled")
    )
    return counts.select(share(F.col("cancelled"), F.col("orders")).alias("cancellation_rate"))


def mom_growth(t: Tables) -> DataFrame:
    """Revenue growth over the calendar month before; blank when that month has no orders."""
    months = t["orders"].groupBy(month_start(F.col("order_datetime")).alias("first_day")).agg(
        F.sum("total_amount").alias("revenue")
    )
    before = months.select(
        F.add_months("first_day", 1).alias("first_day"), F.col("revenue").alias("prior")
    )
    growth = share(cents(F.col("revenue") - F.col("prior")), cents(F.col("prior")))
    return (
        months.join(before, "first_day", "left")
        .select(
            year_month(F.col("first_day")).alias("order_month"), money(F.col("revenue")).alias("total_revenue"),
            money(F.col("prior")).alias("prior_month_revenue"), growth.alias("mom_growth"),
        )
        .orderBy("order_month")
    )


def exec_kpis(t: Tables) -> DataFrame:
    """Revenue, orders, average order value, SLA and fill rate in one row.

    Three one-row aggregates are stacked and folded into one, so nothing is cross joined.
    """
    orders = t["orders"].agg(F.sum("total_amount").alias("revenue"), F.count(F.lit(1)).alias("orders"))
    stacked = orders.unionByName(_sla_counts(t), allowMissingColumns=True).unionByName(
        _stock_counts(t), allowMissingColumns=True
    )
    names = ["revenue", "orders", "deliveries", "on_time", "sold", "available"]
    return stacked.agg(*[F.max(name).alias(name) for name in names]).select(
        money(F.col("revenue")).alias("total_revenue"), F.col("orders").alias("total_orders"),
        mean_money(F.col("revenue"), F.col("orders")).alias("avg_order_value"),
        share(F.col("on_time"), F.col("deliveries")).alias("sla"),
        share(F.col("sold"), F.col("available")).alias("fill_rate"),
    )


def revenue_by_category(t: Tables) -> DataFrame:
    return (
        category_revenue(t)
        .select("category_name", money(F.col("revenue")).alias("revenue"))
        .orderBy(F.desc_nulls_last("revenue"), "category_name")
    )


def _store_metrics(t: Tables, stores: DataFrame) -> DataFrame:
    """``stores`` with their revenue, fill rate, SLA and cancellation rate.

    Deliveries are counted per order first, so that an order delivered more than once still counts once; orders and
    deliveries then meet in one join and one aggregation, on the key that the deliveries were counted by.
    """
    completed = F.col("delivery_status").isin(COMPLETED)
    deliveries = t["deliveries"].groupBy("order_id").agg(
        count_where(completed).alias("completed"), count_where(completed & on_time()).alias("punctual")
    )
    delivered = F.col("order_status") == "Delivered"
    activity = (
        t["orders"]
        .select("order_id", "store_id", "order_status", "total_amount")
        .join(deliveries, "order_id", "left")
        .groupBy("store_id")
        .agg(
            sum_where(delivered, F.col("total_amount")).alias("revenue"),
            F.count(F.lit(1)).alias("orders"),
            count_where(F.col("order_status") == "Cancelled").alias("cancelled"),
            F.sum("completed").alias("trips"),
            F.sum("punctual").alias("on_time_trips"),
        )
    )
    return (
        stores.join(activity, "store_id", "left")
        .join(stock_totals_by_store(t), "store_id", "left")
        .select(
            *stores.columns, money(F.col("revenue")).alias("total_revenue"),
            percent(F.col("sold"), F.col("available")).alias("fill_rate_pct"),
            percent(F.col("on_time_trips"), F.col("trips")).alias("sla_pct"),
            percent(F.col("cancelled"), F.col("orders")).alias("cancellation_rate_pct"),
        )
    )


def store_scorecard(t: Tables) -> DataFrame:
    """Every store with its revenue, fill rate, SLA and cancellation rate."""
    return _store_metrics(t, store_names(t)).orderBy(F.desc_nulls_last("total_revenue"), "store_id")


def store_matrix_by_city(t: Tables) -> DataFrame:
    """The scorecard with each store under its city."""
    stores = stores_with_city(t).select("city_id", "city_name", "store_id", "store_name")
    return _store_metrics(t, stores).orderBy("city_name", "store_id")


def sla_by_city(t: Tables) -> DataFrame:
    """SLA per city from the stores' counts, never from their percentages."""
    return (
        delivery_counts_by_store(t)
        .join(stores_with_city(t), "store_id")
        .groupBy("city_id", "city_name")
        .agg(F.sum("trips").alias("total_deliveries"), F.sum("on_time_trips").alias("on_time_deliveries"))
        .withColumn("sla_pct", percent(F.col("on_time_deliveries"), F.col("total_deliveries")))
        .orderBy(F.desc_nulls_last("sla_pct"), "city_id")
    )


def low_stock(t: Tables) -> DataFrame:
    return product_inventory_health(t).filter("needs_reorder").drop("needs_reorder").orderBy(
        "closing_stock", "store_id", "product_id"
    )


def dim_date(t: Tables) -> DataFrame:
    """Every calendar day from the first to the last order, stock or delivery date."""

    def span(name: str, column: str) -> DataFrame:
        day = F.to_date(column)
        return t[name].agg(F.min(day).alias("first"), F.max(day).alias("last"))

    spans = span("orders", "order_datetime").unionByName(span("inventory", "stock_date")).unionByName(
        span("deliveries", "delivered_at")
    )
    whole = spans.agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return whole.select(F.explode(F.sequence("first", "last")).alias("date")).withColumn(
        "year_month", year_month(F.col("date"))
    )


def sample_preview(t: Tables, rows: int = 50) -> DataFrame:
    """The first orders that have a customer and a store, with both names; a top-k, so no full sort."""
    return (
        t["orders"].join(t["customers"].select("customer_id", "full_name", "city_id"), "customer_id")
        .join(t["dark_stores"].select("store_id", "store_name"), "store_id")
        .select(
            "order_id", "customer_id", "store_id", "promo_id", "order_datetime", "order_status",
            money(F.col("total_amount")).alias("total_amount"), "full_name", "city_id", "store_name",
        )
        .orderBy("order_id")
        .limit(rows)
    )
