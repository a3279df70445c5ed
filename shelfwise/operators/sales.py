"""Sales and revenue questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import day_type, month_start, year_month
from ..functions.distinct import count_by, ids_and_sums, members, memberships
from ..functions.exact import cents, count_where, mean_money, money, percent
from ..functions.places import Places
from ..sources.tables import Tables
from .common import delivered_orders, product_names, sales_by_product, store_names


def top_products(t: Tables, limit: int = 10) -> DataFrame:
    """Products with the highest delivered revenue."""
    products = t["products"].select("product_id", "product_name", "category_id")
    categories = t["categories"].select("category_id", "category_name")
    return (
        sales_by_product(t)
        .join(products, "product_id")
        .join(categories, "category_id")
        .orderBy(F.desc_nulls_last("revenue"), "product_id")
        .limit(limit)
        .select(
            "product_id", "product_name", "category_name", "units_sold",
            money(F.col("revenue")).alias("total_revenue"),
        )
    )


def category_revenue(t: Tables) -> DataFrame:
    """Delivered revenue per category, unrounded."""
    products = t["products"].select("product_id", "category_id")
    return (
        sales_by_product(t)
        .join(products, "product_id")
        .groupBy("category_id")
        .agg(F.sum("revenue").alias("revenue"))
        .join(t["categories"].select("category_id", "category_name"), "category_id")
    )


def category_share(t: Tables) -> DataFrame:
    """Categories ranked by revenue, with the running share of the total; equal revenues share both."""
    placed = Places(category_revenue(t), "category_id", ["revenue"]).ordered("revenue", descending=True, total="revenue")
    return (
        placed.select(
            "category_name", money(F.col("revenue")).alias("revenue"), F.col("rank").alias("revenue_rank"),
            percent(cents(F.col("running")), cents(F.col("all"))).alias("cumulative_pct_of_revenue"),
        )
        .orderBy("revenue_rank", "category_name")
    )


def weekday_weekend(t: Tables) -> DataFrame:
    """Delivered orders and revenue on weekdays and weekends."""
    totals = ids_and_sums(
        delivered_orders(t), "order_id", {"day_type": day_type(F.col("order_datetime"))}, {"revenue": F.col("total_amount")},
        unique="orders" in t.unique,
    )
    return totals.select(
        "day_type", F.col("ids").alias("total_orders"), money(F.col("revenue")).alias("total_revenue"),
        mean_money(F.col("revenue"), F.col("rows")).alias("avg_order_value"),
    )


def monthly_mom(t: Tables) -> DataFrame:
    """Delivered revenue per month and its growth over the previous month that has orders."""
    months = delivered_orders(t).groupBy(month_start(F.col("order_datetime")).alias("month")).agg(
        F.sum("total_amount").alias("revenue")
    )
    # One row per calendar month.
    before = F.lag("revenue").over(Window.orderBy("month"))
    return (
        months.withColumn("before", before)
        .select(
            year_month(F.col("month")).alias("order_month"), money(F.col("revenue")).alias("revenue"),
            money(F.col("before")).alias("prev_month_revenue"),
            percent(cents(F.col("revenue") - F.col("before")), cents(F.col("before"))).alias("mom_growth_pct"),
        )
        .orderBy("order_month")
    )


def promo_effectiveness(t: Tables) -> DataFrame:
    """Delivered orders and revenue per promotion and without one."""
    unique = "orders" in t.unique
    orders, promo = delivered_orders(t), {"promo_id": F.col("promo_id")}
    per_promo = orders.groupBy("promo_id").agg(F.count(F.lit(1)).alias("rows"), F.sum("total_amount").alias("revenue"))
    label = F.when(F.col("promo_id").isNull(), "No Promotion").otherwise(F.col("promo_code")).alias("promo_used")
    codes = t["promotions"].select("promo_id", "promo_code")
    used = (
        per_promo.join(codes, "promo_id", "left").groupBy(label)
        .agg(F.sum("rows").alias("rows"), F.sum("revenue").alias("revenue"))
    )
    if unique:
        used = used.withColumn("total_orders", F.col("rows"))
    else:  # ids may stand under several promotions, and promotions may share a code
        reached = members(memberships(orders, "order_id", promo)).join(codes, "promo_id", "left")
        counted = count_by(reached.withColumn("_used", label), ["_used"], "total_orders")
        used = used.join(counted, F.col("promo_used").eqNullSafe(F.col("_used")), "left").na.fill(0, ["total_orders"])
    return (
        used
        .select(
            "promo_used", "total_orders", mean_money(F.col("revenue"), F.col("rows")).alias("avg_order_value"),
            money(F.col("revenue")).alias("total_revenue"),
        )
        .orderBy(F.desc_nulls_last("total_revenue"), "promo_used")
    )


def best_seller_per_store(t: Tables) -> DataFrame:
    """The product each store sold most units of; the lower product id wins a tie.

    Spark keeps only each task's best row per store before the shuffle (a window group limit), so a store
    with very many products does not fill one task.
    """
    sales = (
        t["order_items"]
        .select("order_id", "product_id", "quantity")
        .join(delivered_orders(t).select("order_id", "store_id"), "order_id")
        .groupBy("store_id", "product_id")
        .agg(F.sum("quantity").alias("units_sold"))
    )
    best_first = Window.partitionBy("store_id").orderBy(F.desc("units_sold"), "product_id")
    return (
        sales.withColumn("place", F.row_number().over(best_first))
        .filter(F.col("place") == 1)
        .join(store_names(t), "store_id")
        .join(product_names(t), "product_id")
        .select("store_id", "store_name", "product_id", "product_name", "units_sold")
        .orderBy("store_id")
    )


def payment_mix(t: Tables) -> DataFrame:
    """Payments and their success rate per method."""
    return (
        t["payments"]
        .groupBy("payment_method")
        .agg(
            F.count(F.lit(1)).alias("total_payments"),
            count_where(F.col("payment_status") == "Success").alias("successful_payments"),
        )
        .withColumn("success_rate_pct", percent(F.col("successful_payments"), F.col("total_payments")))
        .orderBy(F.desc("total_payments"), "payment_method")
    )
