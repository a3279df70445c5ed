"""Customer behaviour questions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import days_between, month_start, year_month
from ..functions.distinct import count_by, members, memberships
from ..functions.exact import count_where, mean_money, money, ratio
from ..functions.ordering import percent_rank, previous_value, tile
from ..functions.places import Places
from ..sources.tables import Tables
from .common import delivered_orders


def frequency_segments(t: Tables) -> DataFrame:
    """Customers by number of delivered orders, with their average spend."""
    per_customer = delivered_orders(t).groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("total_amount").alias("spend")
    )
    orders = F.col("orders")
    segment = (
        F.when(orders == 1, "One-time")
        .when(orders.between(2, 4), "Occasional")
        .when(orders.between(5, 9), "Regular")
        .otherwise("Loyal")
    )
    return (
        per_customer.groupBy(segment.alias("customer_segment"))
        .agg(F.count(F.lit(1)).alias("customers_in_segment"), F.sum("spend").alias("spend"))
        .select(
            "customer_segment", "customers_in_segment",
            mean_money(F.col("spend"), F.col("customers_in_segment")).alias("avg_lifetime_spend"),
        )
        .orderBy(F.desc_nulls_last("avg_lifetime_spend"), "customer_segment")
    )


def rfm(t: Tables) -> DataFrame:
    """Recency, frequency and monetary quartiles per customer, 1 being the best; ties go by customer id.

    The three quartiles run over all customers, so each is read off a position; the customers' keys are stored once for all
    three, and names are joined on at the end.  Orders and customers meet in one aggregation, in which only customers with
    both stay.
    """
    orders = delivered_orders(t).select("customer_id", "order_datetime", "total_amount", F.lit(1).alias("n"))
    known = t["customers"].select("customer_id", F.lit(0).alias("n"), F.lit(True).alias("known"))
    spenders = (
        orders.unionByName(known, allowMissingColumns=True)
        .filter(F.col("customer_id").isNotNull())
        .groupBy("customer_id")
        .agg(
            F.max("order_datetime").alias("last_order_date"),
            F.sum("n").alias("frequency"),
            F.sum("total_amount").alias("spend"),
            F.max("known").alias("known"),
        )
        .filter(F.col("known") & (F.col("frequency") > 0))
        .drop("known")
    )
    quartiles = {"recency_quartile": "last_order_date", "frequency_quartile": "frequency", "monetary_quartile": "spend"}
    places = Places(spenders, "customer_id", list(quartiles.values()))
    placed = [
        places.ordered(value, descending=True).select("customer_id", value, tile(F.col("position"), F.col("rows"), 4).alias(name))
        for name, value in quartiles.items()
    ]
    # A row per customer and order, with the other orders' columns missing, is folded into a row per customer.
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), placed)
    customers = stacked.groupBy("customer_id").agg(*[F.max(c).alias(c) for c in [*quartiles, *quartiles.values()]])
    return customers.join(t["customers"].select("customer_id", "full_name"), "customer_id").orderBy(F.desc_nulls_last("spend"), "customer_id").select(
        "customer_id", "full_name", "last_order_date", "frequency", money(F.col("spend")).alias("monetary"),
        "recency_quartile", "frequency_quartile", "monetary_quartile",
    )


def order_gaps(t: Tables, sort: bool = False) -> DataFrame:
    """Each delivered order with the customer's previous one and the days between them."""
    orders = delivered_orders(t).select("customer_id", "order_id", "order_datetime")
    gaps = previous_value(
        orders, "customer_id", F.to_date("order_datetime"), ["order_datetime", "order_id"], "prev_order_datetime"
    ).select(
        "customer_id", "order_id", "order_datetime", "prev_order_datetime",
        days_between(F.col("order_datetime"), F.col("prev_order_datetime")).alias("days_since_prev_order"),
    )
    return gaps.orderBy("customer_id", "order_datetime", "order_id") if sort else gaps


def city_engagement(t: Tables) -> DataFrame:
    """Distinct customers, active ones among them, and delivered orders per customer, per city name.

    Orders are counted per customer first; customers without any still count.  A customer id that is not unique counts once
    per city name, and as active if any of its rows there is.
    """
    orders = delivered_orders(t).groupBy("customer_id").agg(F.count(F.lit(1)).alias("orders"))
    per_city = (
        t["customers"]
        .select("customer_id", "city_id", "is_active")
        .join(orders, "customer_id", "left")
        .groupBy("city_id")
        .agg(
            F.count(F.lit(1)).alias("total_customers"),
            count_where(F.col("is_active")).alias("active_customers"),
            F.coalesce(F.sum("orders"), F.lit(0)).alias("orders"),
        )
    )
    names = t["cities"].select("city_id", "city_name")
    totals = (
        per_city.join(names, "city_id").groupBy("city_name")
        .agg(*[F.sum(c).alias(c) for c in ["total_customers", "active_customers", "orders"]])
    )
    if "customers" not in t.unique:
        sets = memberships(t["customers"], "customer_id", {"city_id": F.col("city_id"), "active": F.col("is_active")})
        reached = members(sets).join(names, "city_id")
        counted = count_by(reached, ["city_name"], "total_customers").join(
            count_by(reached.filter("active"), ["city_name"], "active_customers"), "city_name", "left"
        )
        totals = totals.select("city_name", "orders").join(counted, "city_name", "left").na.fill(0)
    return (
        totals
        .select(
            "city_name", "total_customers", "active_customers",
            ratio(F.col("orders"), F.col("total_customers")).alias("avg_orders_per_customer"),
        )
        .orderBy(F.desc("total_customers"), "city_name")
    )


def new_vs_returning(t: Tables) -> DataFrame:
    """Delivered orders per month, split by whether the month is the customer's first.

    Orders are counted per customer and month before the window looks for the first month, so a customer
    brings at most one row per calendar month.
    """
    monthly = (
        delivered_orders(t)
        .groupBy("customer_id", month_start(F.col("order_datetime")).alias("month"))
        .agg(F.count(F.lit(1)).alias("orders"))
        .withColumn("first_month", F.min("month").over(Window.partitionBy("customer_id")))
    )
    is_first = F.col("month") == F.col("first_month")
    return (
        monthly.groupBy("month")
        .agg(
            F.sum(F.when(is_first, F.col("orders")).otherwise(0)).alias("new_customers"),
            F.sum(F.when(~is_first, F.col("orders")).otherwise(0)).alias("returning_orders"),
        )
        .select(year_month(F.col("month")).alias("order_month"), "new_customers", "returning_orders")
        .orderBy("order_month")
    )


def high_value(t: Tables) -> DataFrame:
    """The customers in the top 5% by spend."""
    spend = delivered_orders(t).groupBy("customer_id").agg(F.sum("total_amount").alias("spend"))
    ranked = Places(spend, "customer_id", ["spend"]).ordered("spend")
    # (rank - 1) / (rows - 1) >= 0.95, in whole numbers.
    top = ((F.col("rank") - 1) * 20 >= (F.col("rows") - 1) * 19) & (F.col("rows") > 1)
    return (
        ranked.filter(top)
        .join(t["customers"].select("customer_id", "full_name"), "customer_id")
        .orderBy(F.desc_nulls_last("spend"), "customer_id")
        .select(
            "customer_id", "full_name", money(F.col("spend")).alias("lifetime_spend"),
            percent_rank(F.col("rank"), F.col("rows")).alias("spend_percentile"),
        )
    )
