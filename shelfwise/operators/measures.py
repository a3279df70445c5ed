"""The dashboard's measures in any filter context: by city, store and month, for groups of them, and in all.

A measure is a fraction of two sums.  Facts are reduced once to the sums of a store and month, the finest context there is;
sums of such states can be added up, ratios can not.  All groupings come from one GROUPING SETS pass over the states, never
over the facts, and the fractions are taken last.

``mom_growth`` compares with the same context a calendar month before.  The month before is a state of its own, moved on by a
month, so it is there also when the context leaves that month out.  The calendar ends with the last month that has orders.
A measure without rows in its context is NULL, and so is one whose divisor is 0.  Stores that are not known, and deliveries
whose order is not, count in contexts without a store or city, and else under NULL.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import month_start, year_month
from ..functions.exact import cents, count_where, money, share
from ..session import dealt_out
from ..sources.tables import Tables
from .common import on_time

#: What contexts are made of, coarsest first where one holds the other.
DIMENSIONS = ("tier", "city_id", "store_id", "month")
SUMS = ("revenue", "orders", "cancelled", "on_time", "deliveries", "sold", "available", "prior_revenue")


def states(t: Tables) -> DataFrame:
    """The sums of every store and month, with the store's city and tier; each fact is read once, and orders are counted."""
    finest, number = ["store_id", "month"], t["orders"].count()
    placed = t["orders"].select("order_id", "store_id", month_start(F.col("order_datetime")).alias("month"), "order_status", "total_amount")
    orders = placed.groupBy(*finest).agg(
        F.sum("total_amount").alias("revenue"), F.count(F.lit(1)).alias("orders"),
        count_where(F.col("order_status") == "Cancelled").alias("cancelled"),
    )
    deliveries = (
        dealt_out(t["deliveries"].select("order_id", on_time().alias("in_time")), number, "order_id")
        .join(dealt_out(placed.select("order_id", *finest), number, "order_id"), "order_id", "left").groupBy(*finest)
        .agg(count_where(F.col("in_time")).alias("on_time"), F.count(F.lit(1)).alias("deliveries"))
    )
    stock = t["inventory"].groupBy("store_id", month_start(F.col("stock_date")).alias("month")).agg(
        F.sum("units_sold").alias("sold"), F.sum(F.col("opening_stock") + F.col("units_received")).alias("available")
    )
    last = t["orders"].agg(month_start(F.max("order_datetime"))).scalar()
    before = orders.select(
        "store_id", F.add_months("month", 1).alias("month"), F.col("revenue").alias("prior_revenue")
    ).filter(F.col("month") <= last)
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [orders, deliveries, stock, before])
    summed = dealt_out(stacked, number, *finest).groupBy(*finest).agg(*[F.sum(c).alias(c) for c in SUMS])
    cities = t["cities"].select("city_id", "tier")
    stores = t["dark_stores"].select("store_id", "city_id").join(cities, "city_id")
    return summed.join(stores, "store_id", "left")


def measures(t: Tables, contexts: list[list[str]], keep: Column | None = None) -> DataFrame:
    """All measures for every grouping in ``contexts`` (lists of ``DIMENSIONS``, the empty one for all together).

    ``keep`` filters the states by their dimensions first.  ``context`` names the grouping of a row; dimensions that it does
    not have are NULL.
    """
    if unknown := {c for context in contexts for c in context} - set(DIMENSIONS):
        raise ValueError(f"no dimension {', '.join(sorted(unknown))}")
    known = states(t) if keep is None else states(t).filter(keep)
    grouped = known.groupingSets([[F.col(c) for c in context] for context in contexts], *map(F.col, DIMENSIONS)).agg(
        *[F.sum(c).alias(c) for c in SUMS], *[F.grouping(c).alias(f"_{c}") for c in DIMENSIONS]
    )
    names = F.concat_ws(" ", *[F.when(F.col(f"_{c}") == 0, F.lit(c.removesuffix("_id"))) for c in DIMENSIONS])
    prior, revenue = cents(F.col("prior_revenue")), cents(F.col("revenue"))
    return grouped.select(
        F.when(names == "", "all").otherwise(names).alias("context"), "tier", "city_id", "store_id",
        year_month(F.col("month")).alias("order_month"), money(F.col("revenue")).alias("total_revenue"),
        share(F.col("on_time"), F.col("deliveries")).alias("sla"), share(F.col("sold"), F.col("available")).alias("fill_rate"),
        share(F.col("cancelled"), F.col("orders")).alias("cancellation_rate"),
        share(F.coalesce(revenue, F.lit(0)) - prior, prior).alias("mom_growth"),
    )


def dashboard_measures(t: Tables) -> DataFrame:
    """By tier, city, store and month, by city and month, and in all."""
    return measures(t, [[], ["tier"], ["city_id"], ["store_id"], ["month"], ["city_id", "month"]])


def measures_of_a_year(t: Tables, year: int = 1997) -> DataFrame:
    """The months of one year, and the year; the growth of its first month looks at the year before."""
    return measures(t, [[], ["month"]], keep=F.year("month") == year)
