"""Delivery performance questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distinct import ids_and_sums
from ..functions.exact import count_where, mean, percent
from ..functions.ordering import tile_end
from ..functions.places import Places
from ..sources.tables import Tables
from .common import (
    completed_deliveries, completed_with_store, delay, delivery_counts_by_store, on_time, store_names, stores_with_city,
)


def status_breakdown(t: Tables) -> DataFrame:
    """Deliveries per status and their share of all."""
    counts = t["deliveries"].groupBy("delivery_status").agg(F.count(F.lit(1)).alias("total_deliveries"))
    # One row per status.
    everything = F.sum("total_deliveries").over(Window.partitionBy())
    return counts.withColumn("pct_of_all_deliveries", percent(F.col("total_deliveries"), everything)).orderBy(
        F.desc("total_deliveries"), "delivery_status"
    )


def delay_by_city(t: Tables) -> DataFrame:
    """Average delay of completed deliveries per city name, from the stores' sums and counts."""
    return (
        delivery_counts_by_store(t)
        .join(stores_with_city(t), "store_id")
        .groupBy("city_name")
        .agg(
            F.sum("trips").alias("delivered_orders"), F.sum("delay_sum").alias("total"), F.sum("delay_count").alias("n")
        )
        .select("city_name", "delivered_orders", mean(F.col("total"), F.col("n")).alias("avg_delay_mins"))
        .orderBy(F.desc_nulls_last("avg_delay_mins"), "city_name")
    )


def _trips_by_partner(t: Tables) -> DataFrame:
    return completed_deliveries(t).groupBy("partner_id").agg(
        F.count(F.lit(1)).alias("total_trips"),
        count_where(on_time()).alias("on_time_trips"),
        F.sum("actual_time_mins").alias("minutes"),
        F.count("actual_time_mins").alias("timed_trips"),
    )


def partner_scorecard(t: Tables, min_trips: int = 20) -> DataFrame:
    """Partners with enough trips, ranked by their unrounded on-time rate."""
    names = t["delivery_partners"].select("partner_id", "partner_name")
    partners = (
        _trips_by_partner(t)
        .filter(F.col("total_trips") >= min_trips)
        .join(names.select("partner_id"), "partner_id", "left_semi")
        .withColumn("on_time_rate", F.col("on_time_trips") * F.lit(100.0) / F.col("total_trips"))
    )
    ranked = Places(partners, "partner_id", ["on_time_rate"]).ordered("on_time_rate", descending=True)
    return ranked.withColumnRenamed("rank", "on_time_rank").join(names, "partner_id").select(
        "partner_id", "partner_name", "total_trips", "on_time_trips",
        percent(F.col("on_time_trips"), F.col("total_trips")).alias("on_time_pct"),
        mean(F.col("minutes"), F.col("timed_trips")).alias("avg_delivery_time"), "on_time_rank",
    ).orderBy("on_time_rank", "partner_id")


def _minutes_histogram(t: Tables) -> DataFrame:
    """Deliveries per store and minute value, with running counts in minute order.

    Percentiles need only these counts: a store's window holds one row per distinct number of minutes,
    however many deliveries it has.
    """
    counts = completed_with_store(t).groupBy("store_id", "actual_time_mins").agg(F.count(F.lit(1)).alias("n"))
    store = Window.partitionBy("store_id")
    upward = store.orderBy(F.asc_nulls_last("actual_time_mins"))
    known = F.when(F.col("actual_time_mins").isNotNull(), F.col("n")).otherwise(0)
    return (
        counts.withColumn("up_to", F.sum("n").over(upward.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("rows", F.sum("n").over(store))
        .withColumn("known", F.sum(known).over(store))
    )


def _value_at(position: Column) -> Column:
    """Minutes of the row at a 1-based position, as an aggregate over a store's histogram."""
    return F.min(F.when(F.col("up_to") >= position, F.col("actual_time_mins"))).cast("bigint")


def percentiles_ntile(t: Tables) -> DataFrame:
    """The largest time in the 50th and 90th of 100 equal tiles per store; NULL when a store has too few rows."""

    def top_of_tile(number: int) -> Column:
        starts_at = tile_end(number - 1, F.col("rows"), 100) + 1
        # Unknown times sort last and never are the largest of a tile.
        end = F.least(tile_end(number, F.col("rows"), 100), F.col("known"))
        return _value_at(F.when(starts_at <= F.col("known"), end))

    return (
        _minutes_histogram(t)
        .groupBy("store_id")
        .agg(top_of_tile(50).alias("approx_p50_mins"), top_of_tile(90).alias("approx_p90_mins"))
        .join(store_names(t), "store_id")
        .select("store_id", "store_name", "approx_p50_mins", "approx_p90_mins")
        .orderBy(F.desc_nulls_last("approx_p90_mins"), "store_id")
    )


def percentiles_exact(t: Tables) -> DataFrame:
    """Interpolated median and 90th percentile of the delivery time per store."""

    def interpolated(tenths: int) -> Column:
        # The wanted point lies (known - 1) * tenths / 10 rows after the first.
        steps = (F.col("known") - 1) * tenths
        below = F.floor(steps / 10).cast("bigint") + 1
        above = F.least(below + 1, F.col("known"))
        weight = F.max(steps % 10)
        return (_value_at(below) * (F.lit(10) - weight) + _value_at(above) * weight) / F.lit(10.0)

    return (
        _minutes_histogram(t)
        .filter(F.col("actual_time_mins").isNotNull())
        .groupBy("store_id")
        .agg(interpolated(5).alias("p50_delivery_mins"), interpolated(9).alias("p90_delivery_mins"))
        .join(store_names(t), "store_id")
        .select("store_id", "store_name", "p50_delivery_mins", "p90_delivery_mins")
        .orderBy(F.desc_nulls_last("p90_delivery_mins"), "store_id")
    )


def bottleneck_stores(t: Tables) -> DataFrame:
    """Stores whose average delay exceeds that of all deliveries in their city.

    One pass gives a sum and a count per store; the city's figures are the sums of its stores'.
    """
    stores = delivery_counts_by_store(t).join(
        t["dark_stores"].select("store_id", "store_name", "city_id"), "store_id"
    )
    cities = stores.groupBy("city_id").agg(
        F.sum("delay_sum").alias("city_sum"), F.sum("delay_count").alias("city_count")
    )

    def whole(name: str) -> Column:
        return F.col(name).cast("decimal(19,0)")

    slower = whole("delay_sum") * whole("city_count") > whole("city_sum") * whole("delay_count")
    return (
        stores.join(cities, "city_id")
        .filter(slower)
        .select(
            "store_id", "store_name", "city_id",
            mean(F.col("delay_sum"), F.col("delay_count")).alias("store_avg_delay"),
        )
        .orderBy(F.desc_nulls_last("store_avg_delay"), "store_id")
    )


def peak_hour(t: Tables) -> DataFrame:
    """Distinct orders and average delay per hour of the day, over all orders; deliveries are summed per order first."""
    deliveries = t["deliveries"].groupBy("order_id").agg(F.sum(delay()).alias("total"), F.count(delay()).alias("n"))
    orders = (
        t["orders"]
        .select("order_id", F.hour("order_datetime").cast("bigint").alias("order_hour"))
        .join(deliveries, "order_id", "left")
    )
    hours = ids_and_sums(
        orders, "order_id", {"order_hour": F.col("order_hour")}, {"total": F.col("total"), "n": F.col("n")},
        unique="orders" in t.unique,
    )
    return hours.select(
        "order_hour", F.col("ids").alias("total_orders"), mean(F.col("total"), F.col("n")).alias("avg_delay_mins")
    ).orderBy("order_hour")


def vehicle_performance(t: Tables) -> DataFrame:
    """Trips, average time and on-time rate per vehicle type."""
    return (
        _trips_by_partner(t)
        .join(t["delivery_partners"].select("partner_id", "vehicle_type"), "partner_id")
        .groupBy("vehicle_type")
        .agg(
            *[F.sum(c).alias(c) for c in ["total_trips", "on_time_trips", "minutes", "timed_trips"]],
        )
        .select(
            "vehicle_type", "total_trips", mean(F.col("minutes"), F.col("timed_trips")).alias("avg_delivery_time"),
            percent(F.col("on_time_trips"), F.col("total_trips")).alias("on_time_pct"),
        )
        .orderBy(F.desc_nulls_last("on_time_pct"), "vehicle_type")
    )
