"""Deliberately dirty inputs made from the grading tables, for the cleaner and the audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import Tables


def _times(n: int) -> Column:
    return F.array(*map(F.lit, range(n)))


def _again(df: DataFrame, copies: Column) -> DataFrame:
    """Every row as often as ``copies`` (of ``_times``) says, numbered by ``_copy`` from 0, in one pass over the table."""
    return df.withColumn("_copy", F.explode(copies))


def dirty_orders(t: Tables) -> DataFrame:
    """Every tenth order twice, some statuses missing, some dates not dates."""
    orders, key = t["orders"], F.col("order_id")
    text = F.col("order_datetime").cast("string")
    return (
        orders.unionByName(orders.filter(key % 10 == 0))
        .withColumn("order_datetime", F.when(key % 50 == 0, "not a date").otherwise(text))
        .withColumn("order_status", F.when(key % 97 != 0, F.col("order_status")))
    )


def dirty_customers(t: Tables) -> DataFrame:
    """Names in white space, addresses in capitals and some missing."""
    return (
        t["customers"]
        .withColumn("full_name", F.concat(F.lit("  "), "full_name", F.lit("\t ")))
        .withColumn("email", F.when(F.col("customer_id") % 41 != 0, F.upper("email")))
        .withColumn("signup_date", F.col("signup_date").cast("string"))
    )


def dirty_inventory(t: Tables) -> DataFrame:
    """Zero wastage missing, some dates bad, and a second, differing copy of one store."""
    bad = (F.col("product_id") == 7) & (F.col("store_id") % 5 == 0)
    return (
        _again(t["inventory"], F.when(F.col("store_id") == 3, _times(2)).otherwise(_times(1)))
        .withColumn("closing_stock", F.col("closing_stock") + F.col("_copy")).drop("_copy")
        .withColumn("stock_date", F.when(bad, "bad").otherwise(F.col("stock_date").cast("string")))
        .withColumn("units_wasted", F.when(F.col("units_wasted") != 0, F.col("units_wasted")))
    )


def dirty_refs(t: Tables) -> DataFrame:
    """Orders of unknown customers, with unknown statuses and with negative totals."""
    key = F.col("order_id")
    return (
        t["orders"]
        .withColumn("customer_id", F.col("customer_id") + F.when(key % 83 == 0, 1_000_000_000).otherwise(0))
        .withColumn("order_status", F.when(key % 89 == 0, "Lost").otherwise(F.col("order_status")))
        .withColumn("total_amount", F.when(key % 101 == 0, -F.col("total_amount")).otherwise(F.col("total_amount")))
    )


def dirty_deliveries(t: Tables) -> DataFrame:
    """Two of three orders delivered twice, some a third time and later."""
    key, copy = F.col("order_id"), F.col("_copy")
    copied = _again(t["deliveries"], F.when(key % 9 == 1, _times(3)).when(key % 3 != 0, _times(2)).otherwise(_times(1)))
    return copied.withColumns({
        "delivery_id": F.col("delivery_id") + copy * F.lit(1_000_000_000).cast("bigint"),
        "actual_time_mins": F.col("actual_time_mins") + F.when(copy == 2, 7).otherwise(0),
    }).drop("_copy")


def without_some_customers(t: Tables) -> DataFrame:
    return t["customers"].filter(F.col("customer_id") % 10 != 3)


def messy_orders(t: Tables) -> DataFrame:
    """Orders as text: columns in another order, three layouts of dates, markers of missing values, numbers that are
    none, and every tenth row twice."""
    orders, key = t["orders"], F.col("order_id")
    when = F.col("order_datetime")
    layout = (
        F.when(key % 3 == 0, F.date_format(when, "MM/dd/yyyy HH:mm:ss"))
        .when(key % 3 == 1, F.date_format(when, "dd-MMM-yyyy HH:mm:ss"))
        .otherwise(F.date_format(when, "yyyyMMdd HH:mm:ss"))
    )
    text = orders.select(
        F.col("order_status"),
        F.when(key % 13 == 0, "a lot").when(key % 11 == 0, "N/A").otherwise(F.col("total_amount").cast("string")).alias("total_amount"),
        layout.alias("order_datetime"),
        F.when(F.col("promo_id").isNotNull(), F.concat(F.col("promo_id").cast("string"), F.lit(".0"))).otherwise("NaN").alias("promo_id"),
        F.col("store_id").cast("string").alias("store_id"), key.cast("string").alias("order_id"),
        F.col("customer_id").cast("string").alias("customer_id"),
    )
    return text.unionByName(text.filter(key % 10 == 0))


def messy_cities(t: Tables) -> DataFrame:
    return t["cities"].select("tier", F.concat(F.lit(" "), "state").alias("state"), "city_id", "city_name")


def broken_deliveries(t: Tables) -> DataFrame:
    """Statuses that do not follow from the times, and arrivals a minute late."""
    key, status = F.col("order_id"), F.col("delivery_status")
    swapped = F.when(status == "Delivered", "Delayed").otherwise("Delivered")
    late = F.timestamp_add("MINUTE", F.lit(1), F.col("delivered_at"))
    return t["deliveries"].withColumns({
        "delivery_status": F.when(key % 17 == 0, swapped).otherwise(status),
        "delivered_at": F.when(key % 19 == 0, late).otherwise(F.col("delivered_at")),
    })


def broken_payments(t: Tables) -> DataFrame:
    """Amounts that are off by one, and failures that became successes."""
    key = F.col("order_id")
    return t["payments"].withColumns({
        "paid_amount": (F.col("paid_amount") + F.when(key % 23 == 0, 1).otherwise(0)).cast("decimal(12,2)"),
        "payment_status": F.when(key % 29 == 0, "Success").otherwise(F.col("payment_status")),
    })


def broken_returns(t: Tables) -> DataFrame:
    """Refunds that are off by one, and returns that come too late."""
    key = F.col("order_item_id")
    return t["returns"].withColumns({
        "refund_amount": (F.col("refund_amount") + F.when(key % 5 == 0, 1).otherwise(0)).cast("decimal(12,2)"),
        "return_date": F.date_add("return_date", F.when(key % 7 == 0, 9).otherwise(0).cast("int")),
    })


def repeated_orders(t: Tables) -> DataFrame:
    """Every second order twice, and every third once more in another store, a day later and with another promotion."""
    orders, key = t["orders"], F.col("order_id")
    moved = orders.filter(key % 3 == 0).withColumns({
        "store_id": F.col("store_id") - F.when(F.col("store_id") > 0, 1).otherwise(0),
        "order_datetime": F.timestamp_add("DAY", F.lit(1), F.col("order_datetime")),
        "promo_id": F.when(key % 4 == 0, F.col("promo_id")).otherwise(2),
    })
    return orders.unionByName(orders.filter(key % 2 == 0)).unionByName(moved)


def repeated_items(t: Tables) -> DataFrame:
    """Every second order line twice."""
    return _again(t["order_items"], F.when(F.col("order_item_id") % 2 == 0, _times(2)).otherwise(_times(1))).drop("_copy")


def repeated_returns(t: Tables) -> DataFrame:
    """Every third return three times."""
    return _again(t["returns"], F.when(F.col("return_id") % 3 == 0, _times(3)).otherwise(_times(1))).drop("_copy")


def repeated_customers(t: Tables) -> DataFrame:
    """Every second customer once more in another city, active there if not here; every third customer twice."""
    customers, key = t["customers"], F.col("customer_id")
    moved = customers.filter(key % 2 == 0).withColumns(
        {"city_id": (F.col("city_id") + 1) % 25, "is_active": ~F.col("is_active")}
    )
    return customers.unionByName(moved).unionByName(customers.filter(key % 3 == 0))


def more_orders(t: Tables, month: str) -> DataFrame:
    """The orders of a month once more, under other ids."""
    orders = t["orders"].filter(F.date_format("order_datetime", "yyyy-MM") == month)
    return orders.withColumn("order_id", F.col("order_id") + 1_000_000_000)


def unknown_text(t: Tables) -> DataFrame:
    """Orders as text under names that no schema has; a single order decides the types of two columns."""
    key = F.col("order_id")
    text = key.cast("string")
    return t["orders"].select(
        text.alias("number"), F.col("total_amount").cast("string").alias("amount"), F.col("order_status").alias("word"),
        F.when(key % 2 == 0, "True").otherwise("FALSE").alias("even"),
        F.when(key == 1, "0.5").otherwise(text).alias("nearly_whole"), F.when(key == 1, "none").otherwise(text).alias("nearly_number"),
        F.when(key % 3 == 0, "N/A").otherwise(text).alias("some_missing"), F.lit("NaN").alias("all_missing"),
    )


def long_customers(t: Tables) -> DataFrame:
    """Some names and telephone numbers that are too long, and some that just fit."""
    key = F.col("customer_id")
    return t["customers"].withColumns({
        "full_name": F.when(key % 13 == 0, F.repeat("full_name", F.lit(40))).otherwise(F.col("full_name")),
        "phone": F.when(key % 17 == 0, "9" * 21).when(key % 19 == 0, "9" * 20).otherwise(F.col("phone")),
    })


def all_products_stock(t: Tables) -> DataFrame:
    """The snapshots under other products in every store, so that most products have some."""
    return t["inventory"].withColumn("product_id", F.col("product_id") + 20 * F.col("store_id"))
