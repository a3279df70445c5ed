"""The 13 operational tables derived from the TPC-H-like test tables (see FIXTURES.md section 3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.calendar import plus_seconds
from ..functions.exact import cents
from ..schemas import MONEY, SCHEMAS
from ..session import dealt_out
from .tables import Tables

# Read with fixed schemas: no job to look at the files, and no column is read that a query does not use.
RAW_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_returnflag string, l_shipdate timestamp_ntz",
}

# The five promotions, and the texts chosen by a remainder.
PROMOTIONS = """
    SELECT CAST(promo_id AS BIGINT) AS promo_id, promo_code, description,
           CAST(discount_pct AS DECIMAL(5, 2)) AS discount_pct, start_date, end_date
    FROM VALUES
      (1, 'NEWHERE', 'A tenth off at the start', 10, DATE'1995-01-01', DATE'1996-12-31'),
      (2, 'BASKET15',    'Fifteen off the basket',   15, DATE'1996-01-01', DATE'1997-12-31'),
      (3, 'SUNDAY', 'A fifth off on Sundays',   20, DATE'1997-01-01', DATE'1998-12-31'),
      (4, 'HARVEST',    'A quarter off in autumn',  25, DATE'1998-01-01', DATE'1999-12-31'),
      (5, 'QUICK5',    'Five off for an hour',      5, DATE'1999-01-01', DATE'2001-12-31')
      AS t(promo_id, promo_code, description, discount_pct, start_date, end_date)
"""
SHELF_LIVES = [2, 5, 12, 24, 60, 150, 400]
VEHICLES = ["Bike", "Bicycle", "Scooter"]
PROMISED_MINUTES = [9, 14, 22, 34]
PAYMENT_METHODS = ["UPI", "Card", "Wallet", "COD", "NetBanking"]
RETURN_REASONS = ["Broken on arrival", "Not what was ordered", "Past its date", "Poor quality", "No longer wanted"]


def _pick(values: list, index: Column) -> Column:
    return F.element_at(F.array([F.lit(v) for v in values]), (index + 1).cast("int"))


def _whole_div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _typed(df: DataFrame, name: str, *extra: str) -> DataFrame:
    """Select the table's columns with its types, and ``extra`` columns as they are."""
    present = [f for f in SCHEMAS[name] if f.name in df.columns]
    return df.select(*[F.col(f.name).cast(f.dataType) for f in present], *extra)


def _cities(t: Tables) -> DataFrame:
    tier = F.when(F.col("n_regionkey") <= 1, "Tier1").when(F.col("n_regionkey") <= 3, "Tier2").otherwise("Tier3")
    df = t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    return _typed(
        df.select(
            F.col("n_nationkey").alias("city_id"), F.col("n_name").alias("city_name"), F.col("r_name").alias("state"),
            tier.alias("tier"),
        ),
        "cities",
    )


def _first_day_plus(remainder: Column) -> Column:
    return F.date_add(F.lit("1993-01-01").cast("date"), remainder.cast("int"))


def _dark_stores(t: Tables) -> DataFrame:
    key = F.col("s_suppkey")
    return _typed(
        t["supplier"].select(
            key.alias("store_id"), F.col("s_name").alias("store_name"), F.col("s_nationkey").alias("city_id"),
            (key % 5 * 500 + 1500).alias("store_area_sqft"), _first_day_plus(key % 700).alias("opened_date"),
            (key % 20 != 0).alias("is_active"),
        ),
        "dark_stores",
    )


def _leaf_categories(t: Tables) -> DataFrame:
    # Types and brands are a fixed vocabulary, so the two numbering windows see few rows.
    pairs = t["part"].select("p_type", "p_brand").distinct()
    return pairs.select(
        "p_type",
        "p_brand",
        F.dense_rank().over(Window.orderBy("p_type")).cast("bigint").alias("root_id"),
        (F.dense_rank().over(Window.orderBy("p_type", "p_brand")) + 100).cast("bigint").alias("leaf_id"),
    )


def _categories(t: Tables) -> DataFrame:
    leaves = _leaf_categories(t)
    no_parent = F.lit(None).cast("bigint").alias("parent_category_id")
    roots = leaves.select(F.col("root_id").alias("category_id"), F.col("p_type").alias("category_name"), no_parent)
    children = leaves.select(
        F.col("leaf_id").alias("category_id"),
        F.concat_ws(" ", "p_type", "p_brand").alias("category_name"),
        F.col("root_id").alias("parent_category_id"),
    )
    return roots.distinct().unionByName(children)


def _products(t: Tables) -> DataFrame:
    df = t["part"].join(_leaf_categories(t), ["p_type", "p_brand"])
    return _typed(
        df.select(
            F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"),
            F.col("leaf_id").alias("category_id"), F.col("p_brand").alias("brand"),
            F.col("p_retailprice").alias("unit_price"),
            (F.floor(F.col("p_retailprice") * 70).cast(MONEY) / 100).alias("unit_cost"),
            _pick(SHELF_LIVES, F.col("p_size") % 7).alias("shelf_life_days"),
            (F.col("p_partkey") % 33 != 0).alias("is_active"),
        ),
        "products",
    )


def _customers(t: Tables) -> DataFrame:
    key = F.col("c_custkey")
    return _typed(
        t["customer"].select(
            key.alias("customer_id"), F.col("c_name").alias("full_name"),
            F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"), F.lit(None).alias("phone"),
            F.col("c_nationkey").alias("city_id"), _first_day_plus(key % 730).alias("signup_date"),
            (F.col("c_acctbal") > 0).alias("is_active"),
        ),
        "customers",
    )


def _delivery_partners(t: Tables) -> DataFrame:
    key = F.col("s_suppkey")
    return _typed(
        t["supplier"].select(
            key.alias("partner_id"), F.concat(F.lit("Partner "), F.col("s_name")).alias("partner_name"),
            F.col("s_nationkey").alias("city_id"), _pick(VEHICLES, key % 3).alias("vehicle_type"),
            _first_day_plus(key % 700).alias("joined_date"),
            ((key % 19 + 32).cast("decimal(4,0)") / 10).alias("rating"),
        ),
        "delivery_partners",
    )


def _supplier_count(t: Tables) -> Column:
    return t["supplier"].agg(F.count(F.lit(1)).alias("n")).scalar()


def _orders(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    status = (
        F.when(F.col("o_orderstatus").isin("F", "O"), "Delivered")
        .when(key % 3 == 0, "Cancelled")
        .when(key % 3 == 1, "Returned")
        .otherwise("Placed")
    )
    return _typed(
        t["raw_orders"].select(
            key.alias("order_id"), F.col("o_custkey").alias("customer_id"),
            ((key * 7 + F.col("o_custkey")) % _supplier_count(t)).alias("store_id"),
            F.when(key % 4 == 0, key % 5 + 1).alias("promo_id"),
            plus_seconds(F.col("o_orderdate"), key * 7919 % 61200 + 25200).alias("order_datetime"),
            status.alias("order_status"), F.col("o_totalprice").alias("total_amount"), "o_orderpriority",
        ),
        "orders",
        "o_orderpriority",
    )


def _order_lines(t: Tables) -> DataFrame:
    return _numbered_lines(t["lineitem"])


def _numbered_lines(lineitem: DataFrame) -> DataFrame:
    """Order lines of whole orders."""
    price = cents(F.col("l_extendedprice").cast(MONEY)).cast("bigint")
    quantity = F.col("l_quantity").cast("bigint")
    unit = _whole_div(price, quantity)
    # The id leaves room for 999,999 lines, which also bounds the rows of one order in the window.
    line = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"
    )
    total = F.when(F.col("l_linenumber") == 1, price).otherwise(quantity * unit)
    return _typed(
        lineitem.select(
            (F.col("l_orderkey") * 1_000_000 + F.row_number().over(line)).alias("order_item_id"),
            F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"),
            quantity.alias("quantity"), (unit.cast("decimal(20,0)") / 100).alias("unit_price"),
            (total.cast("decimal(20,0)") / 100).alias("line_total"), "l_returnflag",
        ),
        "order_items",
        "l_returnflag",
    )


def _order_items(t: Tables) -> DataFrame:
    return t["order_lines"].drop("l_returnflag")


def _deliveries(t: Tables) -> DataFrame:
    key = F.col("order_id")
    sent = t["orders"].filter(F.col("order_status") != "Placed").select(
        "order_id", "order_datetime", "order_status", (key * 13 % _supplier_count(t)).alias("partner_id"),
        _pick(PROMISED_MINUTES, key % 4).alias("promised_time_mins"),
    )
    minutes = F.greatest(F.lit(4), F.col("promised_time_mins") + key * 31 % 29 - 14)
    actual = F.when(F.col("order_status") != "Cancelled", minutes)
    dispatched = plus_seconds(F.col("order_datetime"), (key % 4 + 1) * 60)
    status = (
        F.when(F.col("order_status") == "Cancelled", "Cancelled")
        .when(F.col("order_status") == "Returned", "Delayed")
        .when(minutes <= F.col("promised_time_mins") + 5, "Delivered")
        .otherwise("Delayed")
    )
    return _typed(
        sent.select(
            key.alias("delivery_id"), key, "partner_id", "promised_time_mins", actual.alias("actual_time_mins"),
            dispatched.alias("dispatched_at"), plus_seconds(dispatched, actual * 60).alias("delivered_at"),
            status.alias("delivery_status"),
        ),
        "deliveries",
    )


def _payments(t: Tables) -> DataFrame:
    key = F.col("order_id")
    status = (
        F.when(F.col("order_status") != "Cancelled", "Success").when(key % 2 == 0, "Failed").otherwise("Refunded")
    )
    return _typed(
        t["orders_with_priority"].select(
            key.alias("payment_id"), key,
            _pick(PAYMENT_METHODS, F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("payment_method"),
            status.alias("payment_status"),
            F.when(F.col("order_status") != "Cancelled", F.col("total_amount")).otherwise(0).alias("paid_amount"),
            plus_seconds(F.col("order_datetime"), (key % 5 + 1) * 60).alias("paid_at"),
        ),
        "payments",
    )


def _returns(t: Tables) -> DataFrame:
    item = F.col("order_item_id")
    sent_back = t["orders"].filter(F.col("order_status") == "Returned").select("order_id", "order_datetime")
    # Few orders are sent back; the lines of the others need no numbers.
    lines = t["lineitem"].join(sent_back.select(F.col("order_id").alias("l_orderkey")), "l_orderkey", "left_semi")
    back = _numbered_lines(lines).filter(F.col("l_returnflag") == "R")
    return _typed(
        back.join(sent_back, "order_id").select(
            item.alias("return_id"), item, _pick(RETURN_REASONS, item % 5).alias("return_reason"),
            F.date_add(F.to_date("order_datetime"), (item % 5 + 1).cast("int")).alias("return_date"),
            F.col("line_total").alias("refund_amount"),
        ),
        "returns",
    )


def _inventory(t: Tables) -> DataFrame:
    # Nearly every line has a key of its own: combining them before the shuffle would only hold them all in memory.
    key = ["store_id", "product_id", "stock_date"]
    sold = t["lineitem"].select(
        F.col("l_suppkey").alias("store_id"), (F.col("l_partkey") % 20).alias("product_id"),
        F.trunc(F.to_date("l_shipdate"), "week").alias("stock_date"), F.col("l_quantity").cast("bigint").alias("quantity"),
    )
    weekly = dealt_out(sold, t["lineitem"].count(), *key).groupBy(*key).agg(F.sum("quantity").alias("units_sold"))
    week = _whole_div(F.date_diff("stock_date", F.lit("1995-01-02").cast("date")).cast("bigint"), F.lit(7))
    k = F.col("k")
    stocked = (
        weekly.withColumn("k", F.col("store_id") * 37 + F.col("product_id") * 101 + week * 17)
        .withColumn("inventory_id", (F.col("store_id") * 20 + F.col("product_id")) * 10_000 + week)
        .withColumn("opening_stock", k % 61)
        .withColumn("units_received", k * 13 % 41)
        .withColumn("units_wasted", F.when(k % 10 == 0, k % 6).otherwise(0))
    )
    left = F.col("opening_stock") + F.col("units_received") - F.col("units_sold") - F.col("units_wasted")
    return _typed(
        stocked.withColumn("closing_stock", F.greatest(left, F.lit(0))).withColumn("reorder_level", F.lit(20)),
        "inventory",
    )


def grading_tables(spark: SparkSession, folder: str) -> Tables:
    def raw(name: str) -> DataFrame:
        return spark.read.schema(RAW_SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")

    return Tables(
        {
            "region": lambda t: raw("region"),
            "nation": lambda t: raw("nation"),
            "supplier": lambda t: raw("supplier"),
            "customer": lambda t: raw("customer"),
            "part": lambda t: raw("part"),
            "lineitem": lambda t: raw("lineitem"),
            "raw_orders": lambda t: raw("orders"),
            "cities": _cities,
            "dark_stores": _dark_stores,
            "categories": _categories,
            "products": _products,
            "customers": _customers,
            "promotions": lambda t: spark.sql(PROMOTIONS),
            "delivery_partners": _delivery_partners,
            "orders_with_priority": _orders,
            "orders": lambda t: t["orders_with_priority"].drop("o_orderpriority"),
            "order_lines": _order_lines,
            "order_items": _order_items,
            "deliveries": _deliveries,
            "payments": _payments,
            "returns": _returns,
            "inventory": _inventory,
        },
        # Made row by row from tables with these keys.
        unique=["customers", "orders", "order_items", "deliveries", "payments", "returns"],
    )
