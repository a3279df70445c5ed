"""Data quality: the schema's constraints and the business rules, checked as batch jobs.

Constraint audits return ``(rule, table_name, violations)``.  Business rules are functions that return the
offending rows, for review; ``count_rule`` turns them into the same shape.  A condition that is NULL passes,
as a CHECK would.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import plus_seconds
from ..functions.exact import cents, count_where
from ..schemas import COLUMN_DEFAULTS, DOMAINS, FOREIGN_KEYS, NOT_NULL, PRIMARY_KEYS, RANGES, TEXT_LENGTHS, UNIQUE_KEYS
from ..sources.files import BASE_TABLES
from ..sources.tables import Tables
from .common import left_lookup
from .inventory import series


def checked_columns(t: Tables, name: str, columns: list[str]) -> DataFrame:
    """The table, if it can be checked: a rule that finds no table or no column must not pass for a clean one."""
    if name not in t:
        raise ValueError(f"not checked: there is no table {name}")
    if missing := sorted(set(columns) - set(t[name].columns)):
        raise ValueError(f"not checked: {name} has no column {', '.join(missing)}")
    return t[name]


def _one_row(df: DataFrame, rule: str, name: str, violations: Column) -> DataFrame:
    return df.agg(F.coalesce(violations, F.lit(0)).cast("bigint").alias("violations")).select(
        F.lit(rule).alias("rule"), F.lit(name).alias("table_name"), "violations"
    )


def key_label(columns: list[str]) -> str:
    return ", ".join(columns)


def _repeated(df: DataFrame, key: list[str]) -> DataFrame:
    """One row per key; copies meet already within a task, so a frequent key costs nothing extra."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))


def _key_is_null(key: list[str]) -> Column:
    return reduce(Column.__or__, [F.col(c).isNull() for c in key])


def primary_keys(t: Tables, names: list[str] = BASE_TABLES) -> DataFrame:
    """Rows without a key, and rows beyond the first of each key, in the named tables."""
    parts = [
        _one_row(
            _repeated(checked_columns(t, name, PRIMARY_KEYS[name]), PRIMARY_KEYS[name]),
            f"primary key {key_label(PRIMARY_KEYS[name])}", name,
            F.sum(F.when(_key_is_null(PRIMARY_KEYS[name]), F.col("n")).otherwise(F.col("n") - 1)),
        )
        for name in names
    ]
    return reduce(DataFrame.unionByName, parts)


def with_checked_keys(t: Tables, names: list[str] = BASE_TABLES) -> Tables:
    """The tables, with the primary keys that hold declared: distinct ids of those are counted without a shuffle by id."""
    found = primary_keys(t, names).filter(F.col("violations") == 0).select("table_name").collect()  # a row per table
    return t.with_unique(row["table_name"] for row in found)


def unique_keys(t: Tables, names: list[str] = [*BASE_TABLES, "monthly_city_revenue"]) -> DataFrame:
    """Rows beyond the first of each key in the named tables; NULL keys may repeat."""
    parts = [
        _one_row(
            _repeated(checked_columns(t, name, key), key), f"unique {key_label(key)}", name,
            F.sum(F.when(~_key_is_null(key), F.col("n") - 1)),
        )
        for name, key in UNIQUE_KEYS
        if name in names
    ]
    return reduce(DataFrame.unionByName, parts)


def foreign_keys(t: Tables) -> DataFrame:
    """Child rows whose parent is missing.

    Every table is read once as a child, for all its references, and once as a parent.  Children are counted per
    reference and key before they meet the parents, all in one join.
    """
    links = list(enumerate(FOREIGN_KEYS))

    def keys(name: str, wanted: list[tuple[int, str]]) -> DataFrame:
        df = checked_columns(t, name, [column for _, column in wanted])
        return df.select(F.inline(F.array(*[
            F.struct(F.lit(link).alias("link"), F.col(column).cast("bigint").alias("key")) for link, column in wanted
        ])))

    children = [
        keys(name, [(link, column) for link, (child, column, _, _) in links if child == name])
        for name in dict.fromkeys(child for child, _, _, _ in FOREIGN_KEYS)
    ]
    parents = [
        keys(name, [(link, key) for link, (_, _, parent, key) in links if parent == name])
        for name in dict.fromkeys(parent for _, _, parent, _ in FOREIGN_KEYS)
    ]
    counted = reduce(DataFrame.unionByName, children).filter(F.col("key").isNotNull()).groupBy("link", "key").agg(
        F.count(F.lit(1)).alias("n")
    )
    orphans = counted.join(reduce(DataFrame.unionByName, parents), ["link", "key"], "left_anti")
    rules = [
        F.struct(F.lit(link).alias("link"), F.lit(f"{column} in {parent}").alias("rule"), F.lit(child).alias("table_name"))
        for link, (child, column, parent, _) in links
    ]
    listed = counted.sparkSession.range(1).select(F.inline(F.array(*rules)))
    return listed.join(orphans.groupBy("link").agg(F.sum("n").alias("n")), "link", "left").select(
        "rule", "table_name", F.coalesce("n", F.lit(0)).cast("bigint").alias("violations")
    )


def _one_pass(t: Tables, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """Count the violations of ``(table, rule, violated)``, reading each table once for all its rules."""
    parts = []
    for name in dict.fromkeys(name for name, _, _ in rules):
        own = [(rule, violated) for table, rule, violated in rules if table == name]
        counts = t[name].agg(
            *[F.coalesce(count_where(violated), F.lit(0)).alias(f"c{i}") for i, (_, violated) in enumerate(own)]
        )
        rows = F.array(
            *[
                F.struct(F.lit(rule).alias("rule"), F.lit(name).alias("table_name"), F.col(f"c{i}").alias("violations"))
                for i, (rule, _) in enumerate(own)
            ]
        )
        parts.append(counts.select(F.inline(rows)))
    return reduce(DataFrame.unionByName, parts)


def domains(t: Tables) -> DataFrame:
    return _one_pass(
        t, [(name, f"{column} domain", ~F.col(column).isin(values)) for (name, column), values in DOMAINS.items()]
    )


def ranges(t: Tables) -> DataFrame:
    return _one_pass(t, [(name, f"{column} range", ~F.expr(holds)) for name, column, holds in RANGES])


def text_lengths(t: Tables) -> DataFrame:
    return _one_pass(
        t, [(name, f"{column} length", F.length(column) > longest) for (name, column), longest in TEXT_LENGTHS.items()]
    )


def not_null(t: Tables) -> DataFrame:
    return _one_pass(
        t, [(name, f"{c} not null", F.col(c).isNull()) for name, columns in NOT_NULL.items() for c in columns]
    )


def apply_defaults(df: DataFrame, name: str) -> DataFrame:
    """Fill missing values with the column defaults of the schema."""
    defaults = COLUMN_DEFAULTS.get(name, {})
    return df.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items() if c in df.columns})


def count_rule(rows: DataFrame, rule: str, name: str) -> DataFrame:
    return _one_row(rows, rule, name, F.count(F.lit(1)))


def stock_balance(t: Tables) -> DataFrame:
    """Closing stock must be what is left, and never negative."""
    left = F.col("opening_stock") + F.col("units_received") - F.col("units_sold") - F.col("units_wasted")
    return t["inventory"].filter(F.col("closing_stock") != F.greatest(left, F.lit(0)))


def stock_continuity(t: Tables) -> DataFrame:
    """Opening stock must be the closing stock of the snapshot before."""
    return (
        t["inventory"]
        .withColumn("previous_closing", F.lag("closing_stock").over(series()))
        .filter(F.col("opening_stock") != F.col("previous_closing"))
    )


def line_total(t: Tables) -> DataFrame:
    """Line total must be quantity times unit price."""
    off = F.abs(F.col("line_total") - F.col("quantity") * F.col("unit_price"))
    return t["order_items"].filter(off > F.lit("0.005").cast("decimal(4,3)"))


def order_total(t: Tables) -> DataFrame:
    """Order total must be the discounted sum of its lines, to half a cent; no lines make a sum of 0."""
    lines = t["order_items"].groupBy("order_id").agg(F.sum("line_total").alias("lines"))
    discounts = t["promotions"].select("promo_id", "discount_pct")
    joined = left_lookup(t["orders"], discounts, "promo_id", spread="order_id").join(lines, "order_id", "left")
    none = F.lit(0).cast("decimal(22,2)")
    # In hundredths of a cent percent: total * 10000 against lines * (10000 - discount in hundredths).
    kept = F.lit(10000).cast("decimal(10,0)") - (F.coalesce("discount_pct", none) * 100).cast("decimal(10,0)")
    off = F.abs(
        cents(F.col("total_amount")).cast("decimal(28,0)") * 10000
        - cents(F.coalesce("lines", none)).cast("decimal(28,0)") * kept
    )
    return joined.filter(off > 5000)


def delivery_status(t: Tables) -> DataFrame:
    """A delivery's status must follow from its order's status and its times; placed orders have none."""
    order, status = F.col("order_status"), F.col("delivery_status")
    by_time = F.when(F.col("actual_time_mins") <= F.col("promised_time_mins") + 5, "Delivered").otherwise("Delayed")
    right = (
        F.when(order == "Delivered", status == by_time)
        .when(order == "Returned", status == "Delayed")
        .when(order == "Cancelled", (status == "Cancelled") & F.col("actual_time_mins").isNull())
        .otherwise(False)
    )
    return t["deliveries"].join(t["orders"].select("order_id", "order_status"), "order_id").filter(~right)


def delivery_clock(t: Tables) -> DataFrame:
    """The delivery time must be the dispatch time plus the actual minutes."""
    arrived = plus_seconds(F.col("dispatched_at"), F.col("actual_time_mins").cast("bigint") * 60)
    return t["deliveries"].filter(~F.col("delivered_at").eqNullSafe(arrived))


def payment(t: Tables) -> DataFrame:
    """Payments succeed unless the order was cancelled, and a success pays the total, anything else nothing."""
    orders = t["orders"].select("order_id", "order_status", "total_amount")
    succeeded = F.col("payment_status") == "Success"
    status_right = succeeded == (F.col("order_status") != "Cancelled")
    amount_right = F.col("paid_amount") == F.when(succeeded, F.col("total_amount")).otherwise(0)
    return t["payments"].join(orders, "order_id").filter(~(status_right & amount_right))


def geography(t: Tables) -> DataFrame:
    """Store, customer and delivery partner of an order must be in one city.

    Returns combinations with their number of ``orders``: they are counted before the joins, so a customer or
    store with very many orders brings one row per combination.
    """
    combinations = (
        t["orders"]
        .select("order_id", "customer_id", "store_id")
        .join(t["deliveries"].select("order_id", "partner_id"), "order_id", "left")
        .groupBy("customer_id", "store_id", "partner_id")
        .agg(F.count(F.lit(1)).alias("orders"))
    )
    apart = (F.col("store_city") != F.col("customer_city")) | (F.col("partner_city") != F.col("customer_city"))
    partners = t["delivery_partners"].select("partner_id", F.col("city_id").alias("partner_city"))
    placed = (
        left_lookup(combinations, partners, "partner_id", spread="customer_id")
        .join(t["dark_stores"].select("store_id", F.col("city_id").alias("store_city")), "store_id")
        .join(t["customers"].select("customer_id", F.col("city_id").alias("customer_city")), "customer_id")
    )
    return placed.filter(apart)


def geography_count(t: Tables) -> DataFrame:
    return _one_row(geography(t), "one city per order", "orders", F.sum("orders"))


def returns(t: Tables) -> DataFrame:
    """Returns must belong to returned orders, refund the line and follow the order by 1 to 5 days."""
    items = t["order_items"].select("order_item_id", "order_id", "line_total")
    orders = t["orders"].select("order_id", "order_status", F.to_date("order_datetime").alias("ordered"))
    right = (
        (F.col("order_status") == "Returned")
        & (F.col("refund_amount") == F.col("line_total"))
        & F.date_diff("return_date", "ordered").between(1, 5)
    )
    return t["returns"].join(items, "order_item_id").join(orders, "order_id").filter(~right)


def promo_window(t: Tables) -> DataFrame:
    """An order's date must lie within its promotion's dates.

    Returns promotions and dates with their number of ``orders``, counted before the join: there are few
    promotions, so joining single orders would put a large share of them in one task.
    """
    days = (
        t["orders"]
        .filter(F.col("promo_id").isNotNull())
        .groupBy("promo_id", F.to_date("order_datetime").alias("order_date"))
        .agg(F.count(F.lit(1)).alias("orders"))
    )
    promotions = t["promotions"].select("promo_id", "start_date", "end_date")
    return days.join(promotions, "promo_id").filter(~F.col("order_date").between(F.col("start_date"), F.col("end_date")))


def promo_window_count(t: Tables) -> DataFrame:
    return _one_row(promo_window(t), "promo window", "orders", F.sum("orders"))
