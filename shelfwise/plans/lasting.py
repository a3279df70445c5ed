"""The two views as SQL text in a catalog, over the stored tables, so that they outlive the session that made them.

The text says what ``plans.views`` says in expressions, and gives the same rows: ratios from whole numbers, deliveries summed
per order before the join, the newest snapshot by an aggregate that combines before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators.common import COMPLETED

#: The stored tables that the views read.
SOURCES = ["cities", "dark_stores", "products", "inventory", "orders", "deliveries"]
_DONE = ", ".join(f"'{status}'" for status in COMPLETED)


def _mean(total: str, count: str) -> str:
    """Two places, rounded half away from zero, NULL without a count."""
    rounded = f"(abs({total}) * 200 + {count}) DIV (2 * {count})"
    return f"CASE WHEN {count} > 0 THEN CAST(CASE WHEN {total} < 0 THEN -1 ELSE 1 END * ({rounded}) AS DOUBLE) / 100D END"


def store_daily_performance(database: str) -> str:
    return f"""
WITH delays AS (
    SELECT order_id, sum(CASE WHEN delivery_status IN ({_DONE}) THEN actual_time_mins - promised_time_mins END) AS delay_sum,
           count(CASE WHEN delivery_status IN ({_DONE}) THEN actual_time_mins - promised_time_mins END) AS delay_count
    FROM {database}.deliveries GROUP BY order_id
), daily AS (
    SELECT o.store_id, to_date(o.order_datetime) AS order_date, count(DISTINCT o.order_id) AS total_orders,
           sum(CASE WHEN o.order_status = 'Delivered' THEN o.total_amount END) AS revenue,
           sum(CASE WHEN o.order_status = 'Cancelled' THEN 1 ELSE 0 END) AS cancelled_orders,
           sum(d.delay_sum) AS delay_sum, sum(d.delay_count) AS delay_count
    FROM {database}.orders AS o LEFT JOIN delays AS d ON d.order_id = o.order_id
    GROUP BY o.store_id, to_date(o.order_datetime)
)
SELECT daily.store_id, s.store_name, c.city_name, daily.order_date, daily.total_orders,
       CAST(daily.revenue AS DOUBLE) AS total_revenue, daily.cancelled_orders,
       {_mean("daily.delay_sum", "daily.delay_count")} AS avg_delay_mins
FROM daily
JOIN {database}.dark_stores AS s ON s.store_id = daily.store_id
JOIN {database}.cities AS c ON c.city_id = s.city_id"""


def product_inventory_health(database: str) -> str:
    return f"""
WITH newest AS (
    SELECT store_id, product_id, max_by(closing_stock, stock_date) AS closing_stock,
           max_by(reorder_level, stock_date) AS reorder_level, max(stock_date) AS stock_date
    FROM {database}.inventory GROUP BY store_id, product_id
)
SELECT n.store_id, s.store_name, n.product_id, p.product_name, n.closing_stock, n.reorder_level, n.stock_date,
       n.closing_stock <= n.reorder_level AS needs_reorder
FROM newest AS n
JOIN {database}.dark_stores AS s ON s.store_id = n.store_id
JOIN {database}.products AS p ON p.product_id = n.product_id"""


VIEWS = {"store_daily_performance": store_daily_performance, "product_inventory_health": product_inventory_health}


def create_views(spark: SparkSession, database: str) -> None:
    """Create or replace both views next to the stored tables of a database."""
    for name, text in VIEWS.items():
        spark.sql(f"CREATE OR REPLACE VIEW {database}.{name} AS {text(database)}")
