"""The operational tables as DuckDB common table expressions, named ``c_<table>``."""

from __future__ import annotations

import re

_MONEY = "DECIMAL(12, 2)"

_LINES = f"""
SELECT CAST(l_orderkey * 1000000 + row_number() OVER (
         PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice
       ) AS BIGINT) AS order_item_id,
       l_orderkey AS order_id, l_partkey AS product_id, q AS quantity,
       CAST(CAST(x // q AS DECIMAL(18, 0)) / 100 AS {_MONEY}) AS unit_price,
       CAST(CAST(CASE WHEN l_linenumber = 1 THEN x ELSE q * (x // q) END AS DECIMAL(18, 0)) / 100 AS {_MONEY})
         AS line_total,
       l_returnflag
FROM (SELECT *, CAST(l_quantity AS BIGINT) AS q,
             CAST(CAST(l_extendedprice AS {_MONEY}) * 100 AS BIGINT) AS x FROM lineitem)
"""

_ORDERS = f"""
SELECT o_orderkey AS order_id, o_custkey AS customer_id,
       (o_orderkey * 7 + o_custkey) % (SELECT count(*) FROM supplier) AS store_id,
       CASE WHEN o_orderkey % 4 = 0 THEN 1 + o_orderkey % 5 END AS promo_id,
       o_orderdate + to_seconds(25200 + (o_orderkey * 7919) % 61200) AS order_datetime,
       CASE WHEN o_orderstatus IN ('F', 'O') THEN 'Delivered'
            WHEN o_orderkey % 3 = 0 THEN 'Cancelled'
            WHEN o_orderkey % 3 = 1 THEN 'Returned'
            ELSE 'Placed' END AS order_status,
       CAST(o_totalprice AS {_MONEY}) AS total_amount,
       o_orderpriority
FROM orders
"""

_INVENTORY = """
SELECT CAST((store_id * 20 + product_id) * 10000 + date_diff('day', DATE '1995-01-02', stock_date) // 7 AS BIGINT)
         AS inventory_id,
       store_id, product_id, stock_date,
       CAST(k % 61 AS BIGINT) AS opening_stock,
       CAST(greatest(k % 61 + (k * 13) % 41 - units_sold - CASE WHEN k % 10 = 0 THEN k % 6 ELSE 0 END, 0) AS BIGINT)
         AS closing_stock,
       CAST(20 AS BIGINT) AS reorder_level,
       CAST((k * 13) % 41 AS BIGINT) AS units_received,
       units_sold,
       CAST(CASE WHEN k % 10 = 0 THEN k % 6 ELSE 0 END AS BIGINT) AS units_wasted
FROM (SELECT *, 37 * store_id + 101 * product_id
                + 17 * (date_diff('day', DATE '1995-01-02', stock_date) // 7) AS k
      FROM (SELECT l_suppkey AS store_id, l_partkey % 20 AS product_id,
                   CAST(date_trunc('week', l_shipdate) AS DATE) AS stock_date,
                   CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS units_sold
            FROM lineitem GROUP BY ALL))
"""

TABLES: dict[str, str] = {
    "c_cities": """
SELECT CAST(n_nationkey AS BIGINT) AS city_id, n_name AS city_name, r_name AS state,
       CASE WHEN n_regionkey <= 1 THEN 'Tier1' WHEN n_regionkey <= 3 THEN 'Tier2' ELSE 'Tier3' END AS tier
FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "c_dark_stores": """
SELECT s_suppkey AS store_id, s_name AS store_name, CAST(s_nationkey AS BIGINT) AS city_id,
       CAST(1500 + 500 * (s_suppkey % 5) AS BIGINT) AS store_area_sqft,
       DATE '1993-01-01' + CAST(s_suppkey % 700 AS INTEGER) AS opened_date, s_suppkey % 20 <> 0 AS is_active
FROM supplier""",
    "c_leaves": """
SELECT p_type, p_brand, dense_rank() OVER (ORDER BY p_type) AS root_id,
       100 + dense_rank() OVER (ORDER BY p_type, p_brand) AS leaf_id
FROM (SELECT DISTINCT p_type, p_brand FROM part)""",
    "c_categories": """
SELECT DISTINCT root_id AS category_id, p_type AS category_name, CAST(NULL AS BIGINT) AS parent_category_id
FROM c_leaves
UNION ALL
SELECT leaf_id, p_type || ' ' || p_brand, root_id FROM c_leaves""",
    "c_products": f"""
SELECT p_partkey AS product_id, p_name AS product_name, leaf_id AS category_id, part.p_brand AS brand,
       CAST(p_retailprice AS {_MONEY}) AS unit_price,
       CAST(CAST(floor(p_retailprice * 70) AS DECIMAL(18, 0)) / 100 AS {_MONEY}) AS unit_cost,
       CAST(list_extract([2, 5, 12, 24, 60, 150, 400], p_size % 7 + 1) AS BIGINT) AS shelf_life_days,
       p_partkey % 33 <> 0 AS is_active
FROM part JOIN c_leaves ON part.p_type = c_leaves.p_type AND part.p_brand = c_leaves.p_brand""",
    "c_customers": """
SELECT c_custkey AS customer_id, c_name AS full_name, lower(c_name) || '@example.com' AS email,
       CAST(NULL AS VARCHAR) AS phone, CAST(c_nationkey AS BIGINT) AS city_id,
       DATE '1993-01-01' + CAST(c_custkey % 730 AS INTEGER) AS signup_date, c_acctbal > 0 AS is_active
FROM customer""",
    "c_promotions": """
SELECT CAST(promo_id AS BIGINT) AS promo_id, promo_code, description, CAST(discount_pct AS DECIMAL(5, 2)) AS discount_pct,
       start_date, end_date
FROM (VALUES (1, 'NEWHERE', 'A tenth off at the start', 10, DATE '1995-01-01', DATE '1996-12-31'),
             (2, 'BASKET15', 'Fifteen off the basket', 15, DATE '1996-01-01', DATE '1997-12-31'),
             (3, 'SUNDAY', 'A fifth off on Sundays', 20, DATE '1997-01-01', DATE '1998-12-31'),
             (4, 'HARVEST', 'A quarter off in autumn', 25, DATE '1998-01-01', DATE '1999-12-31'),
             (5, 'QUICK5', 'Five off for an hour', 5, DATE '1999-01-01', DATE '2001-12-31'))
     AS t(promo_id, promo_code, description, discount_pct, start_date, end_date)""",
    "c_delivery_partners": """
SELECT s_suppkey AS partner_id, 'Partner ' || s_name AS partner_name, CAST(s_nationkey AS BIGINT) AS city_id,
       CASE s_suppkey % 3 WHEN 0 THEN 'Bike' WHEN 1 THEN 'Bicycle' ELSE 'Scooter' END AS vehicle_type,
       DATE '1993-01-01' + CAST(s_suppkey % 700 AS INTEGER) AS joined_date,
       CAST(CAST(32 + s_suppkey % 19 AS DECIMAL(4, 0)) / 10 AS DECIMAL(2, 1)) AS rating
FROM supplier""",
    "c_orders": _ORDERS,
    "c_order_lines": _LINES,
    "c_order_items": "SELECT * EXCLUDE (l_returnflag) FROM c_order_lines",
    "c_deliveries": """
SELECT order_id AS delivery_id, order_id, partner_id, promised AS promised_time_mins,
       actual AS actual_time_mins, dispatched_at, dispatched_at + to_seconds(60 * actual) AS delivered_at,
       CASE WHEN order_status = 'Cancelled' THEN 'Cancelled'
            WHEN order_status = 'Returned' THEN 'Delayed'
            WHEN actual <= promised + 5 THEN 'Delivered' ELSE 'Delayed' END AS delivery_status
FROM (SELECT *, CASE WHEN order_status <> 'Cancelled'
                     THEN greatest(4, promised + (order_id * 31) % 29 - 14) END AS actual
      FROM (SELECT *, (order_id * 13) % (SELECT count(*) FROM supplier) AS partner_id,
                   CAST(list_extract([9, 14, 22, 34], CAST(order_id % 4 + 1 AS BIGINT)) AS BIGINT) AS promised,
                   order_datetime + to_seconds(60 * (1 + order_id % 4)) AS dispatched_at
            FROM c_orders WHERE order_status <> 'Placed'))""",
    "c_payments": """
SELECT order_id AS payment_id, order_id,
       list_extract(['UPI', 'Card', 'Wallet', 'COD', 'NetBanking'], CAST(left(o_orderpriority, 1) AS INTEGER))
         AS payment_method,
       CASE WHEN order_status <> 'Cancelled' THEN 'Success' WHEN order_id % 2 = 0 THEN 'Failed' ELSE 'Refunded' END
         AS payment_status,
       CASE WHEN order_status <> 'Cancelled' THEN total_amount ELSE 0 END AS paid_amount,
       order_datetime + to_seconds(60 * (1 + order_id % 5)) AS paid_at
FROM c_orders""",
    "c_returns": """
SELECT order_item_id AS return_id, order_item_id,
       list_extract(['Broken on arrival', 'Not what was ordered', 'Past its date', 'Poor quality', 'No longer wanted'],
                    CAST(order_item_id % 5 + 1 AS BIGINT)) AS return_reason,
       CAST(order_datetime AS DATE) + CAST(1 + order_item_id % 5 AS INTEGER) AS return_date,
       line_total AS refund_amount
FROM c_order_lines JOIN c_orders USING (order_id)
WHERE l_returnflag = 'R' AND order_status = 'Returned'""",
    "c_inventory": _INVENTORY,
    # Dirty inputs, see FIXTURES.md section 4.
    "c_dirty_orders": """
SELECT order_id, customer_id, store_id, promo_id,
       CASE WHEN order_id % 50 = 0 THEN 'not a date' ELSE strftime(order_datetime, '%Y-%m-%d %H:%M:%S') END
         AS order_datetime,
       CASE WHEN order_id % 97 <> 0 THEN order_status END AS order_status, total_amount
FROM (SELECT * FROM c_orders UNION ALL SELECT * FROM c_orders WHERE order_id % 10 = 0)""",
    "c_dirty_customers": """
SELECT customer_id, '  ' || full_name || chr(9) || ' ' AS full_name,
       CASE WHEN customer_id % 41 <> 0 THEN upper(email) END AS email, phone, city_id,
       strftime(signup_date, '%Y-%m-%d') AS signup_date, is_active
FROM c_customers""",
    "c_dirty_inventory": """
SELECT inventory_id, store_id, product_id,
       CASE WHEN product_id = 7 AND store_id % 5 = 0 THEN 'bad' ELSE strftime(stock_date, '%Y-%m-%d') END
         AS stock_date,
       opening_stock, closing_stock, reorder_level, units_received, units_sold,
       CASE WHEN units_wasted <> 0 THEN units_wasted END AS units_wasted
FROM (SELECT * FROM c_inventory
      UNION ALL SELECT * REPLACE (closing_stock + 1 AS closing_stock) FROM c_inventory WHERE store_id = 3)""",
    "c_dirty_deliveries": """
SELECT * FROM c_deliveries
UNION ALL SELECT * REPLACE (delivery_id + 1000000000 AS delivery_id) FROM c_deliveries WHERE order_id % 3 <> 0
UNION ALL SELECT * REPLACE (delivery_id + 2000000000 AS delivery_id, actual_time_mins + 7 AS actual_time_mins)
FROM c_deliveries WHERE order_id % 9 = 1""",
    "c_broken_deliveries": """
SELECT * REPLACE (
  CASE WHEN order_id % 17 <> 0 THEN delivery_status WHEN delivery_status = 'Delivered' THEN 'Delayed' ELSE 'Delivered' END
    AS delivery_status,
  CASE WHEN order_id % 19 = 0 THEN delivered_at + INTERVAL 1 MINUTE ELSE delivered_at END AS delivered_at)
FROM c_deliveries""",
    "c_broken_payments": """
SELECT * REPLACE (CASE WHEN order_id % 23 = 0 THEN paid_amount + 1 ELSE paid_amount END AS paid_amount,
                  CASE WHEN order_id % 29 = 0 THEN 'Success' ELSE payment_status END AS payment_status)
FROM c_payments""",
    "c_broken_returns": """
SELECT * REPLACE (CASE WHEN order_item_id % 5 = 0 THEN refund_amount + 1 ELSE refund_amount END AS refund_amount,
                  CASE WHEN order_item_id % 7 = 0 THEN return_date + 9 ELSE return_date END AS return_date)
FROM c_returns""",
    "c_repeated_orders": """
SELECT * FROM c_orders
UNION ALL SELECT * FROM c_orders WHERE order_id % 2 = 0
UNION ALL SELECT * REPLACE (CASE WHEN store_id > 0 THEN store_id - 1 ELSE store_id END AS store_id,
                            order_datetime + INTERVAL 1 DAY AS order_datetime,
                            CASE WHEN order_id % 4 = 0 THEN promo_id ELSE 2 END AS promo_id)
FROM c_orders WHERE order_id % 3 = 0""",
    "c_repeated_items": """
SELECT * FROM c_order_items UNION ALL SELECT * FROM c_order_items WHERE order_item_id % 2 = 0""",
    "c_repeated_returns": """
SELECT * FROM c_returns UNION ALL SELECT * FROM c_returns WHERE return_id % 3 = 0
UNION ALL SELECT * FROM c_returns WHERE return_id % 3 = 0""",
    "c_repeated_customers": """
SELECT * FROM c_customers
UNION ALL SELECT * REPLACE ((city_id + 1) % 25 AS city_id, NOT is_active AS is_active) FROM c_customers WHERE customer_id % 2 = 0
UNION ALL SELECT * FROM c_customers WHERE customer_id % 3 = 0""",
    "c_long_customers": """
SELECT * REPLACE (CASE WHEN customer_id % 13 = 0 THEN repeat(full_name, 40) ELSE full_name END AS full_name,
                  CASE WHEN customer_id % 17 = 0 THEN repeat('9', 21) WHEN customer_id % 19 = 0 THEN repeat('9', 20) ELSE phone END AS phone)
FROM c_customers""",
    "c_all_products_stock": "SELECT * REPLACE (product_id + 20 * store_id AS product_id) FROM c_inventory",
    "c_dirty_refs": """
SELECT * REPLACE (
  CASE WHEN order_id % 83 = 0 THEN customer_id + 1000000000 ELSE customer_id END AS customer_id,
  CASE WHEN order_id % 89 = 0 THEN 'Lost' ELSE order_status END AS order_status,
  CASE WHEN order_id % 101 = 0 THEN -total_amount ELSE total_amount END AS total_amount)
FROM c_orders""",
}


def _uses(sql: str) -> list[str]:
    return [name for name in TABLES if re.search(rf"\b{name}\b", sql)]


def with_tables(body: str) -> str:
    """Put the tables ``body`` names, and those they name in turn, in front of it."""
    needed: set[str] = set()
    pending = _uses(body)
    while pending:
        name = pending.pop()
        if name not in needed:
            needed.add(name)
            pending += _uses(TABLES[name])
    # TABLES lists every table after the ones it uses.
    parts = ",\n".join(f"{name} AS ({TABLES[name].strip()})" for name in TABLES if name in needed)
    body = body.strip()
    recursive = re.match(r"WITH\s+RECURSIVE\s+", body, re.I)
    plain = re.match(r"WITH\s+", body, re.I)
    if not parts:
        return body
    if recursive:
        return f"WITH RECURSIVE {parts},\n{body[recursive.end():]}"
    if plain:
        return f"WITH {parts},\n{body[plain.end():]}"
    return f"WITH {parts}\n{body}"
