"""DuckDB SQL per registered query, written with plain joins, DISTINCT and ordinary windows."""

from __future__ import annotations

from .tables import with_tables


def _ratio(part: str, whole: str, digits: int = 2) -> str:
    """Whole numbers divided and rounded half away from zero, NULL for a zero divisor."""
    n, d = f"CAST({part} AS HUGEINT)", f"CAST({whole} AS HUGEINT)"
    sign = f"(CASE WHEN ({n} < 0) <> ({d} < 0) THEN -1 ELSE 1 END)"
    whole_number = f"((abs({n}) * {2 * 10**digits} + abs({d})) // (2 * abs({d})))"
    return f"(CASE WHEN {d} <> 0 THEN CAST({sign} * {whole_number} AS DOUBLE) / CAST({10**digits} AS DOUBLE) END)"


def _percent(part: str, whole: str) -> str:
    return _ratio(f"(100 * ({part}))", whole)


def _cents(amount: str) -> str:
    return f"(100 * {amount})"


def _mean_money(amount: str, count: str) -> str:
    return _ratio(_cents(f"sum({amount})"), f"(100 * {count})")


def _mean(value: str) -> str:
    return _ratio(f"sum({value})", f"count({value})")


_DONE = "delivery_status IN ('Delivered', 'Delayed')"
_IN_TIME = "count(*) FILTER (WHERE actual_time_mins <= promised_time_mins)"
_DELAY = "(actual_time_mins - promised_time_mins)"
_STORE_SALES = """
  FROM c_order_items JOIN c_orders USING (order_id) JOIN c_products USING (product_id)
  JOIN c_categories USING (category_id) WHERE order_status = 'Delivered'"""

_LATEST = """
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY store_id, product_id ORDER BY stock_date DESC) AS newest
                 FROM c_inventory)
  JOIN c_dark_stores USING (store_id) JOIN c_products USING (product_id) WHERE newest = 1"""

_SCORES = f"""
  revenue AS (SELECT store_id, CAST(sum(total_amount) AS DOUBLE) AS total_revenue FROM c_orders
              WHERE order_status = 'Delivered' GROUP BY store_id),
  cancelled AS (SELECT store_id, {_percent("count(*) FILTER (WHERE order_status = 'Cancelled')", "count(*)")}
                AS cancellation_rate_pct FROM c_orders GROUP BY store_id),
  filled AS (SELECT store_id, {_percent("sum(units_sold)", "sum(opening_stock + units_received)")} AS fill_rate_pct
             FROM c_inventory GROUP BY store_id),
  punctual AS (SELECT store_id, {_percent(_IN_TIME, "count(*)")} AS sla_pct
               FROM c_deliveries JOIN c_orders USING (order_id) WHERE {_DONE} GROUP BY store_id),
  scores AS (SELECT store_id, store_name, city_id, total_revenue, fill_rate_pct, sla_pct, cancellation_rate_pct
             FROM c_dark_stores LEFT JOIN revenue USING (store_id) LEFT JOIN cancelled USING (store_id)
             LEFT JOIN filled USING (store_id) LEFT JOIN punctual USING (store_id))"""


def _kpi() -> dict[str, str]:
    return {
        "kpi_fill_rate": f"""
SELECT store_id, store_name, CAST(sum(units_sold) AS BIGINT) AS total_units_sold,
       CAST(sum(opening_stock + units_received) AS BIGINT) AS total_units_available,
       {_percent("sum(units_sold)", "sum(opening_stock + units_received)")} AS fill_rate_pct
FROM c_inventory JOIN c_dark_stores USING (store_id) GROUP BY store_id, store_name""",
        "kpi_sla_by_store": f"""
SELECT store_id, store_name, count(*) AS total_deliveries, {_IN_TIME} AS on_time_deliveries,
       {_percent(_IN_TIME, "count(*)")} AS sla_pct
FROM c_deliveries JOIN c_orders USING (order_id) JOIN c_dark_stores USING (store_id)
WHERE {_DONE} GROUP BY store_id, store_name""",
        "kpi_inventory_turnover": f"""
SELECT store_id, CAST(sum(units_sold) AS BIGINT) AS units_sold,
       {_ratio("sum(opening_stock + closing_stock)", "(2 * count(*))")} AS avg_stock_on_hand,
       {_ratio("(sum(units_sold) * 2 * count(*))", "sum(opening_stock + closing_stock)")} AS inventory_turnover
FROM c_inventory GROUP BY store_id""",
        "kpi_out_of_stock_rate": f"""
SELECT store_id, count(*) AS stock_days_tracked, count(*) FILTER (WHERE closing_stock = 0) AS stockout_days,
       {_percent("count(*) FILTER (WHERE closing_stock = 0)", "count(*)")} AS out_of_stock_rate_pct
FROM c_inventory GROUP BY store_id""",
        "kpi_revenue_lost_stockouts": f"""
WITH demand AS (SELECT store_id, product_id, sum(units_sold) AS sold, count(units_sold) AS days
                FROM c_inventory WHERE closing_stock > 0 GROUP BY store_id, product_id),
     gaps AS (SELECT store_id, product_id, count(*) AS stockout_day_count
              FROM c_inventory WHERE closing_stock = 0 GROUP BY store_id, product_id)
SELECT store_id, product_id, product_name, stockout_day_count, {_ratio("sold", "days")} AS est_daily_demand,
       {_ratio("(stockout_day_count * sold * (unit_price * 100))", "(days * 100)")} AS est_revenue_lost
FROM gaps JOIN demand USING (store_id, product_id) JOIN c_products USING (product_id)
ORDER BY est_revenue_lost DESC, store_id, product_id LIMIT 25""",
        "kpi_aov_by_store": f"""
SELECT store_id, store_name, count(order_id) AS total_orders,
       {_mean_money("total_amount", "count(*)")} AS avg_order_value
FROM c_orders JOIN c_dark_stores USING (store_id) WHERE order_status = 'Delivered' GROUP BY store_id, store_name""",
        "kpi_repeat_customer_rate": f"""
SELECT count(*) AS total_customers_with_orders, count(*) FILTER (WHERE n > 1) AS repeat_customers,
       {_percent("count(*) FILTER (WHERE n > 1)", "count(*)")} AS repeat_customer_rate_pct
FROM (SELECT customer_id, count(*) AS n FROM c_orders WHERE order_status = 'Delivered' GROUP BY customer_id)""",
        "kpi_revenue_by_store": """
SELECT store_id, store_name, city_name, CAST(sum(total_amount) AS DOUBLE) AS total_revenue
FROM c_orders JOIN c_dark_stores USING (store_id) JOIN c_cities USING (city_id)
WHERE order_status = 'Delivered' GROUP BY store_id, store_name, city_name""",
        "kpi_revenue_by_city": """
SELECT city_id, city_name, tier, CAST(sum(total_amount) AS DOUBLE) AS total_revenue,
       count(DISTINCT order_id) AS total_orders
FROM c_orders JOIN c_dark_stores USING (store_id) JOIN c_cities USING (city_id)
WHERE order_status = 'Delivered' GROUP BY city_id, city_name, tier""",
        "kpi_orders_by_place": """
SELECT CASE WHEN grouping(store_id) = 0 THEN 'store' WHEN grouping(city_id) = 0 THEN 'city'
            WHEN grouping(tier) = 0 THEN 'tier' ELSE 'all' END AS level,
       tier, city_id, store_id, count(DISTINCT order_id) AS total_orders
FROM c_orders JOIN c_dark_stores USING (store_id) JOIN c_cities USING (city_id)
WHERE order_status = 'Delivered' GROUP BY ROLLUP (tier, city_id, store_id)""",
        "kpi_cancellation_rate": f"""
SELECT store_id, store_name, count(*) AS total_orders,
       count(*) FILTER (WHERE order_status = 'Cancelled') AS cancelled_orders,
       {_percent("count(*) FILTER (WHERE order_status = 'Cancelled')", "count(*)")} AS cancellation_rate_pct
FROM c_orders JOIN c_dark_stores USING (store_id) GROUP BY store_id, store_name""",
        "kpi_return_rate": f"""
SELECT count(DISTINCT i.order_item_id) AS delivered_items_count, count(DISTINCT r.return_id) AS returned_items_count,
       {_percent("count(DISTINCT r.return_id)", "count(DISTINCT i.order_item_id)")} AS return_rate_pct
FROM c_order_items AS i JOIN c_orders AS o ON o.order_id = i.order_id
LEFT JOIN c_returns AS r ON r.order_item_id = i.order_item_id
WHERE o.order_status IN ('Delivered', 'Returned')""",
    }


def _sales() -> dict[str, str]:
    return {
        "sales_top_products": f"""
SELECT product_id, product_name, category_name, CAST(sum(quantity) AS BIGINT) AS units_sold,
       CAST(sum(line_total) AS DOUBLE) AS total_revenue {_STORE_SALES}
GROUP BY product_id, product_name, category_name ORDER BY sum(line_total) DESC, product_id LIMIT 10""",
        "sales_category_share": f"""
WITH per_category AS (SELECT category_id, category_name, sum(line_total) AS r {_STORE_SALES}
                      GROUP BY category_id, category_name)
SELECT category_name, CAST(r AS DOUBLE) AS revenue, rank() OVER (ORDER BY r DESC) AS revenue_rank,
       {_percent(_cents("sum(r) OVER (ORDER BY r DESC)"), _cents("sum(r) OVER ()"))} AS cumulative_pct_of_revenue
FROM per_category""",
        "sales_weekday_weekend": f"""
SELECT CASE WHEN extract(dow FROM order_datetime) IN (0, 6) THEN 'Weekend' ELSE 'Weekday' END AS day_type,
       count(DISTINCT order_id) AS total_orders, CAST(sum(total_amount) AS DOUBLE) AS total_revenue,
       {_mean_money("total_amount", "count(*)")} AS avg_order_value
FROM c_orders WHERE order_status = 'Delivered' GROUP BY 1""",
        "sales_monthly_mom": f"""
WITH months AS (SELECT strftime(order_datetime, '%Y-%m') AS order_month, sum(total_amount) AS r
                FROM c_orders WHERE order_status = 'Delivered' GROUP BY 1),
     pairs AS (SELECT *, lag(r) OVER (ORDER BY order_month) AS p FROM months)
SELECT order_month, CAST(r AS DOUBLE) AS revenue, CAST(p AS DOUBLE) AS prev_month_revenue,
       {_percent(_cents("(r - p)"), _cents("p"))} AS mom_growth_pct
FROM pairs""",
        "sales_promo_effectiveness": f"""
SELECT CASE WHEN o.promo_id IS NULL THEN 'No Promotion' ELSE promo_code END AS promo_used,
       count(DISTINCT order_id) AS total_orders, {_mean_money("total_amount", "count(*)")} AS avg_order_value,
       CAST(sum(total_amount) AS DOUBLE) AS total_revenue
FROM c_orders AS o LEFT JOIN c_promotions AS p ON p.promo_id = o.promo_id
WHERE order_status = 'Delivered' GROUP BY 1""",
        "sales_best_seller_per_store": """
SELECT store_id, store_name, product_id, product_name, units_sold
FROM (SELECT store_id, store_name, product_id, product_name, CAST(sum(quantity) AS BIGINT) AS units_sold,
             row_number() OVER (PARTITION BY store_id ORDER BY sum(quantity) DESC, product_id) AS place
      FROM c_order_items JOIN c_orders USING (order_id) JOIN c_dark_stores USING (store_id)
      JOIN c_products USING (product_id)
      WHERE order_status = 'Delivered' GROUP BY store_id, store_name, product_id, product_name)
WHERE place = 1""",
        "sales_payment_mix": f"""
SELECT payment_method, count(*) AS total_payments,
       count(*) FILTER (WHERE payment_status = 'Success') AS successful_payments,
       {_percent("count(*) FILTER (WHERE payment_status = 'Success')", "count(*)")} AS success_rate_pct
FROM c_payments GROUP BY payment_method""",
    }


def _delivery() -> dict[str, str]:
    return {
        "delivery_status_breakdown": f"""
SELECT delivery_status, count(*) AS total_deliveries,
       {_percent("count(*)", "sum(count(*)) OVER ()")} AS pct_of_all_deliveries
FROM c_deliveries GROUP BY delivery_status""",
        "delivery_delay_by_city": f"""
SELECT city_name, count(*) AS delivered_orders, {_mean(_DELAY)} AS avg_delay_mins
FROM c_deliveries JOIN c_orders USING (order_id) JOIN c_dark_stores USING (store_id) JOIN c_cities USING (city_id)
WHERE {_DONE} GROUP BY city_name""",
        "delivery_partner_scorecard": f"""
WITH trips AS (SELECT partner_id, partner_name, count(*) AS total_trips, {_IN_TIME} AS on_time_trips,
                      {_mean("actual_time_mins")} AS avg_delivery_time
               FROM c_deliveries JOIN c_delivery_partners USING (partner_id)
               WHERE {_DONE} GROUP BY partner_id, partner_name)
SELECT partner_id, partner_name, total_trips, on_time_trips, {_percent("on_time_trips", "total_trips")} AS on_time_pct,
       avg_delivery_time,
       rank() OVER (ORDER BY CAST(100 * on_time_trips AS DOUBLE) / total_trips DESC) AS on_time_rank
FROM trips WHERE total_trips >= 20""",
        "delivery_percentiles_ntile": f"""
WITH tiled AS (SELECT store_id, store_name, actual_time_mins,
                      ntile(100) OVER (PARTITION BY store_id ORDER BY actual_time_mins NULLS LAST) AS bucket
               FROM c_deliveries JOIN c_orders USING (order_id) JOIN c_dark_stores USING (store_id) WHERE {_DONE})
SELECT store_id, store_name, CAST(max(actual_time_mins) FILTER (WHERE bucket = 50) AS BIGINT) AS approx_p50_mins,
       CAST(max(actual_time_mins) FILTER (WHERE bucket = 90) AS BIGINT) AS approx_p90_mins
FROM tiled GROUP BY store_id, store_name""",
        "delivery_percentiles_exact": f"""
SELECT store_id, store_name, round(quantile_cont(CAST(actual_time_mins AS DOUBLE), 0.5), 1) AS p50_delivery_mins,
       round(quantile_cont(CAST(actual_time_mins AS DOUBLE), 0.9), 1) AS p90_delivery_mins
FROM c_deliveries JOIN c_orders USING (order_id) JOIN c_dark_stores USING (store_id)
WHERE {_DONE} GROUP BY store_id, store_name""",
        "delivery_bottleneck_stores": f"""
WITH trips AS (SELECT store_id, store_name, city_id, {_DELAY} AS delay
               FROM c_deliveries JOIN c_orders USING (order_id) JOIN c_dark_stores USING (store_id) WHERE {_DONE})
SELECT store_id, store_name, city_id, {_mean("delay")} AS store_avg_delay
FROM trips AS t GROUP BY store_id, store_name, city_id
HAVING avg(delay) > (SELECT avg(c.delay) FROM trips AS c WHERE c.city_id = t.city_id)""",
        "delivery_peak_hour": f"""
SELECT extract(hour FROM order_datetime) AS order_hour, count(DISTINCT o.order_id) AS total_orders,
       {_mean(_DELAY)} AS avg_delay_mins
FROM c_orders AS o LEFT JOIN c_deliveries AS d ON d.order_id = o.order_id GROUP BY 1""",
        "delivery_vehicle_performance": f"""
SELECT vehicle_type, count(*) AS total_trips, {_mean("actual_time_mins")} AS avg_delivery_time,
       {_percent(_IN_TIME, "count(*)")} AS on_time_pct
FROM c_deliveries JOIN c_delivery_partners USING (partner_id) WHERE {_DONE} GROUP BY vehicle_type""",
    }


def _customer() -> dict[str, str]:
    return {
        "customer_frequency_segments": f"""
WITH spenders AS (SELECT customer_id, count(*) AS n, sum(total_amount) AS spend
                  FROM c_orders WHERE order_status = 'Delivered' GROUP BY customer_id)
SELECT CASE WHEN n = 1 THEN 'One-time' WHEN n BETWEEN 2 AND 4 THEN 'Occasional'
            WHEN n BETWEEN 5 AND 9 THEN 'Regular' ELSE 'Loyal' END AS customer_segment,
       count(*) AS customers_in_segment, {_mean_money("spend", "count(*)")} AS avg_lifetime_spend
FROM spenders GROUP BY 1""",
        "customer_rfm": """
WITH spenders AS (SELECT customer_id, full_name, max(order_datetime) AS last_order_date,
                         count(order_id) AS frequency, sum(total_amount) AS spend
                  FROM c_customers JOIN c_orders USING (customer_id)
                  WHERE order_status = 'Delivered' GROUP BY customer_id, full_name)
SELECT customer_id, full_name, last_order_date, frequency, CAST(spend AS DOUBLE) AS monetary,
       ntile(4) OVER (ORDER BY last_order_date DESC, customer_id) AS recency_quartile,
       ntile(4) OVER (ORDER BY frequency DESC, customer_id) AS frequency_quartile,
       ntile(4) OVER (ORDER BY spend DESC, customer_id) AS monetary_quartile
FROM spenders""",
        "customer_order_gaps": """
WITH gaps AS (SELECT customer_id, order_id, order_datetime,
                     lag(order_datetime) OVER (PARTITION BY customer_id ORDER BY order_datetime, order_id)
                       AS prev_order_datetime
              FROM c_orders WHERE order_status = 'Delivered')
SELECT *, CAST(date_diff('microsecond', prev_order_datetime, order_datetime) AS DOUBLE) / CAST(86400000000 AS DOUBLE)
            AS days_since_prev_order
FROM gaps""",
        "customer_city_engagement": f"""
SELECT city_name, count(DISTINCT c.customer_id) AS total_customers,
       count(DISTINCT CASE WHEN is_active THEN c.customer_id END) AS active_customers,
       {_ratio("count(order_id)", "count(DISTINCT c.customer_id)")} AS avg_orders_per_customer
FROM c_customers AS c JOIN c_cities USING (city_id)
LEFT JOIN c_orders AS o ON o.customer_id = c.customer_id AND o.order_status = 'Delivered'
GROUP BY city_name""",
        "customer_new_vs_returning": """
WITH firsts AS (SELECT customer_id, min(order_datetime) AS first_order FROM c_orders
                WHERE order_status = 'Delivered' GROUP BY customer_id),
     months AS (SELECT strftime(order_datetime, '%Y-%m') AS order_month, strftime(first_order, '%Y-%m') AS first_month
                FROM c_orders JOIN firsts USING (customer_id) WHERE order_status = 'Delivered')
SELECT order_month, count(*) FILTER (WHERE order_month = first_month) AS new_customers,
       count(*) FILTER (WHERE order_month <> first_month) AS returning_orders
FROM months GROUP BY order_month""",
        "customer_high_value": f"""
WITH spenders AS (SELECT customer_id, sum(total_amount) AS spend FROM c_orders
                  WHERE order_status = 'Delivered' GROUP BY customer_id),
     placed AS (SELECT *, percent_rank() OVER (ORDER BY spend) AS pr, rank() OVER (ORDER BY spend) AS place,
                       count(*) OVER () AS n FROM spenders)
SELECT customer_id, full_name, CAST(spend AS DOUBLE) AS lifetime_spend,
       coalesce({_ratio("(place - 1)", "(n - 1)", 3)}, 0) AS spend_percentile
FROM placed JOIN c_customers USING (customer_id) WHERE pr >= 0.95""",
    }


def _inventory() -> dict[str, str]:
    return {
        "inventory_stockout_risk": f"""
SELECT store_id, store_name, product_id, product_name, closing_stock, reorder_level, stock_date
FROM ({_LATEST}) WHERE closing_stock <= reorder_level""",
        "inventory_wastage_top20": """
SELECT product_id, product_name, shelf_life_days, CAST(sum(units_wasted) AS BIGINT) AS total_units_wasted,
       CAST(sum(units_wasted) * unit_cost AS DOUBLE) AS wastage_cost
FROM c_inventory JOIN c_products USING (product_id)
GROUP BY product_id, product_name, shelf_life_days, unit_cost HAVING sum(units_wasted) > 0
ORDER BY sum(units_wasted) * unit_cost DESC, product_id LIMIT 20""",
        "inventory_wastage_rank": """
WITH wasted AS (SELECT category_id, product_id, product_name, CAST(sum(units_wasted) AS BIGINT) AS total_wasted
                FROM c_inventory JOIN c_products USING (product_id) GROUP BY category_id, product_id, product_name)
SELECT category_name, product_name, total_wasted,
       rank() OVER (PARTITION BY category_id ORDER BY total_wasted DESC) AS wastage_rank_in_category
FROM wasted JOIN c_categories USING (category_id)""",
        "inventory_stock_movement": """
SELECT store_id, product_id, stock_date, closing_stock,
       lag(closing_stock) OVER series AS prev_closing_stock, lead(closing_stock) OVER series AS next_closing_stock,
       closing_stock - lag(closing_stock) OVER series AS stock_change
FROM c_inventory WINDOW series AS (PARTITION BY store_id, product_id ORDER BY stock_date)""",
        "inventory_rolling_avg": f"""
WITH summed AS (SELECT store_id, product_id, stock_date, units_sold, sum(units_sold) OVER four AS s,
                       count(units_sold) OVER four AS n
                FROM c_inventory WINDOW four AS (PARTITION BY store_id, product_id ORDER BY stock_date
                                                 ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
SELECT store_id, product_id, stock_date, units_sold, {_ratio("s", "n")} AS rolling_4period_avg_sold FROM summed""",
        "inventory_running_received": """
SELECT store_id, stock_date, CAST(sum(units_received) AS BIGINT) AS units_received_that_day,
       CAST(sum(sum(units_received)) OVER (PARTITION BY store_id ORDER BY stock_date) AS BIGINT)
         AS running_total_received
FROM c_inventory GROUP BY store_id, stock_date""",
        "inventory_demand_tiers": f"""
WITH sold AS (SELECT product_id, product_name, CAST(sum(units_sold) AS BIGINT) AS total_sold
              FROM c_inventory JOIN c_products USING (product_id) GROUP BY product_id, product_name),
     placed AS (SELECT *, rank() OVER (ORDER BY total_sold) AS place, count(*) OVER () AS n,
                       ntile(4) OVER (ORDER BY total_sold, product_id) AS demand_quartile FROM sold)
SELECT product_id, product_name, total_sold, coalesce({_ratio("(place - 1)", "(n - 1)", 3)}, 0) AS sales_percentile,
       demand_quartile
FROM placed""",
        "inventory_category_tree": """
WITH RECURSIVE tree AS (
  SELECT category_id, category_name, CAST(0 AS BIGINT) AS depth, category_name AS category_path
  FROM c_categories WHERE parent_category_id IS NULL
  UNION ALL
  SELECT c.category_id, c.category_name, tree.depth + 1, tree.category_path || ' > ' || c.category_name
  FROM c_categories AS c JOIN tree ON c.parent_category_id = tree.category_id)
SELECT * FROM tree""",
    }


def _views() -> dict[str, str]:
    monthly = f"""
SELECT city_id, city_name, strftime(order_datetime, '%Y-%m') AS order_month, count(DISTINCT order_id) AS total_orders,
       CAST(sum(total_amount) AS DOUBLE) AS total_revenue, {_mean_money("total_amount", "count(*)")} AS avg_order_value
FROM c_orders JOIN c_dark_stores USING (store_id) JOIN c_cities USING (city_id)
WHERE order_status = 'Delivered' GROUP BY city_id, city_name, order_month"""
    return {
        "view_store_daily_performance": f"""
SELECT store_id, store_name, city_name, CAST(order_datetime AS DATE) AS order_date,
       count(DISTINCT o.order_id) AS total_orders,
       CAST(sum(total_amount) FILTER (WHERE order_status = 'Delivered') AS DOUBLE) AS total_revenue,
       count(*) FILTER (WHERE order_status = 'Cancelled') AS cancelled_orders,
       {_ratio(f"(sum({_DELAY}) FILTER (WHERE {_DONE}))", f"(count({_DELAY}) FILTER (WHERE {_DONE}))")}
         AS avg_delay_mins
FROM c_orders AS o JOIN c_dark_stores USING (store_id) JOIN c_cities USING (city_id)
LEFT JOIN c_deliveries AS d ON d.order_id = o.order_id
GROUP BY store_id, store_name, city_name, CAST(order_datetime AS DATE)""",
        "view_product_inventory_health": f"""
SELECT store_id, store_name, product_id, product_name, closing_stock, reorder_level, stock_date,
       closing_stock <= reorder_level AS needs_reorder FROM ({_LATEST})""",
        "mv_monthly_city_revenue": monthly,
        "job_refresh_dashboard": monthly,
        "job_refresh_months": monthly,
        "job_refresh_changed": monthly.replace("c_orders", """(SELECT * FROM c_orders UNION ALL
  SELECT * REPLACE (order_id + 1000000000 AS order_id) FROM c_orders WHERE strftime(order_datetime, '%Y-%m') = '1997-03')"""),
        "job_flag_low_stock_retried": f"""
SELECT store_id, product_id, closing_stock, reorder_level FROM ({_LATEST}) CROSS JOIN (VALUES (1), (2)) AS runs(run)
WHERE closing_stock <= reorder_level""",
        "job_flag_low_stock": f"""
SELECT store_id, product_id, closing_stock, reorder_level FROM ({_LATEST}) WHERE closing_stock <= reorder_level""",
    }


def _in_contexts(keep: str, sets: str) -> str:
    """The measures from facts stacked under each other, each with the columns it has."""
    def fraction(part: str, whole: str) -> str:
        return f"CAST({part} AS DOUBLE) / nullif(CAST({whole} AS DOUBLE), 0)"

    return f"""
WITH o AS (SELECT *, CAST(date_trunc('month', order_datetime) AS DATE) AS m FROM c_orders),
facts AS (
  SELECT store_id, m, total_amount AS revenue, 1 AS orders, CAST(order_status = 'Cancelled' AS INT) AS cancelled,
         NULL AS in_time, NULL AS deliveries, NULL AS sold, NULL AS available, NULL AS prior FROM o
  UNION ALL
  SELECT store_id, m, NULL, NULL, NULL, coalesce(CAST(actual_time_mins <= promised_time_mins AS INT), 0), 1, NULL, NULL, NULL
  FROM c_deliveries AS d LEFT JOIN o ON o.order_id = d.order_id
  UNION ALL
  SELECT store_id, CAST(date_trunc('month', stock_date) AS DATE), NULL, NULL, NULL, NULL, NULL, units_sold,
         opening_stock + units_received, NULL FROM c_inventory
  UNION ALL
  SELECT store_id, CAST(m + INTERVAL 1 MONTH AS DATE), NULL, NULL, NULL, NULL, NULL, NULL, NULL, total_amount
  FROM o WHERE m + INTERVAL 1 MONTH <= (SELECT max(m) FROM o)
)
SELECT CASE WHEN grouping(tier) = 1 AND grouping(city_id) = 1 AND grouping(store_id) = 1 AND grouping(m) = 1 THEN 'all'
            ELSE concat_ws(' ', CASE WHEN grouping(tier) = 0 THEN 'tier' END, CASE WHEN grouping(city_id) = 0 THEN 'city' END,
                           CASE WHEN grouping(store_id) = 0 THEN 'store' END, CASE WHEN grouping(m) = 0 THEN 'month' END) END AS context,
       tier, city_id, store_id, strftime(m, '%Y-%m') AS order_month, CAST(sum(revenue) AS DOUBLE) AS total_revenue,
       {fraction("sum(in_time)", "sum(deliveries)")} AS sla, {fraction("sum(sold)", "sum(available)")} AS fill_rate,
       {fraction("sum(cancelled)", "sum(orders)")} AS cancellation_rate,
       {fraction("(coalesce(sum(revenue), 0) - sum(prior)) * 100", "sum(prior) * 100")} AS mom_growth
FROM facts LEFT JOIN (SELECT store_id, city_id, tier FROM c_dark_stores JOIN c_cities USING (city_id)) USING (store_id)
WHERE {keep} GROUP BY GROUPING SETS ({sets if "tier" in sets else sets + ", (tier, city_id, store_id, m)"})
{"" if "tier" in sets else "HAVING grouping(store_id) = 1"}"""


def _dashboards() -> dict[str, str]:
    fraction = "CAST({} AS DOUBLE) / nullif(CAST({} AS DOUBLE), 0)"
    sla = fraction.format("count(*) FILTER (WHERE actual_time_mins <= promised_time_mins)", "count(*)")
    filled = fraction.format("sum(units_sold)", "(sum(opening_stock) + sum(units_received))")
    cancelled = fraction.format("count(*) FILTER (WHERE order_status = 'Cancelled')", "count(*)")
    growth = fraction.format("CAST(100 * (m.r - p.r) AS HUGEINT)", "CAST(100 * p.r AS HUGEINT)")
    return {
        "measure_total_revenue": "SELECT CAST(sum(total_amount) AS DOUBLE) AS total_revenue FROM c_orders",
        "measure_sla_pct": f"SELECT {sla} AS sla FROM c_deliveries",
        "measure_fill_rate": f"SELECT {filled} AS fill_rate FROM c_inventory",
        "measure_cancellation_rate": f"SELECT {cancelled} AS cancellation_rate FROM c_orders",
        "measure_mom_growth": f"""
WITH months AS (SELECT CAST(date_trunc('month', order_datetime) AS DATE) AS d, sum(total_amount) AS r
                FROM c_orders GROUP BY 1)
SELECT strftime(m.d, '%Y-%m') AS order_month, CAST(m.r AS DOUBLE) AS total_revenue,
       CAST(p.r AS DOUBLE) AS prior_month_revenue, {growth} AS mom_growth
FROM months AS m LEFT JOIN months AS p ON p.d = CAST(m.d - INTERVAL 1 MONTH AS DATE)""",
        "measures_by_context": _in_contexts("TRUE", "(), (tier), (city_id), (store_id), (m), (city_id, m)"),
        "measures_of_a_year": _in_contexts("extract(year FROM m) = 1997", "(), (m)"),
        "dash_exec_kpis": f"""
SELECT CAST(sum(total_amount) AS DOUBLE) AS total_revenue, count(*) AS total_orders,
       {_mean_money("total_amount", "count(*)")} AS avg_order_value,
       (SELECT {sla} FROM c_deliveries) AS sla, (SELECT {filled} FROM c_inventory) AS fill_rate
FROM c_orders""",
        "dash_revenue_by_category": f"""
SELECT category_name, CAST(sum(line_total) AS DOUBLE) AS revenue {_STORE_SALES} GROUP BY category_id, category_name""",
        "dash_store_scorecard": f"WITH {_SCORES} SELECT * EXCLUDE (city_id) FROM scores",
        "dash_store_matrix_by_city": f"""
WITH {_SCORES} SELECT city_id, city_name, scores.* EXCLUDE (city_id) FROM scores JOIN c_cities USING (city_id)""",
        "dash_sla_by_city": f"""
SELECT city_id, city_name, count(*) AS total_deliveries, {_IN_TIME} AS on_time_deliveries,
       {_percent(_IN_TIME, "count(*)")} AS sla_pct
FROM c_deliveries JOIN c_orders USING (order_id) JOIN c_dark_stores USING (store_id) JOIN c_cities USING (city_id)
WHERE {_DONE} GROUP BY city_id, city_name""",
        "dash_low_stock": f"""
SELECT store_id, store_name, product_id, product_name, closing_stock, reorder_level, stock_date
FROM ({_LATEST}) WHERE closing_stock <= reorder_level""",
        "dim_date": """
WITH days AS (SELECT CAST(order_datetime AS DATE) AS d FROM c_orders
              UNION ALL SELECT stock_date FROM c_inventory
              UNION ALL SELECT CAST(delivered_at AS DATE) FROM c_deliveries)
SELECT CAST(day AS DATE) AS date, strftime(day, '%Y-%m') AS year_month
FROM (SELECT unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS day FROM days)""",
        "sample_preview": """
SELECT order_id, customer_id, store_id, promo_id, order_datetime, order_status,
       CAST(total_amount AS DOUBLE) AS total_amount, full_name, c.city_id, store_name
FROM c_orders JOIN c_customers AS c USING (customer_id) JOIN c_dark_stores USING (store_id)
ORDER BY order_id LIMIT 50""",
    }


def _cleaning() -> dict[str, str]:
    space = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
    orders = """
SELECT order_id, customer_id, store_id, promo_id, try_cast(order_datetime AS TIMESTAMP) AS order_datetime,
       order_status, CAST(total_amount AS DOUBLE) AS total_amount
FROM (SELECT DISTINCT * FROM c_dirty_orders) WHERE order_status IS NOT NULL"""
    stock = """
SELECT inventory_id, store_id, product_id, try_cast(stock_date AS DATE) AS stock_date, opening_stock, closing_stock, reorder_level,
       units_received, units_sold, coalesce(units_wasted, 0) AS units_wasted
FROM (SELECT DISTINCT * FROM c_dirty_inventory) WHERE try_cast(stock_date AS DATE) IS NOT NULL"""
    customers = f"""
SELECT customer_id, {space.format("full_name")} AS full_name, lower({space.format("email")}) AS email, phone, city_id,
       try_cast(signup_date AS DATE) AS signup_date, is_active
FROM (SELECT DISTINCT * FROM c_dirty_customers) WHERE email IS NOT NULL"""
    reports = []
    for name, source, missing in [
        ("cities", "c_cities", "false"), ("categories", "c_categories", "false"),
        ("dark_stores", "c_dark_stores", "store_id IS NULL OR store_name IS NULL OR city_id IS NULL"),
        ("products", "c_products", "product_id IS NULL OR product_name IS NULL OR category_id IS NULL"),
        ("customers", "c_dirty_customers", "customer_id IS NULL OR email IS NULL OR city_id IS NULL"),
        ("promotions", "c_promotions", "false"), ("delivery_partners", "c_delivery_partners", "false"),
        ("inventory", "c_dirty_inventory",
         "store_id IS NULL OR product_id IS NULL OR try_cast(stock_date AS DATE) IS NULL"),
        ("orders", "c_dirty_orders",
         "order_id IS NULL OR customer_id IS NULL OR store_id IS NULL OR order_status IS NULL"),
        ("order_items", "c_order_items",
         "order_item_id IS NULL OR order_id IS NULL OR product_id IS NULL OR quantity IS NULL"),
        ("deliveries", "c_deliveries", "delivery_id IS NULL OR order_id IS NULL OR partner_id IS NULL"),
        ("payments", "c_payments", "payment_id IS NULL OR order_id IS NULL OR payment_method IS NULL"),
        ("returns", "c_returns", "return_id IS NULL OR order_item_id IS NULL OR return_date IS NULL"),
    ]:
        distinct = f"(SELECT DISTINCT * FROM {source})"
        reports.append(f"""
SELECT '{name}' AS table_name, (SELECT count(*) FROM {source}) AS rows_in,
       (SELECT count(*) FROM {source}) - count(*) AS duplicates_removed,
       count(*) FILTER (WHERE {missing}) AS rows_dropped_missing_required,
       count(*) FILTER (WHERE NOT ({missing})) AS rows_out FROM {distinct}""")
    return {
        "clean_dedup": """
SELECT DISTINCT order_id, customer_id, store_id, promo_id, order_datetime, order_status,
       CAST(total_amount AS DOUBLE) AS total_amount FROM c_dirty_orders""",
        "clean_text": f"""
SELECT customer_id, {space.format("full_name")} AS full_name, lower({space.format("email")}) AS email
FROM c_dirty_customers""",
        "clean_dates": "SELECT order_id, try_cast(order_datetime AS TIMESTAMP) AS order_datetime FROM c_dirty_orders",
        "clean_required": """
SELECT store_id, product_id, CAST(stock_date AS DATE) AS stock_date, closing_stock
FROM c_dirty_inventory WHERE try_cast(stock_date AS DATE) IS NOT NULL""",
        "clean_defaults": """
SELECT store_id, product_id, stock_date, closing_stock, units_received, units_sold,
       coalesce(units_wasted, 0) AS units_wasted FROM c_dirty_inventory""",
        "clean_table": orders,
        "clean_table_customers": customers,
        "clean_table_inventory": stock,
        "clean_report": " UNION ALL ".join(reports),
        "apply_defaults": """
SELECT store_id, product_id, stock_date, closing_stock, coalesce(reorder_level, 20) AS reorder_level,
       coalesce(units_received, 0) AS units_received, coalesce(units_sold, 0) AS units_sold,
       coalesce(units_wasted, 0) AS units_wasted FROM c_dirty_inventory""",
    }


def _count(rule: str, table: str, violations: str, source: str) -> str:
    return (
        f"SELECT '{rule}' AS rule, '{table}' AS table_name, CAST(coalesce({violations}, 0) AS BIGINT) AS violations "
        f"FROM {source}"
    )


def _repeats(rule: str, table: str, key: str, source: str) -> str:
    keys = " AND ".join(f"{c.strip()} IS NOT NULL" for c in key.split(","))
    return _count(rule, table, f"count(*) FILTER (WHERE {keys}) - count(DISTINCT ({key})) FILTER (WHERE {keys})", source)


def _audits() -> dict[str, str]:
    keys = {
        "cities": "city_id", "categories": "category_id", "dark_stores": "store_id", "products": "product_id",
        "customers": "customer_id", "promotions": "promo_id", "delivery_partners": "partner_id", "orders": "order_id",
        "order_items": "order_item_id", "deliveries": "delivery_id", "payments": "payment_id", "returns": "return_id",
        "inventory": "inventory_id",
    }

    def primary(orders: str) -> str:
        return " UNION ALL ".join(
            _count(f"primary key {key}", name, f"count(*) - count(DISTINCT {key})",
                   orders if name == "orders" else f"c_{name}")
            for name, key in keys.items()
        )

    def unique(customers: str, inventory: str) -> str:
        monthly = "(SELECT strftime(order_datetime, '%Y-%m') AS order_month, city_id FROM c_orders JOIN c_dark_stores " \
                  "USING (store_id) WHERE order_status = 'Delivered' GROUP BY ALL)"
        return " UNION ALL ".join([
            _repeats("unique email", "customers", "email", customers),
            _repeats("unique promo_code", "promotions", "promo_code", "c_promotions"),
            _repeats("unique store_id, product_id, stock_date", "inventory", "store_id, product_id, stock_date", inventory),
            _repeats("unique order_id", "deliveries", "order_id", "c_deliveries"),
            _repeats("unique order_id", "payments", "order_id", "c_payments"),
            _repeats("unique city_id, order_month", "monthly_city_revenue", "city_id, order_month", monthly),
        ])

    links = [
        ("dark_stores", "city_id", "cities", "city_id"), ("categories", "parent_category_id", "categories", "category_id"),
        ("products", "category_id", "categories", "category_id"), ("inventory", "store_id", "dark_stores", "store_id"),
        ("inventory", "product_id", "products", "product_id"), ("customers", "city_id", "cities", "city_id"),
        ("delivery_partners", "city_id", "cities", "city_id"), ("orders", "customer_id", "customers", "customer_id"),
        ("orders", "store_id", "dark_stores", "store_id"), ("orders", "promo_id", "promotions", "promo_id"),
        ("order_items", "order_id", "orders", "order_id"), ("order_items", "product_id", "products", "product_id"),
        ("deliveries", "order_id", "orders", "order_id"),
        ("deliveries", "partner_id", "delivery_partners", "partner_id"),
        ("payments", "order_id", "orders", "order_id"), ("returns", "order_item_id", "order_items", "order_item_id"),
    ]

    def foreign(orders: str) -> str:
        return " UNION ALL ".join(
            _count(f"{column} in {parent}", child, "count(*)",
                   f"{orders if child == 'orders' else 'c_' + child} AS ch WHERE ch.{column} IS NOT NULL "
                   f"AND NOT EXISTS (SELECT 1 FROM c_{parent} AS pa WHERE pa.{key} = ch.{column})")
            for child, column, parent, key in links
        )

    def listed(rules: list[tuple[str, str, str]], swapped: dict[str, str], kind: str) -> str:
        return " UNION ALL ".join(
            _count(f"{label} {kind}", name, f"count(*) FILTER (WHERE {bad})", swapped.get(name, f"c_{name}"))
            for name, label, bad in rules
        )

    domains = [
        ("cities", "tier", "tier NOT IN ('Tier1', 'Tier2', 'Tier3')"),
        ("delivery_partners", "vehicle_type", "vehicle_type NOT IN ('Bike', 'Bicycle', 'Scooter')"),
        ("orders", "order_status", "order_status NOT IN ('Placed', 'Delivered', 'Cancelled', 'Returned')"),
        ("deliveries", "delivery_status", "delivery_status NOT IN ('Delivered', 'Delayed', 'Failed', 'Cancelled')"),
        ("payments", "payment_method", "payment_method NOT IN ('UPI', 'Card', 'Wallet', 'COD', 'NetBanking')"),
        ("payments", "payment_status", "payment_status NOT IN ('Success', 'Failed', 'Refunded', 'Pending')"),
    ]
    ranges = [
        ("dark_stores", "store_area_sqft", "store_area_sqft <= 0"), ("products", "unit_price", "unit_price < 0"),
        ("products", "unit_cost", "unit_cost < 0"), ("inventory", "opening_stock", "opening_stock < 0"),
        ("inventory", "closing_stock", "closing_stock < 0"),
        ("promotions", "discount_pct", "discount_pct < 0 OR discount_pct > 100"),
        ("promotions", "end_date", "end_date < start_date"),
        ("delivery_partners", "rating", "rating < 0 OR rating > 5"), ("orders", "total_amount", "total_amount < 0"),
        ("order_items", "quantity", "quantity <= 0"), ("order_items", "unit_price", "unit_price < 0"),
        ("order_items", "line_total", "line_total < 0"), ("payments", "paid_amount", "paid_amount < 0"),
        ("returns", "refund_amount", "refund_amount < 0"),
    ]
    required = {
        "cities": "city_name state tier", "categories": "category_name",
        "dark_stores": "store_name city_id store_area_sqft opened_date is_active",
        "products": "product_name category_id unit_price unit_cost is_active",
        "customers": "full_name email city_id signup_date is_active",
        "promotions": "promo_code discount_pct start_date end_date",
        "delivery_partners": "partner_name city_id joined_date",
        "inventory": "store_id product_id stock_date opening_stock closing_stock reorder_level units_received "
                     "units_sold units_wasted",
        "orders": "customer_id store_id order_datetime order_status total_amount",
        "order_items": "order_id product_id quantity unit_price line_total",
        "deliveries": "order_id partner_id promised_time_mins delivery_status",
        "payments": "order_id payment_method payment_status paid_amount",
        "returns": "order_item_id return_date refund_amount",
    }
    lengths = [
        (name, c, f"length({c}) > {n}") for name, bounds in {
            "cities": "city_name 100 state 100 tier 10", "dark_stores": "store_name 150", "categories": "category_name 100",
            "products": "product_name 200 brand 100", "customers": "full_name 150 email 150 phone 20",
            "promotions": "promo_code 30 description 200", "delivery_partners": "partner_name 150 vehicle_type 30",
            "orders": "order_status 20", "deliveries": "delivery_status 20", "payments": "payment_method 20 payment_status 20",
            "returns": "return_reason 200",
        }.items() for c, n in zip(bounds.split()[::2], bounds.split()[1::2])
    ]
    nulls = [(name, c, f"{c} IS NULL") for name, columns in required.items() for c in columns.split()]
    dirty = {"orders": "c_dirty_orders", "customers": "c_dirty_customers", "inventory": "c_dirty_inventory"}
    refs = {"orders": "c_dirty_refs"}

    unique_keys = [("customers", "email"), ("promotions", "promo_code"), ("inventory", "store_id, product_id, stock_date"),
                   ("deliveries", "order_id"), ("payments", "order_id")]

    def offenders(swapped: dict[str, str], names: list[str]) -> list[tuple[str, str, str, str]]:
        """Table, rule, source and condition of every constraint of some tables."""
        source = {name: swapped.get(name, f"c_{name}") for name in keys}
        found = [
            (name, f"primary key {key}", source[name],
             f"{key} IS NULL OR {key} IN (SELECT {key} FROM {source[name]} GROUP BY {key} HAVING count(*) > 1)")
            for name, key in keys.items()
        ]
        found += [
            (name, f"unique {key}", source[name],
             f"({key}) IN (SELECT ({key}) FROM {source[name]} "
             f"WHERE {' AND '.join(f'{c} IS NOT NULL' for c in key.split(', '))} GROUP BY {key} HAVING count(*) > 1)")
            for name, key in unique_keys
        ]
        found += [
            (child, f"{column} in {parent}", source[child],
             f"{column} IS NOT NULL AND {column} NOT IN (SELECT {key} FROM {source[parent]} WHERE {key} IS NOT NULL)")
            for child, column, parent, key in links
        ]
        for kind, rules in [("domain", domains), ("range", ranges), ("not null", nulls), ("length", lengths)]:
            found += [(name, f"{label} {kind}", source[name], bad) for name, label, bad in rules]
        return [one for one in found if one[0] in names]

    def offending(swapped: dict[str, str], name: str, columns: str, rule: str = "") -> str:
        return " UNION ALL ".join(
            f"SELECT '{label}' AS rule, {columns} FROM {source} WHERE {bad}"
            for _, label, source, bad in offenders(swapped, [name]) if rule in ("", label)
        )

    def summary(swapped: dict[str, str]) -> str:
        return " UNION ALL ".join(
            f"SELECT '{name}' AS table_name, '{label}' AS rule, count(*) AS offending_rows FROM {source} WHERE {bad} HAVING count(*) > 0"
            for name, label, source, bad in offenders(swapped, list(keys))
        )

    every_kind = {
        "orders": "c_dirty_refs", "customers": "(SELECT * FROM c_customers WHERE customer_id % 10 <> 3)",
        "inventory": "c_dirty_inventory", "deliveries": "c_dirty_deliveries", "order_items": "c_repeated_items",
        "returns": "c_repeated_returns",
    }
    return {
        "audit_rows_orders_dirty": offending(
            {"orders": "c_dirty_orders"}, "orders", "order_id, customer_id, order_datetime, order_status"),
        "audit_rows_refs_dirty": offending(refs, "orders", "order_id, customer_id, store_id, promo_id, order_status"),
        "audit_rows_inventory_dirty": offending(dirty, "inventory", "inventory_id, store_id, product_id, stock_date, closing_stock"),
        "audit_rows_customers_dirty": offending(
            {"customers": "c_repeated_customers"}, "customers", "customer_id, city_id, email, is_active"),
        "audit_rows_quarantine": offending(
            refs, "orders", "order_id, customer_id, order_status", "customer_id in customers"),
        "audit_rows_summary": summary({}),
        "audit_rows_summary_dirty": summary(every_kind),
        "audit_pk": primary("c_orders"),
        "audit_pk_dirty": primary("c_dirty_orders"),
        "audit_pk_alerts": _count(
            "primary key store_id, product_id, flagged_at", "low_stock_alerts",
            "count(*) - count(DISTINCT (store_id, product_id))",
            f"(SELECT store_id, product_id FROM ({_LATEST}) WHERE closing_stock <= reorder_level)",
        ),
        "audit_fk": foreign("c_orders"),
        "audit_fk_dirty": foreign("c_dirty_refs"),
        "audit_unique": unique("c_customers", "c_inventory"),
        "audit_unique_dirty": unique("c_dirty_customers", "c_dirty_inventory"),
        "audit_domain": listed(domains, {}, "domain"),
        "audit_domain_dirty": listed(domains, refs, "domain"),
        "audit_range": listed(ranges, {}, "range"),
        "audit_range_dirty": listed(ranges, refs, "range"),
        "audit_length": listed(lengths, {}, "length"),
        "audit_length_dirty": listed(lengths, {"customers": "c_long_customers"}, "length"),
        "audit_not_null": listed(nulls, {}, "not null"),
        "audit_not_null_dirty": listed(nulls, dirty, "not null"),
        "audit_stock_balance": _count("stock balance", "inventory", "count(*)", """c_inventory
WHERE closing_stock <> greatest(opening_stock + units_received - units_sold - units_wasted, 0)"""),
        "audit_stock_balance_dirty": _count("stock balance", "inventory", "count(*)", """c_dirty_inventory
WHERE closing_stock <> greatest(opening_stock + units_received - units_sold - units_wasted, 0)"""),
        "audit_stock_continuity": _count("stock continuity", "inventory", "count(*)", """
(SELECT opening_stock, lag(closing_stock) OVER (PARTITION BY store_id, product_id ORDER BY stock_date) AS before
 FROM c_inventory) WHERE opening_stock <> before"""),
        "audit_line_total": _count(
            "line total", "order_items", "count(*)", "c_order_items WHERE abs(line_total - quantity * unit_price) > 0.005"
        ),
        "audit_order_total": _count("order total", "orders", "count(*)", """c_orders AS o
LEFT JOIN (SELECT order_id, sum(line_total) AS lines FROM c_order_items GROUP BY order_id) USING (order_id)
LEFT JOIN c_promotions AS p ON p.promo_id = o.promo_id
WHERE abs(CAST(total_amount * 100 AS HUGEINT) * 10000
          - CAST(coalesce(lines, 0) * 100 AS HUGEINT) * (10000 - CAST(coalesce(discount_pct, 0) * 100 AS HUGEINT))) > 5000"""),
        "audit_delivery_status": _count("delivery status", "deliveries", "count(*)", """
c_deliveries JOIN c_orders USING (order_id)
WHERE NOT ((order_status = 'Delivered' AND (delivery_status = 'Delivered') = (actual_time_mins <= promised_time_mins + 5)
            AND delivery_status IN ('Delivered', 'Delayed'))
        OR (order_status = 'Returned' AND delivery_status = 'Delayed')
        OR (order_status = 'Cancelled' AND delivery_status = 'Cancelled' AND actual_time_mins IS NULL))"""),
        "audit_delivery_clock": _count("delivery clock", "deliveries", "count(*)", """c_deliveries
WHERE delivered_at IS DISTINCT FROM dispatched_at + to_minutes(actual_time_mins)"""),
        "audit_payment": _count("payment", "payments", "count(*)", """c_payments JOIN c_orders USING (order_id)
WHERE (payment_status = 'Success') <> (order_status <> 'Cancelled')
   OR paid_amount <> CASE WHEN payment_status = 'Success' THEN total_amount ELSE 0 END"""),
        "audit_geography": _count("one city per order", "orders", "count(*)", """c_orders AS o
JOIN c_dark_stores AS s ON s.store_id = o.store_id JOIN c_customers AS c ON c.customer_id = o.customer_id
LEFT JOIN c_deliveries AS d ON d.order_id = o.order_id
LEFT JOIN c_delivery_partners AS p ON p.partner_id = d.partner_id
WHERE s.city_id <> c.city_id OR p.city_id <> c.city_id"""),
        "audit_returns": _count("returns", "returns", "count(*)", """c_returns AS r
JOIN c_order_items AS i ON i.order_item_id = r.order_item_id JOIN c_orders AS o ON o.order_id = i.order_id
WHERE order_status <> 'Returned' OR refund_amount <> line_total
   OR date_diff('day', CAST(order_datetime AS DATE), return_date) NOT BETWEEN 1 AND 5"""),
        "audit_promo_window": _count("promo window", "orders", "count(*)", """
c_orders AS o JOIN c_promotions AS p ON p.promo_id = o.promo_id
WHERE CAST(order_datetime AS DATE) NOT BETWEEN start_date AND end_date"""),
    }


def _dirty() -> dict[str, str]:
    """The same questions where orders are delivered more than once, or customers are missing."""
    plain = {**_views(), **_dashboards(), **_delivery(), **_inventory()}
    shelves = ["inventory_wastage_rank", "inventory_demand_tiers"]
    again = ["dash_store_scorecard", "dash_store_matrix_by_city", "delivery_peak_hour"]
    once = {f"{name}_dirty": plain[name].replace("c_deliveries", "c_dirty_deliveries") for name in again}
    audits = _audits()
    broken = {"audit_delivery_status": "deliveries", "audit_delivery_clock": "deliveries", "audit_payment": "payments",
              "audit_returns": "returns"}
    return {
        **once,
        **{f"{name}_all_products": plain[name].replace("c_inventory", "c_all_products_stock") for name in shelves},
        **{f"{name}_lasting": plain[name] for name in ["view_store_daily_performance", "view_product_inventory_health"]},
        **{f"{name}_dirty": audits[name].replace(f"c_{table}", f"c_broken_{table}") for name, table in broken.items()},
        "view_store_daily_performance_dirty": f"""
WITH delays AS (SELECT store_id, CAST(order_datetime AS DATE) AS order_date, {_ratio(f"sum({_DELAY})", f"count({_DELAY})")} AS avg_delay_mins
                FROM c_dirty_deliveries JOIN c_orders USING (order_id) WHERE {_DONE} GROUP BY ALL)
SELECT store_id, store_name, city_name, order_date, total_orders, total_revenue, cancelled_orders, avg_delay_mins
FROM (SELECT store_id, CAST(order_datetime AS DATE) AS order_date, count(DISTINCT order_id) AS total_orders,
             CAST(sum(total_amount) FILTER (WHERE order_status = 'Delivered') AS DOUBLE) AS total_revenue,
             count(*) FILTER (WHERE order_status = 'Cancelled') AS cancelled_orders FROM c_orders GROUP BY ALL)
JOIN c_dark_stores USING (store_id) JOIN c_cities USING (city_id) LEFT JOIN delays USING (store_id, order_date)""",
        "sample_preview_orphans": plain["sample_preview"].replace(
            "c_customers AS c", "(SELECT * FROM c_customers WHERE customer_id % 10 <> 3) AS c"
        ),
    }


def _repeated() -> dict[str, str]:
    """Questions that count distinct ids, where ids repeat."""
    plain = {**_kpi(), **_sales(), **_delivery(), **_customer(), **_views()}
    orders = ["kpi_revenue_by_city", "kpi_orders_by_place", "sales_weekday_weekend", "sales_promo_effectiveness",
              "delivery_peak_hour", "view_store_daily_performance", "mv_monthly_city_revenue"]
    returns = plain["kpi_return_rate"]
    for name in ["orders", "order_items", "returns"]:
        returns = returns.replace(f"c_{name}", f"c_repeated_{name.removeprefix('order_')}")
    return {
        **{f"{name}_repeated_orders": plain[name].replace("c_orders", "c_repeated_orders") for name in orders},
        "kpi_return_rate_repeated_items": returns,
        "customer_city_engagement_repeated_customers": plain["customer_city_engagement"].replace(
            "c_customers", "c_repeated_customers"
        ),
    }


def _sources() -> dict[str, str]:
    return {
        "source_csv_deliveries": "SELECT * FROM c_deliveries",
        "source_csv_reordered": """
SELECT * EXCLUDE (unit_price, unit_cost) REPLACE (CAST(shelf_life_days AS INTEGER) AS shelf_life_days), CAST(unit_price AS DOUBLE) AS unit_price,
       CAST(unit_cost AS DOUBLE) AS unit_cost FROM c_products""",
        "source_csv_inferred": """
SELECT order_id AS number, CAST(total_amount AS DOUBLE) AS amount, order_status AS word, order_id % 2 = 0 AS even,
       CASE WHEN order_id = 1 THEN 0.5 ELSE CAST(order_id AS DOUBLE) END AS nearly_whole,
       CASE WHEN order_id = 1 THEN 'none' ELSE CAST(order_id AS VARCHAR) END AS nearly_number,
       CASE WHEN order_id % 3 <> 0 THEN order_id END AS some_missing, CAST(NULL AS VARCHAR) AS all_missing
FROM c_orders""",
        "source_parquet_inventory": "SELECT * FROM c_inventory",
        "source_clean_folder": """
SELECT order_id, customer_id, store_id, promo_id, order_datetime, order_status,
       CASE WHEN order_id % 11 <> 0 THEN CAST(total_amount AS DOUBLE) END AS total_amount
FROM c_orders WHERE order_id % 13 <> 0""",
        "clean_rejects": "SELECT order_id, 'total_amount: a lot' AS reason FROM c_orders WHERE order_id % 13 = 0",
        "clean_folder_report": """
SELECT 'orders' AS table_name, count(*) + count(*) FILTER (WHERE order_id % 10 = 0) AS rows_in,
       count(*) FILTER (WHERE order_id % 10 = 0) AS duplicates_removed,
       count(*) FILTER (WHERE order_id % 13 = 0) AS rows_rejected, CAST(0 AS BIGINT) AS rows_dropped_missing_required,
       count(*) FILTER (WHERE order_id % 13 <> 0) AS rows_out FROM c_orders
UNION ALL
SELECT 'cities', count(*), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), count(*) FROM c_cities""",
    }


def oracle_sql() -> dict[str, str]:
    bodies = {
        **_kpi(), **_sales(), **_delivery(), **_customer(), **_inventory(), **_views(), **_dashboards(), **_cleaning(),
        **_audits(), **_dirty(), **_repeated(), **_sources(),
    }
    return {name: with_tables(body) for name, body in bodies.items()}
