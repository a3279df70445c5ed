"""Business questions on small hand-made tables."""

import datetime as dt
from decimal import Decimal

import pytest
from conftest import rows
from pyspark.sql import Row

from shelfwise.operators import customer, dashboard, delivery, inventory, kpi, sales
from shelfwise.operators.common import left_lookup
from shelfwise.plans import views
from shelfwise.schemas import SCHEMAS
from shelfwise.sources.tables import Tables


def table(spark, name, data):
    """Rows given as dicts with the columns that matter; the rest is missing."""
    schema = SCHEMAS[name]
    return spark.createDataFrame([tuple(d.get(c) for c in schema.fieldNames()) for d in data], schema)


def tables(spark, **data):
    return Tables.of(**{name: table(spark, name, data.get(name, [])) for name in SCHEMAS})


def at(text):
    return dt.datetime.fromisoformat(text)


def order(order_id, customer_id=1, store_id=1, when="2024-01-05 10:00:00", status="Delivered", total="10.00", promo_id=None):
    return dict(
        order_id=order_id, customer_id=customer_id, store_id=store_id, promo_id=promo_id, order_datetime=at(when),
        order_status=status, total_amount=Decimal(total),
    )


STORES = [dict(store_id=1, store_name="S1", city_id=1), dict(store_id=2, store_name="S2", city_id=1),
          dict(store_id=3, store_name="S3", city_id=2)]
CITIES = [dict(city_id=1, city_name="A", state="X", tier="Tier1"), dict(city_id=2, city_name="B", state="Y", tier="Tier2")]


def trips(store_id, minutes, first=0, promised=10):
    """One order and one delivery per number of minutes."""
    orders = [order(first + i, store_id=store_id) for i in range(len(minutes))]
    deliveries = [
        dict(delivery_id=first + i, order_id=first + i, partner_id=1, promised_time_mins=promised, actual_time_mins=m,
             delivery_status="Delivered")
        for i, m in enumerate(minutes)
    ]
    return orders, deliveries


def test_ntile_percentiles_need_enough_trips(spark):
    """40 trips reach neither tile 50 nor 90, 60 only tile 50, 200 both."""
    sizes = {1: 40, 2: 60, 3: 200}
    orders, deliveries = [], []
    for store, n in sizes.items():
        o, d = trips(store, list(range(1, n + 1)), first=1000 * store)
        orders += o
        deliveries += d
    t = tables(spark, orders=orders, deliveries=deliveries, dark_stores=STORES)
    got = rows(delivery.percentiles_ntile(t).select("store_id", "approx_p50_mins", "approx_p90_mins"))
    assert got == [(1, None, None), (2, 50, None), (3, 100, 180)]


def test_ntile_percentiles_ignore_unknown_times(spark):
    # 100 rows, 49 known: tile 50 holds only an unknown time.
    orders, deliveries = trips(1, list(range(1, 50)) + [None] * 51)
    t = tables(spark, orders=orders, deliveries=deliveries, dark_stores=STORES)
    assert rows(delivery.percentiles_ntile(t).select("approx_p50_mins")) == [(None,)]


@pytest.mark.parametrize("minutes, p50, p90", [([5], 5.0, 5.0), ([4, 9], 6.5, 8.5), ([1, 2, 3, 4], 2.5, 3.7),
                                                ([7] * 10 + [30], 7.0, 7.0), ([None, 3], 3.0, 3.0)])
def test_exact_percentiles(spark, minutes, p50, p90):
    orders, deliveries = trips(1, minutes)
    t = tables(spark, orders=orders, deliveries=deliveries, dark_stores=STORES)
    assert rows(delivery.percentiles_exact(t).select("p50_delivery_mins", "p90_delivery_mins")) == [(p50, p90)]


def test_bottleneck_weighs_stores_by_deliveries(spark):
    o1, d1 = trips(1, [20], first=0)          # delay 10
    o2, d2 = trips(2, [12] * 9, first=100)    # delay 2 each; the city's average is 2.8
    o3, d3 = trips(3, [50], first=200)        # alone in its city, so never above average
    t = tables(spark, orders=o1 + o2 + o3, deliveries=d1 + d2 + d3, dark_stores=STORES)
    assert rows(delivery.bottleneck_stores(t)) == [(1, "S1", 1, 10.0)]


def test_negative_delay_rounds_away_from_zero(spark):
    orders, deliveries = trips(1, [9] + [10] * 7)  # mean -1/8
    t = tables(spark, orders=orders, deliveries=deliveries, dark_stores=STORES, cities=CITIES)
    assert rows(delivery.delay_by_city(t)) == [("A", 8, -0.13)]


def test_partners_below_the_minimum_are_not_ranked(spark):
    deliveries = [
        dict(delivery_id=p * 100 + i, order_id=p * 100 + i, partner_id=p, promised_time_mins=10,
             actual_time_mins=10 if i < good else 20, delivery_status="Delayed")
        for p, n, good in [(1, 20, 10), (2, 40, 20), (3, 19, 19), (4, 20, 0)]
        for i in range(n)
    ]
    partners = [dict(partner_id=p, partner_name=f"P{p}") for p in range(1, 5)]
    t = tables(spark, deliveries=deliveries, delivery_partners=partners)
    got = rows(delivery.partner_scorecard(t).select("partner_id", "on_time_pct", "on_time_rank"))
    assert got == [(1, 50.0, 1), (2, 50.0, 1), (4, 0.0, 3)]


def test_a_day_of_cancellations_has_no_revenue(spark):
    t = tables(
        spark, dark_stores=STORES, cities=CITIES,
        orders=[order(1, status="Cancelled"), order(2, when="2024-01-06 09:00:00")],
        deliveries=[dict(delivery_id=1, order_id=1, promised_time_mins=10, delivery_status="Cancelled")],
    )
    got = rows(
        views.store_daily_performance(t).select("order_date", "total_orders", "total_revenue", "cancelled_orders", "avg_delay_mins")
    )
    assert got == [(dt.date(2024, 1, 5), 1, None, 1, None), (dt.date(2024, 1, 6), 1, 10.0, 0, None)]


def test_growth_over_a_missing_month(spark):
    orders = [order(1, when="2024-01-31 23:59:59", total="10.00"), order(2, when="2024-03-01 00:00:00", total="15.00")]
    t = tables(spark, orders=orders)
    assert rows(sales.monthly_mom(t)) == [("2024-01", 10.0, None, None), ("2024-03", 15.0, 10.0, 50.0)]
    assert rows(dashboard.mom_growth(t)) == [("2024-01", 10.0, None, None), ("2024-03", 15.0, None, None)]


def test_growth_after_a_month_without_revenue_is_null(spark):
    orders = [order(1, when="2024-01-05 00:00:00", total="0.00"), order(2, when="2024-02-05 00:00:00")]
    t = tables(spark, orders=orders)
    assert rows(sales.monthly_mom(t).select("mom_growth_pct")) == [(None,), (None,)]


def test_weekend_edges(spark):
    days = ["2024-01-05 23:59:59", "2024-01-06 00:00:00", "2024-01-07 23:59:59", "2024-01-08 00:00:00"]  # Fri..Mon
    t = tables(spark, orders=[order(i, when=d) for i, d in enumerate(days)])
    assert rows(sales.weekday_weekend(t)) == [("Weekday", 2, 20.0, 10.0), ("Weekend", 2, 20.0, 10.0)]


def test_promotions(spark):
    t = tables(
        spark, promotions=[dict(promo_id=1, promo_code="P1"), dict(promo_id=2, promo_code="P2")],
        orders=[order(1, promo_id=1, total="0.01"), order(2, promo_id=1, total="0.02"), order(3),
                order(4, promo_id=2, status="Cancelled")],
    )
    assert rows(sales.promo_effectiveness(t)) == [("No Promotion", 1, 10.0, 10.0), ("P1", 2, 0.02, 0.03)]


def items(*lines):
    return [
        dict(order_item_id=i, order_id=o, product_id=p, quantity=q, unit_price=Decimal("1.00"), line_total=Decimal(q))
        for i, (o, p, q) in enumerate(lines)
    ]


PRODUCTS = [dict(product_id=p, product_name=f"N{p}", category_id=10 + p % 3, unit_price=Decimal("2.50"),
                 unit_cost=Decimal("1.25"), shelf_life_days=3) for p in range(1, 7)]
CATEGORIES = [dict(category_id=c, category_name=f"C{c}", parent_category_id=1) for c in (10, 11, 12)]


def test_best_seller_tie_goes_to_the_lower_product(spark):
    t = tables(
        spark, dark_stores=STORES, products=PRODUCTS, orders=[order(1), order(2, store_id=2), order(3, status="Returned")],
        order_items=items((1, 5, 3), (1, 2, 3), (1, 4, 1), (2, 6, 1), (3, 1, 99)),
    )
    assert rows(sales.best_seller_per_store(t)) == [(1, "S1", 2, "N2", 3), (2, "S2", 6, "N6", 1)]


def test_equal_categories_share_rank_and_running_share(spark):
    t = tables(
        spark, products=PRODUCTS, categories=CATEGORIES, orders=[order(1)],
        order_items=items((1, 1, 4), (1, 2, 4), (1, 3, 2)),
    )
    assert rows(sales.category_share(t)) == [("C10", 2.0, 3, 100.0), ("C11", 4.0, 1, 80.0), ("C12", 4.0, 1, 80.0)]


def test_return_rate_counts_items_once(spark):
    t = tables(
        spark, orders=[order(1), order(2, status="Returned"), order(3, status="Cancelled")],
        order_items=items((1, 1, 1), (2, 1, 1), (2, 2, 1), (3, 1, 1)),
        returns=[dict(return_id=1, order_item_id=1), dict(return_id=2, order_item_id=1), dict(return_id=3, order_item_id=3)],
    )
    assert rows(kpi.return_rate(t)) == [(3, 2, 66.67)]


def test_return_rate_without_items(spark):
    assert rows(kpi.return_rate(tables(spark))) == [(0, 0, None)]


def snapshot(store_id, product_id, day, opening=0, received=0, sold=0, wasted=0, closing=0, reorder=20):
    return dict(
        store_id=store_id, product_id=product_id, stock_date=dt.date.fromisoformat(day), opening_stock=opening,
        units_received=received, units_sold=sold, units_wasted=wasted, closing_stock=closing, reorder_level=reorder,
    )


def test_latest_snapshot_decides_on_reordering(spark):
    t = tables(
        spark, dark_stores=STORES, products=PRODUCTS,
        inventory=[snapshot(1, 1, "2024-01-01", closing=5), snapshot(1, 1, "2024-01-08", closing=21),
                   snapshot(2, 1, "2024-01-01", closing=50), snapshot(2, 1, "2024-01-08", closing=20)],
    )
    assert rows(inventory.stockout_risk(t)) == [(2, "S2", 1, "N1", 20, 20, dt.date(2024, 1, 8))]
    health = views.product_inventory_health(t).select("store_id", "needs_reorder")
    assert rows(health) == [(1, False), (2, True)]


def test_lookup_of_missing_ids(spark):
    left = spark.createDataFrame([(1, 7), (2, None), (3, 8)], "id bigint, k bigint")
    right = spark.createDataFrame([(7, "seven"), (-3, "what a made-up key of row 2 would find")], "k bigint, name string")
    assert rows(left_lookup(left, right, "k", spread="id").select("id", "k", "name")) == [
        (1, 7, "seven"), (2, None, None), (3, 8, None)]


def test_zero_denominators_are_null(spark):
    t = tables(spark, dark_stores=STORES, inventory=[snapshot(1, 1, "2024-01-01")])
    assert rows(kpi.fill_rate(t)) == [(1, "S1", 0, 0, None)]
    assert rows(kpi.inventory_turnover(t)) == [(1, 0, 0.0, None)]
    assert rows(dashboard.sla(t)) == [(None,)]


def test_lost_revenue_needs_days_with_and_without_stock(spark):
    t = tables(
        spark, products=PRODUCTS,
        inventory=[snapshot(1, 1, "2024-01-01", sold=3, closing=5), snapshot(1, 1, "2024-01-08", sold=4, closing=1),
                   snapshot(1, 1, "2024-01-15", sold=9, closing=0), snapshot(1, 2, "2024-01-01", sold=9, closing=0),
                   snapshot(1, 3, "2024-01-01", sold=9, closing=1)],
    )
    assert rows(kpi.revenue_lost_stockouts(t)) == [(1, 1, "N1", 1, 3.5, 8.75)]


def test_series_windows(spark):
    days = ["2024-01-01", "2024-01-08", "2024-01-15", "2024-01-22", "2024-01-29"]
    t = tables(spark, inventory=[snapshot(1, 1, d, sold=i, received=1, closing=10 - i) for i, d in enumerate(days)])
    assert rows(inventory.rolling_avg(t).select("units_sold", "rolling_4period_avg_sold")) == [
        (0, 0.0), (1, 0.5), (2, 1.0), (3, 1.5), (4, 2.5)]
    moved = rows(inventory.stock_movement(t, sort=True).select("closing_stock", "prev_closing_stock", "next_closing_stock", "stock_change"))
    assert moved == [(6, 7, None, -1), (7, 8, 6, -1), (8, 9, 7, -1), (9, 10, 8, -1), (10, None, 9, None)]
    assert rows(inventory.running_received(t).select("running_total_received")) == [(i,) for i in range(1, 6)]


def test_wastage(spark):
    t = tables(
        spark, products=PRODUCTS, categories=CATEGORIES,
        inventory=[snapshot(1, p, "2024-01-01", wasted=w) for p, w in [(1, 2), (2, 0), (4, 2), (3, 1)]],
    )
    assert rows(inventory.wastage_top(t).select("product_id", "wastage_cost")) == [(1, 2.5), (3, 1.25), (4, 2.5)]
    assert rows(inventory.wastage_rank(t)) == [("C10", "N3", 1, 1), ("C11", "N1", 2, 1), ("C11", "N4", 2, 1), ("C12", "N2", 0, 1)]


def test_demand_tiers_with_fewer_products_than_quartiles(spark):
    t = tables(spark, products=PRODUCTS, inventory=[snapshot(1, p, "2024-01-01", sold=s) for p, s in [(1, 5), (2, 5), (3, 9)]])
    got = rows(inventory.demand_tiers(t).select("product_id", "sales_percentile", "demand_quartile"))
    assert got == [(1, 0.0, 1), (2, 0.0, 2), (3, 1.0, 3)]


def test_category_tree_of_three_levels(spark):
    t = tables(spark, categories=[
        dict(category_id=1, category_name="Food"), dict(category_id=2, category_name="Fruit", parent_category_id=1),
        dict(category_id=3, category_name="Apples", parent_category_id=2), dict(category_id=4, category_name="Home"),
        # A cycle has no root, so it is not part of the tree.
        dict(category_id=5, category_name="X", parent_category_id=6), dict(category_id=6, category_name="Y", parent_category_id=5),
    ])
    assert rows(inventory.category_tree(t)) == [
        (1, "Food", 0, "Food"), (2, "Fruit", 1, "Food > Fruit"), (3, "Apples", 2, "Food > Fruit > Apples"), (4, "Home", 0, "Home")]


def test_category_tree_without_categories(spark):
    assert rows(inventory.category_tree(tables(spark))) == []


def test_customers_without_orders_still_count(spark):
    people = [dict(customer_id=i, full_name=f"F{i}", city_id=1, is_active=a) for i, a in [(1, True), (2, False), (3, None)]]
    t = tables(spark, customers=people, cities=CITIES, orders=[order(1), order(2), order(3, customer_id=2, status="Cancelled")])
    assert rows(customer.city_engagement(t)) == [("A", 3, 1, 0.67)]


def test_new_customers_are_orders_of_the_first_month(spark):
    t = tables(spark, orders=[order(1), order(2, when="2024-01-20 08:00:00"), order(3, when="2024-02-01 08:00:00"),
                              order(4, customer_id=2, when="2024-02-01 08:00:00"),
                              order(5, customer_id=2, when="2023-01-01 08:00:00", status="Cancelled")])
    assert rows(customer.new_vs_returning(t)) == [("2024-01", 2, 0), ("2024-02", 1, 1)]


def test_segments(spark):
    sizes = {1: 1, 2: 2, 3: 4, 4: 5, 5: 9, 6: 10}
    orders = [order(c * 100 + i, customer_id=c) for c, n in sizes.items() for i in range(n)]
    got = rows(customer.frequency_segments(tables(spark, orders=orders)))
    assert got == [("Loyal", 1, 100.0), ("Occasional", 2, 30.0), ("One-time", 1, 10.0), ("Regular", 2, 70.0)]
    assert rows(kpi.repeat_customer_rate(tables(spark, orders=orders))) == [(6, 5, 83.33)]


def test_rfm_with_fewer_customers_than_quartiles(spark):
    people = [dict(customer_id=i, full_name=f"F{i}") for i in (1, 2, 3)]
    t = tables(spark, customers=people, orders=[
        order(1, customer_id=1, total="30.00"), order(2, customer_id=2, when="2024-02-01 00:00:00", total="20.00"),
        order(3, customer_id=3, total="5.00"), order(4, customer_id=3, total="5.00")])
    got = rows(customer.rfm(t).select("customer_id", "recency_quartile", "frequency_quartile", "monetary_quartile"))
    assert got == [(1, 2, 2, 1), (2, 1, 3, 2), (3, 3, 1, 3)]


def test_order_gaps(spark):
    t = tables(spark, orders=[order(1, when="2024-01-01 00:00:00"), order(3, when="2024-01-02 12:00:00"),
                              order(2, when="2024-01-02 12:00:00"), order(4, customer_id=2),
                              order(5, when="2024-03-02 12:00:00")])
    got = rows(customer.order_gaps(t).select("order_id", "days_since_prev_order"))
    assert got == [(1, None), (2, 1.5), (3, 0.0), (4, None), (5, 60.0)]


def test_top_five_percent_includes_ties(spark):
    orders = [order(i, customer_id=i, total=f"{min(i, 98)}.00") for i in range(1, 102)]
    people = [dict(customer_id=i, full_name=f"F{i}") for i in range(1, 102)]
    got = rows(customer.high_value(tables(spark, orders=orders, customers=people)).select("customer_id", "spend_percentile"))
    assert got == [(96, 0.95), (97, 0.96), (98, 0.97), (99, 0.97), (100, 0.97), (101, 0.97)]


def test_no_top_customer_when_there_is_one(spark):
    t = tables(spark, orders=[order(1)], customers=[dict(customer_id=1, full_name="F")])
    assert rows(customer.high_value(t)) == []


def test_store_without_activity_is_on_the_scorecard(spark):
    orders, deliveries = trips(1, [10, 11])
    t = tables(spark, dark_stores=STORES, cities=CITIES, orders=orders + [order(99, store_id=2, status="Cancelled")],
               deliveries=deliveries, inventory=[snapshot(1, 1, "2024-01-01", opening=8, sold=2)])
    got = rows(dashboard.store_scorecard(t))
    assert got == [(1, "S1", 20.0, 25.0, 50.0, 0.0), (2, "S2", None, None, None, 100.0), (3, "S3", None, None, None, None)]
    assert rows(dashboard.store_matrix_by_city(t).select("city_name", "store_id")) == [("A", 1), ("A", 2), ("B", 3)]


def test_repeated_deliveries_repeat_no_order(spark):
    orders, deliveries = trips(1, [10, 11])
    once = tables(spark, dark_stores=STORES, cities=CITIES, orders=orders, deliveries=deliveries)
    twice = tables(spark, dark_stores=STORES, cities=CITIES, orders=orders, deliveries=deliveries * 2)
    for question in (dashboard.store_scorecard, dashboard.store_matrix_by_city, views.store_daily_performance, delivery.peak_hour):
        assert rows(question(once)) == rows(question(twice))


def test_exec_row(spark):
    orders, deliveries = trips(1, [10, None])
    t = tables(spark, orders=orders, deliveries=deliveries, inventory=[snapshot(1, 1, "2024-01-01", opening=8, sold=2)])
    assert rows(dashboard.exec_kpis(t)) == [(20.0, 2, 10.0, 0.5, 0.25)]


def test_date_table_has_no_gaps(spark):
    t = tables(spark, orders=[order(1, when="2024-02-28 10:00:00")], inventory=[snapshot(1, 1, "2024-03-01")])
    assert rows(dashboard.dim_date(t)) == [
        (dt.date(2024, 2, 28), "2024-02"), (dt.date(2024, 2, 29), "2024-02"), (dt.date(2024, 3, 1), "2024-03")]


def test_preview_is_full_although_some_orders_have_no_customer(spark):
    t = tables(spark, orders=[order(i, customer_id=i % 3) for i in range(120)], dark_stores=STORES,
               customers=[dict(customer_id=i, full_name="F", city_id=9) for i in (0, 1)])
    assert [r["order_id"] for r in dashboard.sample_preview(t).collect()] == [i for i in range(75) if i % 3 < 2]


def test_preview_has_the_customers_city(spark):
    t = tables(spark, orders=[order(i) for i in range(60)], dark_stores=STORES,
               customers=[dict(customer_id=1, full_name="F", city_id=9)])
    got = dashboard.sample_preview(t).collect()
    assert len(got) == 50 and got[0] == Row(
        order_id=0, customer_id=1, store_id=1, promo_id=None, order_datetime=at("2024-01-05 10:00:00"),
        order_status="Delivered", total_amount=10.0, full_name="F", city_id=9, store_name="S1")
