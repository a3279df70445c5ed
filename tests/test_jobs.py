"""The refresh and the alerts."""

from decimal import Decimal

from conftest import rows
from test_operators import CITIES, PRODUCTS, STORES, order, snapshot, tables

from shelfwise.plans import jobs, views
from shelfwise.schemas import SCHEMAS


def shop(spark, *more):
    return tables(spark, cities=CITIES, dark_stores=STORES, orders=[
        order(1, when="2024-01-31 23:59:59"), order(2, store_id=2, when="2024-02-01 00:00:00", total="0.01"),
        order(3, store_id=3, when="2024-02-29 12:00:00", total="2.00"), *more])


def test_refresh_moves_the_view_and_keeps_the_old_version(spark, tmp_path):
    first = jobs.refresh_monthly_city_revenue(spark, shop(spark), str(tmp_path))
    old = rows(spark.read.parquet(first))
    ten, cent, two = Decimal("10.00"), Decimal("0.01"), Decimal("2.00")
    assert old == [(1, "A", "2024-01", 1, ten, ten), (1, "A", "2024-02", 1, cent, cent), (2, "B", "2024-02", 1, two, two)]
    jobs.refresh_monthly_city_revenue(spark, shop(spark, order(4, when="2024-02-02 00:00:00")), str(tmp_path))
    assert (1, "A", "2024-02", 2, Decimal("10.01"), Decimal("5.01")) in rows(spark.table("monthly_city_revenue"))
    assert rows(spark.read.parquet(first)) == old


def test_refresh_of_some_months_touches_only_those(spark, tmp_path):
    first = jobs.refresh_monthly_city_revenue(spark, shop(spark), str(tmp_path))
    changed = shop(spark, order(4, when="2024-01-01 00:00:00"), order(5, when="2024-02-01 00:00:00"))
    path = jobs.refresh_monthly_city_revenue(spark, changed, str(tmp_path), months=["2024-02"], previous=first)
    got = {r[:3]: r[3] for r in rows(spark.read.parquet(path))}
    assert got == {(1, "A", "2024-01"): 1, (1, "A", "2024-02"): 2, (2, "B", "2024-02"): 1}


def test_months_are_ranges_of_the_stored_time(spark):
    all_months = views.monthly_city_revenue(shop(spark))
    for month in ["2024-01", "2024-02", "2024-03"]:
        only = views.monthly_city_revenue(shop(spark), [month])
        assert rows(only) == rows(all_months.filter(all_months.order_month == month))
    assert rows(views.monthly_city_revenue(shop(spark), [])) == []


def test_alerts_are_appended(spark, tmp_path):
    t = tables(spark, dark_stores=STORES, products=PRODUCTS, inventory=[
        snapshot(1, 1, "2024-01-01", closing=20), snapshot(1, 2, "2024-01-01", closing=21), snapshot(2, 1, "2024-01-01")])
    for runs in (1, 2):
        path = jobs.flag_low_stock(t, str(tmp_path))
        alerts = jobs.read_alerts(spark, path)
        assert alerts.schema == SCHEMAS["low_stock_alerts"]
        assert rows(alerts.select("store_id", "product_id", "closing_stock")) == [(1, 1, 20)] * runs + [(2, 1, 0)] * runs
        assert alerts.select("flagged_at").distinct().count() == runs


def test_views_can_be_queried(spark):
    t = tables(spark, dark_stores=STORES, cities=CITIES, products=PRODUCTS, orders=[order(1)],
               inventory=[snapshot(1, 1, "2024-01-01")])
    views.register(t)
    assert spark.sql("SELECT sum(total_orders) FROM store_daily_performance").first()[0] == 1
    assert spark.sql("SELECT count(*) FROM product_inventory_health WHERE needs_reorder").first()[0] == 1
