"""Measures in filter contexts."""

import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_operators import CITIES, STORES, order, snapshot, tables

from shelfwise.operators import dashboard
from shelfwise.operators.measures import measures, states


def delivery(order_id, minutes, promised=10):
    return dict(delivery_id=order_id, order_id=order_id, promised_time_mins=promised, actual_time_mins=minutes)


@pytest.fixture
def shop(spark):
    """City A has stores 1 and 2, city B store 3; March has no orders."""
    return tables(spark, cities=CITIES, dark_stores=STORES, orders=[
        order(1, store_id=1, when="2024-01-05 10:00:00", total="100.00"), order(2, store_id=2, when="2024-01-06 10:00:00", total="50.00"),
        order(3, store_id=1, when="2024-02-05 10:00:00", total="30.00", status="Cancelled"),
        order(4, store_id=3, when="2024-02-05 10:00:00", total="20.00"), order(5, store_id=3, when="2024-04-05 10:00:00", total="10.00"),
        order(6, store_id=9, when="2024-04-05 10:00:00", total="1.00")],
        deliveries=[delivery(1, 10), delivery(2, 11), delivery(4, None), delivery(77, 1)],
        inventory=[{**snapshot(1, 1, "2024-01-07"), "opening_stock": 6, "units_received": 4, "units_sold": 5}])


def test_every_context_has_its_own_fractions(spark, shop):
    found = {(r["context"], r["city_id"], r["store_id"], r["order_month"]): r
             for r in measures(shop, [[], ["city_id"], ["store_id"], ["month"], ["city_id", "month"]]).collect()}
    whole = found["all", None, None, None]
    assert whole["total_revenue"] == 211.0 and whole["sla"] == 2 / 4 and whole["fill_rate"] == 0.5 and whole["cancellation_rate"] == 1 / 6
    assert whole["mom_growth"] == (211 - 200) / 200  # April's successor is beyond the calendar
    city = found["city", 1, None, None]
    assert (city["total_revenue"], city["sla"], city["cancellation_rate"]) == (180.0, 0.5, 1 / 3)
    assert found["city", 2, None, None]["fill_rate"] is None and found["city", None, None, None]["total_revenue"] == 1.0
    assert found["store", None, 9, None]["total_revenue"] == 1.0
    assert found["month", None, None, "2024-01"]["mom_growth"] is None
    assert found["month", None, None, "2024-02"]["mom_growth"] == (50 - 150) / 150
    assert found["month", None, None, "2024-03"]["mom_growth"] == -1.0 and found["month", None, None, "2024-03"]["total_revenue"] is None
    assert found["city month", 1, None, "2024-02"]["mom_growth"] == (30 - 150) / 150
    assert found["city month", 2, None, "2024-02"]["mom_growth"] is None
    assert ("month", None, None, "2024-05") not in found


def test_a_filter_does_not_hide_the_month_before(spark, shop):
    found = measures(shop, [[], ["month"]], keep=F.col("month") == dt.date(2024, 2, 1))
    assert rows(found.select("context", "total_revenue", "mom_growth")) == [("all", 50.0, (50 - 150) / 150), ("month", 50.0, (50 - 150) / 150)]


def test_totals_agree_with_the_single_measures(spark, shop):
    whole = measures(shop, [[]]).first()
    assert whole["total_revenue"] == dashboard.total_revenue(shop).first()[0]
    assert whole["sla"] == dashboard.sla(shop).first()[0] and whole["fill_rate"] == dashboard.fill_rate(shop).first()[0]
    assert whole["cancellation_rate"] == dashboard.cancellation_rate(shop).first()[0]


def test_states_not_facts_are_expanded(spark, shop):
    plan = measures(shop, [[], ["city_id"]])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Expand") == 1 and plan.index("Expand") < plan.index("Union")
    assert states(shop).count() == 10
    with pytest.raises(ValueError, match="no dimension weather"):
        measures(shop, [["weather"]])
