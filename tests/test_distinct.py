"""Exact distinct counts, also of ids that repeat, are missing or hold most rows."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_operators import CITIES, STORES, order, tables

from shelfwise.functions.distinct import count_by, count_by_levels, ids_and_sums, members, memberships
from shelfwise.operators import audits, customer, delivery, kpi, sales
from shelfwise.plans import views

SCHEMA = "id bigint, store bigint, day string, amount bigint"


def random_rows(seed, n=2_000):
    rng = random.Random(seed)
    hot = [(7, rng.choice([1, 2, 3]), "d", 1) for _ in range(n // 3)]  # a third of all rows is one id
    return hot + [(rng.choice([None, *range(200)]), rng.choice([None, 1, 2, 3, 4]), rng.choice([None, "a", "b"]), rng.randint(0, 9))
                  for _ in range(n)]


@pytest.mark.parametrize("unique", [False, True])
def test_one_grouping(spark, unique):
    data = random_rows(1)
    if unique:
        data = [(i, s, d, a) for i, (_, s, d, a) in enumerate(data)]
    found = ids_and_sums(spark.createDataFrame(data, SCHEMA), "id", {"store": F.col("store"), "day": F.col("day")},
                         {"amount": F.col("amount")}, unique=unique)
    expected = {}
    for i, store, day, amount in data:
        ids, count, total = expected.get((store, day), (set(), 0, 0))
        expected[store, day] = (ids | ({i} if i is not None else set()), count + 1, total + amount)
    got = {(r["store"], r["day"]): (r["ids"], r["rows"], r["amount"]) for r in found.collect()}
    assert got == {k: (len(ids), count, total) for k, (ids, count, total) in expected.items()}


def test_sets_give_the_counts_of_every_coarser_grouping(spark):
    data = random_rows(2)
    df = spark.createDataFrame(data, SCHEMA)
    reached = members(memberships(df, "id", {"store": F.col("store"), "day": F.col("day")})).withColumn("half", F.col("store") % 2)
    for by in (["store", "day"], ["store"], ["half"], ["day"], ["half", "day"]):
        names = {"store": 1, "day": 2}
        expected = {}
        for row in data:
            if row[0] is not None:
                key = tuple((None if row[1] is None else row[1] % 2) if c == "half" else row[names[c]] for c in by)
                expected.setdefault(key, set()).add(row[0])
        got = {tuple(r[c] for c in by): r["ids"] for r in count_by(reached, by).collect()}
        assert got == {k: len(ids) for k, ids in expected.items()}
    levels = count_by_levels(reached, ["half", "store"]).collect()
    assert {r["ids"] for r in levels if r["level"] == 0} == {len({r[0] for r in data} - {None})}
    assert {(r["half"], r["store"]): r["ids"] for r in levels if r["level"] == 2} == {
        (None if s is None else s % 2, s): len({r[0] for r in data if r[1] == s} - {None}) for s in [None, 1, 2, 3, 4]}


def test_facts_are_not_expanded_and_ids_are_what_is_shuffled(spark, tmp_path):
    spark.createDataFrame(random_rows(3), SCHEMA).write.parquet(str(tmp_path / "facts"))
    df = spark.read.parquet(str(tmp_path / "facts"))
    single = ids_and_sums(df, "id", {"store": F.col("store")}, {})
    several = count_by(members(memberships(df, "id", {"store": F.col("store")})), ["store"])
    for found in (single, several):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Expand" not in plan and "_id#" in plan[plan.index("hashpartitioning"):]
    known = ids_and_sums(df, "id", {"store": F.col("store")}, {}, unique=True)
    assert "id:" not in known._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]


def shop(spark):
    """Order 1 twice in its store and once in the other store of the city, 2 also in the other city, 3 without an id."""
    return tables(spark, cities=CITIES, dark_stores=STORES, orders=[
        order(1), order(1), order(1, store_id=2, when="2024-01-06 11:00:00"), order(2), order(2, store_id=3, promo_id=1),
        order(None, store_id=3), order(4, store_id=3, when="2024-02-05 10:00:00")],
        promotions=[dict(promo_id=1, promo_code="P")])


def test_questions_count_repeated_orders_once(spark):
    t = shop(spark)
    assert rows(kpi.revenue_by_city(t).select("city_id", "total_revenue", "total_orders")) == [(1, 40.0, 2), (2, 30.0, 2)]
    assert rows(kpi.orders_by_place(t).select("level", "city_id", "store_id", "total_orders")) == sorted([
        ("all", None, None, 3), ("tier", None, None, 2), ("tier", None, None, 2), ("city", 1, None, 2), ("city", 2, None, 2),
        ("store", 1, 1, 2), ("store", 1, 2, 1), ("store", 2, 3, 2)], key=lambda r: [(v is not None, v) for v in r])
    assert rows(sales.weekday_weekend(t).select("day_type", "total_orders", "avg_order_value")) == [
        ("Weekday", 3, 10.0), ("Weekend", 1, 10.0)]
    assert rows(sales.promo_effectiveness(t).select("promo_used", "total_orders", "total_revenue")) == [
        ("No Promotion", 3, 60.0), ("P", 1, 10.0)]
    assert rows(delivery.peak_hour(t).select("order_hour", "total_orders")) == [(10, 3), (11, 1)]
    assert rows(views.monthly_city_revenue_shown(t).select("city_id", "order_month", "total_orders", "avg_order_value")) == [
        (1, "2024-01", 2, 10.0), (2, "2024-01", 1, 10.0), (2, "2024-02", 1, 10.0)]
    assert rows(views.store_daily_performance(t).select("store_id", "total_orders", "total_revenue")) == [
        (1, 2, 30.0), (2, 1, 10.0), (3, 1, 10.0), (3, 1, 20.0)]


def test_a_customer_counts_once_per_city_name(spark):
    people = [dict(customer_id=1, city_id=1, is_active=False), dict(customer_id=1, city_id=1, is_active=True),
              dict(customer_id=1, city_id=2, is_active=False), dict(customer_id=2, city_id=3, is_active=None),
              dict(customer_id=2, city_id=1, is_active=False), dict(customer_id=None, city_id=2, is_active=True)]
    cities = [*CITIES, dict(city_id=3, city_name="A")]
    t = tables(spark, customers=people, cities=cities, orders=[order(1), order(2), order(3, customer_id=2)])
    assert rows(customer.city_engagement(t)) == [("A", 2, 1, 3.0), ("B", 1, 0, 2.0)]


def test_return_rate_counts_ids_once(spark):
    items = [dict(order_item_id=i, order_id=o, product_id=1) for i, o in [(1, 1), (1, 1), (2, 1), (2, 2), (3, 9), (None, 1)]]
    returned = [dict(return_id=r, order_item_id=i) for r, i in [(1, 1), (1, 1), (1, 2), (2, 2), (3, 3), (None, 1)]]
    t = tables(spark, orders=[order(1), order(1), order(2, status="Returned"), order(9, status="Cancelled")], order_items=items, returns=returned)
    assert rows(kpi.return_rate(t)) == [(2, 2, 100.0)]


def test_keys_that_hold_are_declared(spark):
    t = shop(spark)
    checked = audits.with_checked_keys(t)
    assert "orders" not in checked.unique and {"cities", "customers", "order_items"} <= checked.unique
    clean = audits.with_checked_keys(t.replaced(orders=t["orders"].filter("order_id = 4")))
    assert "orders" in clean.unique and "orders" not in clean.replaced(orders=t["orders"]).unique
    assert rows(kpi.revenue_by_city(clean).select("city_id", "total_orders")) == [(2, 1)]
