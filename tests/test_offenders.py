"""The offending rows of constraints, by rule."""

import datetime as dt

import pytest
from conftest import rows
from test_operators import CITIES, STORES, items, order, snapshot, tables

from shelfwise.operators import audits, offenders
from shelfwise.operators.offenders import BROKEN, Offenders, quarantined
from shelfwise.sources.files import BASE_TABLES


def broken(found, name, *columns):
    return rows(found.by_rule(name).select("rule", *columns))


def test_rows_carry_all_rules_they_break(spark):
    t = tables(spark, cities=CITIES, dark_stores=STORES, customers=[dict(customer_id=1, city_id=1)], orders=[
        order(1), order(1, status="Odd"), order(2, customer_id=5, store_id=9, status=None, total="-1.00"), order(None), order(3)])
    found = Offenders(t, ["orders"])
    got = {(r["order_id"], r["order_status"]): sorted(r[BROKEN]) for r in found.rows("orders").collect()}
    assert got == {
        (1, "Delivered"): ["primary key order_id"], (1, "Odd"): ["order_status domain", "primary key order_id"],
        (2, None): ["customer_id in customers", "order_status not null", "store_id in dark_stores", "total_amount range"],
        (None, "Delivered"): ["primary key order_id"]}
    assert found.rows("orders").columns == [*t["orders"].columns, BROKEN]


def test_unique_keys_of_text_and_of_several_columns(spark):
    people = [dict(customer_id=i, email=e, full_name="n", city_id=1, signup_date=dt.date(2024, 1, 1), is_active=True)
              for i, e in enumerate(["a", "a", None, None, "b"])]
    stock = [snapshot(1, 1, "2024-01-01"), snapshot(1, 1, "2024-01-01"), snapshot(1, 1, "2024-01-02")]
    for k, one in enumerate(stock):
        one["inventory_id"] = k
    t = tables(spark, cities=CITIES, dark_stores=STORES, customers=people, products=[dict(product_id=1)], inventory=stock)
    found = Offenders(t, ["customers", "inventory"])
    assert [r for r in broken(found, "customers", "customer_id") if r[0].startswith("unique")] == [("unique email", 0), ("unique email", 1)]
    rule = "unique store_id, product_id, stock_date"
    assert [r for r in broken(found, "inventory", "inventory_id") if r[0] == rule] == [(rule, 0), (rule, 1)]


def test_counts_agree_with_the_counting_audits(spark):
    t = tables(spark, cities=[*CITIES, dict(city_id=None)], dark_stores=STORES, categories=[
        dict(category_id=1, category_name="c", parent_category_id=1), dict(category_id=2, parent_category_id=7)],
        orders=[order(k % 40, customer_id=k % 3, promo_id=k % 2) for k in range(100)], order_items=items((1, 1, 1), (77, 1, 1)))
    found = {(r["rule"], r["table_name"]): r["offending_rows"] for r in Offenders(t).summary().collect()}
    counted = [audits.foreign_keys(t), audits.domains(t), audits.ranges(t), audits.not_null(t)]
    expected = {(r["rule"], r["table_name"]): r["violations"] for df in counted for r in df.collect() if r["violations"]}
    assert {k: n for k, n in found.items() if not k[0].startswith(("primary", "unique"))} == expected
    assert found["primary key order_id", "orders"] == 100 and found["primary key city_id", "cities"] == 1


@pytest.mark.parametrize("part", [1, 4, 1_000_000])
def test_a_key_with_most_rows_is_looked_up_apart(spark, monkeypatch, part):
    """Whether a key counts as frequent changes where it is looked up, not what is found; rows stand once, nulls are fine."""
    monkeypatch.setattr(offenders, "HOT_PART", part)
    orders = [order(k, customer_id=99 if k % 3 else 1000 + k, promo_id=5 if k % 2 else None) for k in range(300)]
    t = tables(spark, dark_stores=STORES, customers=[dict(customer_id=1003)], orders=orders)
    got = broken(Offenders(t, ["orders"]), "orders", "order_id")
    assert got == sorted([("customer_id in customers", k) for k in range(300) if k != 3] +
                         [("promo_id in promotions", k) for k in range(1, 300, 2)])


def test_every_table_is_read_twice_at_most(spark, tmp_path):
    t = tables(spark, cities=CITIES, dark_stores=STORES, orders=[order(1), order(1), order(2)])
    for name in BASE_TABLES:
        t[name].write.parquet(str(tmp_path / name))
    stored = t.replaced(**{name: spark.read.parquet(str(tmp_path / name)) for name in BASE_TABLES})
    keys = offenders.broken_keys(stored)._jdf.queryExecution().executedPlan().toString()
    assert keys.count("FileScan") == len(BASE_TABLES) and "SortAggregate" not in keys
    found = Offenders(stored)
    tagged = found.rows("orders")._jdf.queryExecution().executedPlan().toString()
    assert tagged.count(f"{tmp_path}/orders") == 1
    clean = found.rows("payments")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in clean


def test_quarantine_is_split_by_rule(spark, tmp_path):
    t = tables(spark, cities=CITIES, dark_stores=STORES, customers=[dict(customer_id=1, city_id=1, full_name="n", email="e",
               signup_date=dt.date(2024, 1, 1), is_active=True)], orders=[order(1, store_id=9, status="Odd"), order(2)])
    found = Offenders(t, ["orders", "customers"])
    for _ in range(2):  # replaced, not added to
        assert found.quarantine(str(tmp_path)) == ["orders"]
    schema = t["orders"].schema
    both = quarantined(spark, str(tmp_path), "orders", schema)
    assert rows(both.select("rule", "order_id")) == [("order_status domain", 1), ("store_id in dark_stores", 1)]
    one = quarantined(spark, str(tmp_path), "orders", schema, "store_id in dark_stores")
    assert rows(one.select("order_id")) == [(1,)] and "PartitionFilters: [isnotnull(rule" in one._jdf.queryExecution().executedPlan().toString()


def test_a_missing_table_or_column_is_not_passed_over(spark):
    t = tables(spark, orders=[order(1)])
    with pytest.raises(ValueError, match="not checked: orders has no column"):
        Offenders(t.replaced(orders=t["orders"].drop("store_id")), ["orders"])


def test_the_summary_reads_every_table_once_and_joins_nothing(spark, tmp_path):
    t = tables(spark, cities=CITIES, dark_stores=STORES, customers=[dict(customer_id=1, city_id=1)], orders=[
        order(1), order(1), order(2, customer_id=5, status="Odd", total="-1.00"), order(None)],
        deliveries=[dict(delivery_id=k, order_id=1) for k in range(2)], payments=[dict(payment_id=1, order_id=7)])
    for name in BASE_TABLES:
        t[name].write.parquet(str(tmp_path / name))
    summary = Offenders(t.replaced(**{name: spark.read.parquet(str(tmp_path / name)) for name in BASE_TABLES})).summary()
    plan = summary._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == len(BASE_TABLES) and "Join" not in plan
    found = {(r["table_name"], r["rule"]): r["offending_rows"] for r in summary.collect()}
    by_row = {}
    offenders_ = Offenders(t)
    for name in BASE_TABLES:
        for r in offenders_.by_rule(name).select("rule").collect():
            by_row[name, r["rule"]] = by_row.get((name, r["rule"]), 0) + 1
    assert found == by_row
    assert found["orders", "primary key order_id"] == 3 and found["deliveries", "unique order_id"] == 2
    assert found["payments", "order_id in orders"] == 1 and found["orders", "order_status domain"] == 1
