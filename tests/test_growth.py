"""What a task holds does not grow with the input, and inputs are made in one pass."""

import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_operators import CITIES, STORES, items, order, snapshot, tables

from shelfwise import session
from shelfwise.operators import audits, cleaning
from shelfwise.operators.measures import measures, states
from shelfwise.sources import dirty, files
from shelfwise.sources.grading import grading_tables

DEALT = "REPARTITION_BY_NUM"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def few_rows_a_task(monkeypatch):
    monkeypatch.setattr(session, "ROWS_PER_TASK", 2)
    monkeypatch.setattr(session, "LEAST_TASKS", 3)


@pytest.fixture
def folder(spark, tmp_path):
    """Lines of 12 orders, two to a snapshot, and one without a store."""
    day = dt.datetime(1995, 1, 2)
    lines = [(k, 21, k % 4 + 2, n, 2.0, 10.0, "RN"[n % 2], day) for k in range(1, 13) for n in (1, 2)] + [(13, 1, None, 1, 1.0, 1.0, "N", day)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                          "l_extendedprice double, l_returnflag string, l_shipdate timestamp_ntz").write.parquet(f"{tmp_path}/lineitem.parquet")
    orders = [(k, 1, "FPO"[k % 3], 20.0, day, "1-URGENT") for k in [*range(1, 14), 1]]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
                          "o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(k, f"S{k}", 1) for k in range(6)], "s_suppkey long, s_name string, s_nationkey int").write.parquet(
        f"{tmp_path}/supplier.parquet")
    return str(tmp_path)


def test_copies_of_rows_come_from_one_pass(spark, tmp_path):
    days = [(1, "1995-01-02"), (3, "1995-01-02"), (None, "1995-01-09")]
    t = tables(spark, order_items=[{**one, "order_item_id": k} for k, one in enumerate(items((1, 1, 1), (2, 1, 1), (3, 1, 1)))],
               returns=[dict(return_id=k, order_item_id=k) for k in (3, 4, None)],
               deliveries=[dict(delivery_id=k, order_id=k, actual_time_mins=5) for k in (1, 2, 3, 10, None)],
               inventory=[snapshot(store, 1, day) for store, day in days])
    for name in ["order_items", "returns", "deliveries", "inventory"]:
        t[name].write.parquet(str(tmp_path / name))
    stored = t.replaced(**{name: spark.read.parquet(str(tmp_path / name)) for name in ["order_items", "returns", "deliveries", "inventory"]})
    ids = {"repeated_items": "order_item_id", "repeated_returns": "return_id", "dirty_deliveries": "delivery_id", "dirty_inventory": "store_id"}
    found = {name: getattr(dirty, name)(stored) for name in ids}
    assert all(plan(df).count("FileScan") == 1 for df in found.values())
    assert rows(found["repeated_items"].select("order_item_id")) == [(0,), (0,), (1,), (2,), (2,)]
    assert rows(found["repeated_returns"].select("return_id")) == [(None,), (3,), (3,), (3,), (4,)]
    billion = 1_000_000_000
    assert rows(found["dirty_deliveries"].select("delivery_id", "actual_time_mins")) == [
        (None, 5), (1, 5), (2, 5), (3, 5), (10, 5), (billion + 1, 5), (billion + 2, 5), (billion + 10, 5),
        (2 * billion + 1, 12), (2 * billion + 10, 12)]
    stock = rows(found["dirty_inventory"].select("store_id", "closing_stock"))
    closing = snapshot(3, 1, "1995-01-02")["closing_stock"]
    assert [r for r in stock if r[0] == 3] == [(3, closing), (3, closing + 1)] and len(stock) == 4
    for name, table in [("repeated_items", "order_items"), ("repeated_returns", "returns"), ("dirty_deliveries", "deliveries")]:
        assert found[name].dtypes == t[table].dtypes


def test_returns_number_the_lines_of_returned_orders_only(spark, folder):
    t = grading_tables(spark, folder)
    text = plan(t["returns"])
    assert text.index("Window") < text.index("LeftSemi")  # below the window
    # Of status P are the orders with remainder 1 by 3, which are the returned ones.
    returned = t["orders"].filter("order_status = 'Returned'").select("order_id")
    whole = t["order_lines"].filter("l_returnflag = 'R'").join(returned, "order_id")
    assert rows(t["returns"].select("order_item_id")) == rows(whole.select("order_item_id")) != []


def test_the_rows_of_an_inventory_task_are_bounded(spark, folder, few_rows_a_task):
    """Dealt out by key and by number: 25 lines make 13 tasks of two rows, and no key is combined before."""
    dealt = grading_tables(spark, folder)["inventory"]
    assert plan(dealt).count("hashpartitioning") == 1 and ", 13), " + DEALT in plan(dealt)
    assert rows(dealt.select("store_id", "product_id", "units_sold")) == [(None, 1, 1), *[(k, 1, 12) for k in range(2, 6)]]


def test_unique_keys_of_inventory_are_counted_where_they_are(spark, folder, few_rows_a_task):
    t = grading_tables(spark, folder)
    keyed = audits._repeated(t["inventory"], ["store_id", "product_id", "stock_date"])
    assert plan(keyed).count("hashpartitioning") == 1 and DEALT in plan(keyed)
    found = {(r["table_name"], r["rule"]): r["violations"] for r in audits.unique_keys(t, ["inventory", "payments"]).collect()}
    assert found == {("inventory", "unique store_id, product_id, stock_date"): 0, ("payments", "unique order_id"): 1}


def test_cleaned_inventory_is_dealt_out_first(spark, folder, few_rows_a_task):
    t = grading_tables(spark, folder)
    cleaned = cleaning.clean_table(dirty.dirty_inventory(t), "inventory")
    assert DEALT in plan(cleaned) and plan(cleaned).count("FileScan") == 1
    assert rows(cleaned.select("store_id")) == [(2,), (3,), (3,), (4,), (5,)]


def test_measures_deal_out_orders_and_states(spark, few_rows_a_task):
    t = tables(spark, cities=CITIES, dark_stores=STORES, orders=[order(k, store_id=k % 3 + 1) for k in range(1, 9)],
               deliveries=[dict(delivery_id=k, order_id=k, promised_time_mins=10, actual_time_mins=8 + k) for k in range(1, 7)])
    assert plan(states(t)).count(DEALT) == 3
    found = measures(t, [[], ["store_id"]]).select("store_id", F.round("sla", 2), "cancellation_rate")
    assert rows(found) == [(None, 0.33, 0.0), (1, 0.0, 0.0), (2, 0.5, 0.0), (3, 0.5, 0.0)]


def test_buckets_follow_the_rows(spark, tmp_path, few_rows_a_task):
    """As many as the largest table of a key needs, and the given number at least."""
    spark.sql(f"CREATE DATABASE bucketed LOCATION '{tmp_path}/db'")
    try:
        files.save_tables(tables(spark, orders=[order(k) for k in range(7)], deliveries=[dict(delivery_id=1, order_id=1)]),
                          "bucketed", 2, ["orders", "deliveries", "inventory"])
        number = {name: {r[0]: r[1] for r in spark.sql(f"DESCRIBE EXTENDED bucketed.{name}").collect()}.get("Num Buckets")
                  for name in ["orders", "deliveries", "inventory"]}
        assert number == {"orders": "4", "deliveries": "4", "inventory": "2"}
        assert spark.table("bucketed.orders").count() == 7
    finally:
        spark.sql("DROP DATABASE bucketed CASCADE")
