"""Views that outlive a session, and texts of bounded length."""

import pytest
from conftest import rows
from test_operators import CITIES, PRODUCTS, STORES, order, snapshot, tables

from shelfwise.operators import audits, cleaning
from shelfwise.operators.offenders import Offenders
from shelfwise.plans import lasting, views
from shelfwise.sources import files


def delivery(k, minutes, status="Delivered"):
    return dict(delivery_id=k, order_id=k // 10, partner_id=1, promised_time_mins=10, actual_time_mins=minutes, delivery_status=status)


@pytest.fixture
def database(spark, tmp_path):
    name = f"lasting_{tmp_path.name.replace('-', '_')}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{tmp_path}/db'")
    yield name
    spark.sql(f"DROP DATABASE {name} CASCADE")


def test_a_new_session_reads_both_views(spark, database):
    t = tables(spark, cities=CITIES, dark_stores=STORES, products=PRODUCTS, inventory=[
        snapshot(1, 1, "2024-01-01", closing=50), snapshot(1, 1, "2024-01-02", closing=20), snapshot(2, 1, "2024-01-01", closing=21)],
        orders=[order(1), order(1), order(2, status="Cancelled"), order(3, store_id=3), order(4, store_id=2, when="2024-01-07 01:00:00")],
        deliveries=[delivery(10, 3), delivery(11, 4), delivery(12, 6), delivery(20, 99, "Cancelled"), delivery(30, None)])
    files.save_tables(t, database, 2, lasting.SOURCES)
    lasting.create_views(spark, database)
    other = spark.newSession()
    for name, own in [("store_daily_performance", views.store_daily_performance(t)), ("product_inventory_health", views.product_inventory_health(t))]:
        found = other.table(f"{database}.{name}")
        assert found.columns == own.columns and dict(found.dtypes) == dict(own.dtypes)
        assert rows(found) == rows(own) and rows(own)
    more = t.replaced(orders=t["orders"].limit(0))
    files.save_tables(more, database, 2, ["orders"])  # views read what is stored now
    assert rows(spark.newSession().table(f"{database}.store_daily_performance")) == []


def test_views_of_stored_tables_shuffle_no_order_ids(spark, database):
    files.save_tables(tables(spark), database, 2, lasting.SOURCES)
    lasting.create_views(spark, database)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = spark.table(f"{database}.store_daily_performance")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "Expand" not in plan and "CartesianProduct" not in plan and "hashpartitioning(order_id#" not in plan.replace(", order_id#", "")


def test_longer_texts_are_found_and_not_stored(spark, database, tmp_path):
    fits, long = {**CITIES[0], "city_name": "é" * 100}, {**CITIES[1], "city_name": "é" * 101}
    t = tables(spark, cities=[fits, long])
    found = {r["rule"]: r["violations"] for r in audits.text_lengths(t).collect()}
    assert found["city_name length"] == 1 and sum(found.values()) == 1
    assert [r[0] for r in rows(Offenders(t, ["cities"]).by_rule("cities").select("city_id", "rule").filter("rule = 'city_name length'"))] == [2]
    files.save_tables(tables(spark, cities=[fits]), database, 2, ["cities"])
    with pytest.raises(Exception, match="EXCEED_LIMIT_LENGTH"):
        files.save_tables(t, database, 2, ["cities"])
    assert rows(spark.table(f"{database}.cities").select("city_id")) == [(1,)]  # the table of before
    assert dict(spark.table(f"{database}.cities").dtypes)["city_name"] == "string"
    assert ("city_name", "varchar(100)") in [(r[0], r[1]) for r in spark.sql(f"DESCRIBE {database}.cities").collect()]


def test_csv_files_with_longer_texts(spark, tmp_path):
    source = tmp_path / "raw"
    source.mkdir()
    (source / "cities.csv").write_text(f"city_id,city_name,state,tier\n1,{' ' * 90}Pune{' ' * 90},MH,Tier2\n2,{'x' * 101},MH,Tier1\n")
    with pytest.raises(Exception, match="city_name is longer than 100"):
        files.read_csv(spark, str(source), "cities").collect()
    cleaning.clean_csv_folder(spark, str(source), str(tmp_path / "clean"))
    assert rows(spark.read.parquet(str(tmp_path / "clean" / "cities")).select("city_id", "city_name")) == [(1, "Pune")]
    assert rows(cleaning.rejected(spark, str(tmp_path / "clean"), "cities").select("city_id", cleaning.REJECTED)) == [
        (2, f"city_name: {'x' * 101}")]
