"""Refreshes that find their own changes, and alerts that can be tried again."""

import os
import shutil

import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_operators import CITIES, PRODUCTS, STORES, order, snapshot, tables

from shelfwise.plans import alerts, jobs, refresh, views
from shelfwise.schemas import SCHEMAS
from shelfwise.sources.files import parquet_tables, write_table


def store(spark, folder, orders, cities=CITIES):
    t = tables(spark, cities=cities, dark_stores=STORES, orders=orders)
    for name in refresh.SOURCES:
        write_table(t[name], folder, name)


def append(spark, folder, month, *orders):
    more = tables(spark, orders=list(orders))["orders"].withColumn("month", F.lit(month))
    more.write.mode("append").partitionBy("month").parquet(f"{folder}/orders")


def files(folder, month):
    path = f"{folder}/orders/month={month}"
    return [f"{path}/{name}" for name in os.listdir(path) if name.endswith(".parquet")]


def fresh(spark, folder):
    return rows(views.monthly_city_revenue(parquet_tables(spark, folder)))


@pytest.fixture
def shop(spark, tmp_path):
    stored, versions = str(tmp_path / "stored"), str(tmp_path / "versions")
    store(spark, stored, [
        order(1, when="2024-01-31 23:59:59"), order(2, store_id=2, when="2024-02-01 00:00:00"),
        order(3, store_id=3, when="2024-03-29 12:00:00"), order(4, when="2024-03-01 12:00:00"),
    ])
    first = refresh.refresh_changed(spark, stored, versions)
    assert first.months is None and rows(refresh.table_of(spark, first.path)) == fresh(spark, stored)
    return stored, versions


def test_a_changed_month_is_found_and_the_others_are_not_opened(spark, shop):
    stored, versions = shop
    append(spark, stored, "2024-02", order(5, when="2024-02-02 00:00:00"))
    expected = fresh(spark, stored)
    for path in files(stored, "2024-01") + files(stored, "2024-03"):  # unreadable, but of the same length and time
        status = os.stat(path)
        with open(path, "wb") as out:
            out.write(b"x" * status.st_size)
        checksum = os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.crc")
        if os.path.exists(checksum):
            os.remove(checksum)
        os.utime(path, ns=(status.st_atime_ns, status.st_mtime_ns))
    found = refresh.refresh_changed(spark, stored, versions)
    assert found.months == ["2024-02"]
    assert rows(refresh.table_of(spark, found.path)) == expected == rows(spark.table("monthly_city_revenue"))


def test_new_and_removed_months_are_found(spark, shop):
    stored, versions = shop
    append(spark, stored, "2024-04", order(6, when="2024-04-02 00:00:00"))
    shutil.rmtree(f"{stored}/orders/month=2024-01")
    found = refresh.refresh_changed(spark, stored, versions)
    assert found.months == ["2024-01", "2024-04"]
    assert rows(refresh.table_of(spark, found.path)) == fresh(spark, stored)
    assert "2024-01" not in {r[2] for r in fresh(spark, stored)}


def test_a_change_of_a_dimension_changes_all_months(spark, shop):
    stored, versions = shop
    write_table(tables(spark, cities=[{**CITIES[0], "city_name": "New name"}, *CITIES[1:]])["cities"], stored, "cities")
    found = refresh.refresh_changed(spark, stored, versions)
    assert found.months is None and rows(refresh.table_of(spark, found.path)) == fresh(spark, stored)


def test_without_a_change_nothing_is_written(spark, shop):
    stored, versions = shop
    known = refresh.versions(spark, versions)
    found = refresh.refresh_changed(spark, stored, versions)
    assert (found.path, found.months) == (known[-1], []) and refresh.versions(spark, versions) == known
    assert len(os.listdir(versions)) == 1


def test_the_newest_versions_remain_and_broken_ones_are_not_read(spark, shop):
    stored, versions = shop
    broken = f"{versions}/v00000001-{'f' * 32}"  # broke off before it was whole
    shutil.copytree(refresh.versions(spark, versions)[-1], broken)
    shutil.rmtree(f"{broken}/whole")
    for day in (1, 2, 3):
        append(spark, stored, "2024-05", order(100 + day, when=f"2024-05-0{day} 00:00:00"))
        last = refresh.refresh_changed(spark, stored, versions, keep=2)
        assert last.months == ["2024-05"]
    kept = refresh.versions(spark, versions)
    assert len(kept) == 2 and kept[-1] == last.path and not os.path.exists(broken)
    assert [r[3] for r in rows(refresh.table_of(spark, kept[0])) if r[2] == "2024-05"] == [2]
    assert rows(refresh.table_of(spark, last.path)) == fresh(spark, stored)


def low(spark):
    return tables(spark, dark_stores=STORES, products=PRODUCTS, inventory=[
        snapshot(1, 1, "2024-01-01", closing=20), snapshot(1, 2, "2024-01-01", closing=21), snapshot(2, 1, "2024-01-01")])


def pairs(spark, path):
    return rows(alerts.read_alerts(spark, path).select("store_id", "product_id", "closing_stock"))


def test_a_run_that_is_tried_again_is_appended_once(spark, tmp_path):
    once = [(1, 1, 20), (2, 1, 0)]
    for run, expected in [("2024-01-02", once), ("2024-01-02", once), ("2024-01-03", sorted(once * 2)), ("2024-01-02", sorted(once * 2))]:
        path = jobs.flag_low_stock(low(spark), str(tmp_path), run)
        assert pairs(spark, path) == expected
    found = rows(alerts.ledger(spark, path).select("run", "alerts"))
    assert found == [("2024-01-02", 2), ("2024-01-03", 2)]
    assert alerts.read_alerts(spark, path).schema == SCHEMAS["low_stock_alerts"]


def test_attempts_that_broke_off_or_came_second_are_not_seen(spark, tmp_path):
    path = f"{tmp_path}/low_stock_alerts"
    some = alerts.low_stock(low(spark))
    assert alerts.append_alerts(spark, some, path, "a/b = c")
    stray = some.withColumns({"flagged_at": F.localtimestamp(), "run": F.lit("next"), "attempt": F.lit("0")})
    stray.write.mode("append").partitionBy("run", "attempt").parquet(f"{path}/rows")  # no entry in the ledger
    assert len(pairs(spark, path)) == 2
    assert alerts.append_alerts(spark, some, path, "next") and len(pairs(spark, path)) == 4
    late = spark.createDataFrame([("next", "0", 2)], "run string, attempt string, alerts bigint")
    late.withColumn("committed_at", F.current_timestamp()).write.mode("append").parquet(f"{path}/ledger")
    assert len(pairs(spark, path)) == 4
    assert not alerts.append_alerts(spark, some, path, "a/b = c")


def test_a_run_without_alerts_is_committed_too(spark, tmp_path):
    path = f"{tmp_path}/low_stock_alerts"
    assert alerts.read_alerts(spark, path).collect() == []
    nothing = alerts.low_stock(low(spark)).filter("false")
    assert alerts.append_alerts(spark, nothing, path, "r") and not alerts.append_alerts(spark, nothing, path, "r")
    assert alerts.read_alerts(spark, path).collect() == []
