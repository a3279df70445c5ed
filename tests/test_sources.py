"""CSV and Parquet tables."""

import datetime as dt
from decimal import Decimal

import pytest
from conftest import rows
from test_operators import CITIES, STORES, order, snapshot, tables, trips

from shelfwise.operators import cleaning, delivery, inventory, kpi, sales
from shelfwise.plans import jobs
from shelfwise.schemas import SCHEMAS
from shelfwise.sources import files


def test_whole_numbers_written_as_decimals(spark, tmp_path):
    (tmp_path / "categories.csv").write_text("category_id,category_name,parent_category_id\n1,Food,\n2,Fruit,1.0\n\n")
    assert rows(files.read_csv(spark, str(tmp_path), "categories")) == [(1, "Food", None), (2, "Fruit", 1)]


def test_booleans_dates_and_money(spark, tmp_path):
    (tmp_path / "dark_stores.csv").write_text(
        "store_id,store_name,city_id,store_area_sqft,opened_date,is_active\n1,A Store,1,1500,2025-10-25,False\n"
    )
    assert rows(files.read_csv(spark, str(tmp_path), "dark_stores")) == [(1, "A Store", 1, 1500, dt.date(2025, 10, 25), False)]
    (tmp_path / "orders.csv").write_text(
        "order_id,customer_id,store_id,promo_id,order_datetime,order_status,total_amount\n"
        "1,615,18,,2026-05-16 18:08:18,Delivered,581.43\n4,623,8,2.0,2026-04-27 08:02:48.5,Returned,3168.0\n"
    )
    assert rows(files.read_csv(spark, str(tmp_path), "orders")) == [
        (1, 615, 18, None, dt.datetime(2026, 5, 16, 18, 8, 18), "Delivered", Decimal("581.43")),
        (4, 623, 8, 2, dt.datetime(2026, 4, 27, 8, 2, 48, 500000), "Returned", Decimal("3168.00")),
    ]


def test_large_ids_are_exact_and_bad_values_stop_the_job(spark, tmp_path):
    (tmp_path / "categories.csv").write_text(
        f"category_id,category_name,parent_category_id\n{2**62 + 1},Food,\n2,Fruit,{2**53 + 1}.0\n")
    assert rows(files.read_csv(spark, str(tmp_path), "categories")) == [(2, "Fruit", 2**53 + 1), (2**62 + 1, "Food", None)]
    for bad in ["x", "1.5", "1e3"]:
        (tmp_path / "categories.csv").write_text(f"category_id,category_name,parent_category_id\n1,Food,{bad}\n")
        with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
            files.read_csv(spark, str(tmp_path), "categories").collect()
    (tmp_path / "promotions.csv").write_text(
        "promo_id,promo_code,description,discount_pct,start_date,end_date\n1,A,,ten,2024-01-01,2024-01-02\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        files.read_csv(spark, str(tmp_path), "promotions").collect()


def test_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "cities.csv").write_text("state,tier,city_id,extra,city_name\nMH,Tier2,1,x,Pune\n")
    assert rows(files.read_csv(spark, str(tmp_path), "cities")) == [(1, "Pune", "MH", "Tier2")]
    (tmp_path / "cities.csv").write_text("state,city_id,city_name\nMH,1,Pune\n")
    with pytest.raises(ValueError, match="no column tier"):
        files.read_csv(spark, str(tmp_path), "cities")


def test_parts_with_other_headers_stop_the_job(spark, tmp_path):
    (tmp_path / "cities.csv").mkdir()
    (tmp_path / "cities.csv" / "part-0.csv").write_text("city_id,city_name,state,tier\n1,Pune,MH,Tier2\n")
    (tmp_path / "cities.csv" / "part-1.csv").write_text("city_id,state,city_name,tier\n2,MH,Thane,Tier2\n")
    with pytest.raises(Exception, match="(?i)header"):
        files.read_csv(spark, str(tmp_path), "cities").collect()


def test_other_months_are_not_opened(spark, tmp_path):
    t = sample(spark)
    for name in files.BASE_TABLES:
        files.write_table(t[name], str(tmp_path / "stored"), name)
    first = jobs.refresh_monthly_city_revenue(spark, t, str(tmp_path / "mv"))
    for path in (tmp_path / "stored" / "orders" / "month=2024-01").glob("*.parquet"):
        path.write_bytes(b"not a table")
        (path.parent / f".{path.name}.crc").unlink(missing_ok=True)
    again = jobs.refresh_stored_months(spark, str(tmp_path / "stored"), str(tmp_path / "mv"), ["2024-02"], first)
    assert rows(spark.read.parquet(again)) == rows(spark.read.parquet(first))
    with pytest.raises(Exception):
        files.read_table(spark, str(tmp_path / "stored"), "orders").collect()


def sample(spark):
    orders, deliveries = trips(1, [10, 12, None])
    deliveries[0]["dispatched_at"] = dt.datetime(2024, 1, 5, 10, 1, 2, 345678)
    people = [dict(customer_id=1, full_name='  Ann "Q", Jr. ', email="a@b", city_id=1, is_active=True)]
    return tables(spark, orders=orders + [order(9, when="2024-02-01 00:00:00")], deliveries=deliveries, cities=CITIES,
                  dark_stores=STORES, customers=people,
                  inventory=[snapshot(1, 1, "2024-01-31", closing=3), snapshot(1, 1, "2024-02-07", closing=1)])


def test_csv_gives_back_what_was_written(spark, tmp_path):
    t = sample(spark)
    for name in files.BASE_TABLES:
        files.write_csv(t[name], str(tmp_path), name)
    back = files.csv_tables(spark, str(tmp_path))
    for name in files.BASE_TABLES:
        assert rows(back[name]) == rows(t[name]), name


def test_bulk_load_replaces_tables(spark, tmp_path):
    t = sample(spark)
    csv, stored = str(tmp_path / "csv"), str(tmp_path / "stored")
    for name in files.BASE_TABLES:
        files.write_csv(t[name], csv, name)
    for _ in range(2):
        files.load_csv_folder(spark, csv, stored)
    back = files.parquet_tables(spark, stored)
    for name in files.BASE_TABLES:
        assert rows(back[name]) == rows(t[name]), name
        assert back[name].schema == SCHEMAS[name]
    assert sorted(p.name for p in (tmp_path / "stored" / "orders").glob("month=*")) == ["month=2024-01", "month=2024-02"]
    files.register_views(back)
    assert spark.sql("SELECT count(*) FROM deliveries WHERE actual_time_mins IS NULL").first()[0] == 1


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_buckets_spare_the_shuffles(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS shop")
    t = sample(spark)
    files.save_tables(t, "shop", buckets=4)
    stored = files.catalog_tables(spark, "shop")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert "Exchange" not in plan_of(inventory.stock_movement(stored))
        assert "Exchange" not in plan_of(inventory.rolling_avg(stored))
        assert "hashpartitioning(order_id" not in plan_of(kpi.sla_by_store(stored))
        assert "hashpartitioning(order_id" not in plan_of(sales.best_seller_per_store(stored))
        for question in [kpi.sla_by_store, delivery.percentiles_exact, inventory.stock_movement]:
            assert rows(question(stored)) == rows(question(t))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_filters_and_columns_reach_the_files(spark, tmp_path):
    t = sample(spark)
    for name in files.BASE_TABLES:
        files.write_table(t[name], str(tmp_path), name)
    plan = plan_of(kpi.aov_by_store(files.parquet_tables(spark, str(tmp_path))))
    assert "EqualTo(order_status,Delivered)" in plan
    assert "struct<store_id:bigint,order_status:string,total_amount:decimal(12,2)" in plan


def test_cleaning_a_folder(spark, tmp_path):
    source, target = tmp_path / "raw", tmp_path / "clean"
    source.mkdir()
    (source / "orders.csv").write_text(
        "order_id,customer_id,store_id,promo_id,order_datetime,order_status,total_amount\n"
        "1,1,1,2.0,2024-01-05 10:00:00,Delivered,5.0\n1,1,1,2.0,2024-01-05 10:00:00,Delivered,5.0\n"
        "2,1,1,,soon,Placed,5.0\n3,1,1,,2024-01-05 10:00:00,,5.0\n"
    )
    report = cleaning.clean_csv_folder(spark, str(source), str(target), ["orders"])
    assert rows(report) == [("orders", 4, 1, 0, 1, 2)]
    got = rows(files.read_table(spark, str(target), "orders").select("order_id", "promo_id", "order_datetime"))
    assert got == [(1, 2, dt.datetime(2024, 1, 5, 10)), (2, None, None)]


def test_cleaning_finds_the_files_and_survives_bad_values(spark, tmp_path):
    source, target = tmp_path / "raw", tmp_path / "clean"
    source.mkdir()
    (source / "cities.csv").write_text("tier,state,city_name,city_id\nTier1,MH, Mumbai ,1\nTier1,MH, Mumbai ,1\nTier2,NA,Pune,two\n")
    (source / "returns.csv").write_text(
        "return_id,order_item_id,return_reason,return_date,refund_amount\n1,1,N/A,05/16/2026,1.50\n2,2,late,16-May-2026,N/A\n"
        "3,3,,20260516,3\n4,4,x,2026-05-16,3\n5,5,x,soon,3\n6,6,x,13/45/2026,3\n7,7,x,2026-05-16,much\n")
    (source / "notes.csv").write_text("a,b\n1,x\n1,x\n")
    report = rows(cleaning.clean_csv_folder(spark, str(source), str(target)))
    assert report == [("cities", 3, 1, 1, 0, 1), ("notes", 2, 1, 0, 0, 1), ("returns", 7, 0, 1, 2, 4)]
    day = dt.date(2026, 5, 16)
    assert rows(spark.read.parquet(str(target / "returns")).select("return_id", "return_reason", "return_date", "refund_amount")) == [
        (1, None, day, Decimal("1.50")), (2, "late", day, None), (3, None, day, Decimal("3.00")), (4, "x", day, Decimal("3.00"))]
    assert rows(cleaning.rejected(spark, str(target), "returns").select("return_id", cleaning.REJECTED)) == [(7, "refund_amount: much")]
    assert rows(cleaning.rejected(spark, str(target), "cities").select("city_name", cleaning.REJECTED)) == [("Pune", "city_id: two")]


@pytest.mark.parametrize("as_csv", [True, False])
def test_cleaned_tables_can_be_csv(spark, tmp_path, as_csv):
    source, target = tmp_path / "raw", tmp_path / "clean"
    source.mkdir()
    (source / "cities.csv").write_text("city_id,city_name,state,tier\n1,  Pune ,MH,Tier2\n")
    cleaning.clean_csv_folder(spark, str(source), str(target), ["cities"], as_csv=as_csv)
    read = files.read_csv if as_csv else files.read_table
    assert rows(read(spark, str(target), "cities")) == [(1, "Pune", "MH", "Tier2")]
