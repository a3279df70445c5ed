"""Every registered query against DuckDB, and what its plan must not contain."""

import os
import re

import pytest

import __spark_entry__ as registry
import check_oracle

FOLDER = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()
NAMES = [name for name in registry.queries() if name in SQL]
TABULAR = [name for name in NAMES if not re.match(r"op\d+_|pipeline", name)]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def connection():
    return check_oracle.connect(FOLDER)


def test_every_query_has_its_sql():
    assert set(SQL) <= set(registry.queries())
    assert all(re.match(r"op\d+_|pipeline", name) for name in set(registry.queries()) - set(SQL))


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_as_duckdb(spark, connection, name):
    assert check_oracle.compare(spark, connection, FOLDER, name) == ""


@pytest.mark.parametrize("name", TABULAR)
def test_plan_scales(spark, name):
    """Even when no side is small enough to broadcast, nothing is paired with everything or run in Python."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = registry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    for operator in ["CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "InArrow", "SortAggregate"]:
        assert operator not in plan
    # Rows reach a single partition only as partial aggregates or limits, or as one row per month or status.
    for parent in re.findall(r"Exchange SinglePartition.*\n[^\w]*(?:\*\(\d+\) )?(\w+)", plan):
        assert parent in {"HashAggregate", "LocalLimit", "Project"}, parent


ZONED = ["delivery_peak_hour", "customer_order_gaps", "view_store_daily_performance", "mv_monthly_city_revenue",
         "clean_table", "sales_weekday_weekend", "source_csv_deliveries", "audit_delivery_clock"]


@pytest.mark.parametrize("name", ZONED)
def test_no_result_depends_on_the_session_time_zone(spark, connection, name):
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        assert check_oracle.compare(spark, connection, FOLDER, name) == ""
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_entry(spark):
    df = registry.entry(spark)
    assert df.columns == ["store_id", "store_name", "total_revenue", "fill_rate_pct", "sla_pct", "cancellation_rate_pct"]
    assert df.count() == 10
