"""Registry: the flagship query, every query by name, and its SQL for an independent engine."""

from __future__ import annotations

import importlib.util
import os
import sys
import uuid
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle.queries import oracle_sql as _oracle_sql  # noqa: E402
from shelfwise.catalog import CATALOG, Question  # noqa: E402
from shelfwise.functions.exact import money  # noqa: E402
from shelfwise.operators import audits, cleaning, dashboard, delivery  # noqa: E402
from shelfwise.operators.offenders import Offenders, quarantined  # noqa: E402
from shelfwise.plans import jobs, lasting, refresh, views  # noqa: E402
from shelfwise.session import shared_folder  # noqa: E402
from shelfwise.sources import dirty  # noqa: E402
from shelfwise.sources.files import (  # noqa: E402
    BASE_TABLES, read_csv, read_csv_inferred, read_table, save_tables, write_csv, write_table,
)
from shelfwise.sources.grading import grading_tables  # noqa: E402
from shelfwise.sources.tables import Tables  # noqa: E402

# The operators for training data come as a whole or not at all: the library works without their subpackage, and without
# the packages that only they need.
_LLM_QUERIES, _LLM_SQL = {}, {}
if importlib.util.find_spec("shelfwise.llm") and importlib.util.find_spec("corpus_pipeline"):
    try:
        import corpus_pipeline
        from shelfwise.llm import queries as _llm
    except ImportError as missing:
        warnings.warn(f"no queries for training data: {missing}", stacklevel=1)
    else:
        _LLM_QUERIES = {**_llm.QUERIES, "pipeline": corpus_pipeline.run}
        _LLM_SQL = {**_llm.SQL, **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})}

# The cleaner and the audits on deliberately dirty tables.
DIRTY: dict[str, Question] = {
    "clean_dedup": lambda t: _plain_money(cleaning.drop_duplicates(dirty.dirty_orders(t))),
    "clean_text": lambda t: cleaning.clean_text(dirty.dirty_customers(t), "customers").select(
        "customer_id", "full_name", "email"
    ),
    "clean_dates": lambda t: cleaning.parse_dates(dirty.dirty_orders(t), "orders").select(
        "order_id", "order_datetime"
    ),
    "clean_required": lambda t: cleaning.drop_missing_required(
        cleaning.parse_dates(dirty.dirty_inventory(t), "inventory"), "inventory"
    ).select("store_id", "product_id", "stock_date", "closing_stock"),
    "clean_defaults": lambda t: cleaning.fill_defaults(dirty.dirty_inventory(t)).select(
        "store_id", "product_id", "stock_date", "closing_stock", "units_received", "units_sold", "units_wasted"
    ),
    "clean_table": lambda t: _plain_money(cleaning.clean_table(dirty.dirty_orders(t), "orders")),
    "clean_table_customers": lambda t: cleaning.clean_table(dirty.dirty_customers(t), "customers"),
    "clean_table_inventory": lambda t: cleaning.clean_table(dirty.dirty_inventory(t), "inventory"),
    "clean_report": lambda t: cleaning.report(_all_dirty(t), BASE_TABLES),
    "apply_defaults": lambda t: audits.apply_defaults(dirty.dirty_inventory(t), "inventory").select(
        "store_id", "product_id", "stock_date", "closing_stock", "reorder_level", "units_received", "units_sold",
        "units_wasted",
    ),
    "audit_pk_dirty": lambda t: audits.primary_keys(t.replaced(orders=dirty.dirty_orders(t))),
    "audit_fk_dirty": lambda t: audits.foreign_keys(_bad_refs(t)),
    "audit_unique_dirty": lambda t: audits.unique_keys(
        _all_dirty(t).replaced(monthly_city_revenue=views.monthly_city_revenue(t))
    ),
    "audit_domain_dirty": lambda t: audits.domains(_bad_refs(t)),
    "audit_range_dirty": lambda t: audits.ranges(_bad_refs(t)),
    "audit_length_dirty": lambda t: audits.text_lengths(t.replaced(customers=dirty.long_customers(t))),
    "audit_not_null_dirty": lambda t: audits.not_null(_all_dirty(t)),
    **{
        f"{name}_all_products": lambda t, name=name: CATALOG[name](t.replaced(inventory=dirty.all_products_stock(t)))
        for name in ["inventory_wastage_rank", "inventory_demand_tiers"]
    },
    "dash_store_scorecard_dirty": lambda t: dashboard.store_scorecard(_delivered_again(t)),
    "dash_store_matrix_by_city_dirty": lambda t: dashboard.store_matrix_by_city(_delivered_again(t)),
    "view_store_daily_performance_dirty": lambda t: views.store_daily_performance(_delivered_again(t)),
    "delivery_peak_hour_dirty": lambda t: delivery.peak_hour(_delivered_again(t)),
    "sample_preview_orphans": lambda t: dashboard.sample_preview(t.replaced(customers=dirty.without_some_customers(t))),
    "audit_delivery_status_dirty": lambda t: audits.count_rule(
        audits.delivery_status(t.replaced(deliveries=dirty.broken_deliveries(t))), "delivery status", "deliveries"
    ),
    "audit_delivery_clock_dirty": lambda t: audits.count_rule(
        audits.delivery_clock(t.replaced(deliveries=dirty.broken_deliveries(t))), "delivery clock", "deliveries"
    ),
    "audit_payment_dirty": lambda t: audits.count_rule(
        audits.payment(t.replaced(payments=dirty.broken_payments(t))), "payment", "payments"
    ),
    "audit_returns_dirty": lambda t: audits.count_rule(
        audits.returns(t.replaced(returns=dirty.broken_returns(t))), "returns", "returns"
    ),
    "audit_stock_balance_dirty": lambda t: audits.count_rule(
        audits.stock_balance(_all_dirty(t)), "stock balance", "inventory"
    ),
}

# The questions that count distinct ids, on tables in which ids repeat.
REPEATED: dict[str, Question] = {
    **{
        f"{name}_repeated_orders": lambda t, name=name: CATALOG[name](t.replaced(orders=dirty.repeated_orders(t)))
        for name in [
            "kpi_revenue_by_city", "kpi_orders_by_place", "sales_weekday_weekend", "sales_promo_effectiveness",
            "delivery_peak_hour", "view_store_daily_performance", "mv_monthly_city_revenue",
        ]
    },
    "kpi_return_rate_repeated_items": lambda t: CATALOG["kpi_return_rate"](t.replaced(
        orders=dirty.repeated_orders(t), order_items=dirty.repeated_items(t), returns=dirty.repeated_returns(t)
    )),
    "customer_city_engagement_repeated_customers": lambda t: CATALOG["customer_city_engagement"](
        t.replaced(customers=dirty.repeated_customers(t))
    ),
}

# Offending rows of the schema's constraints, once for each rule they break.
OFFENDERS: dict[str, Question] = {
    "audit_rows_orders_dirty": lambda t: Offenders(t.replaced(orders=dirty.dirty_orders(t)), ["orders"])
    .by_rule("orders").select("rule", "order_id", "customer_id", "order_datetime", "order_status"),
    "audit_rows_refs_dirty": lambda t: Offenders(_bad_refs(t), ["orders"])
    .by_rule("orders").select("rule", "order_id", "customer_id", "store_id", "promo_id", "order_status"),
    "audit_rows_inventory_dirty": lambda t: Offenders(_all_dirty(t), ["inventory"])
    .by_rule("inventory").select("rule", "inventory_id", "store_id", "product_id", "stock_date", "closing_stock"),
    "audit_rows_customers_dirty": lambda t: Offenders(t.replaced(customers=dirty.repeated_customers(t)), ["customers"])
    .by_rule("customers").select("rule", "customer_id", "city_id", "email", "is_active"),
    "audit_rows_summary": lambda t: Offenders(t).summary(),
    "audit_rows_summary_dirty": lambda t: Offenders(_every_kind_of_dirt(t)).summary(),
}


def _every_kind_of_dirt(t: Tables) -> Tables:
    return t.replaced(
        orders=dirty.dirty_refs(t), customers=dirty.without_some_customers(t), inventory=dirty.dirty_inventory(t),
        deliveries=dirty.dirty_deliveries(t), order_items=dirty.repeated_items(t), returns=dirty.repeated_returns(t),
    )


def _plain_money(df: DataFrame) -> DataFrame:
    return df.withColumn("total_amount", money(df["total_amount"]))


def _all_dirty(t: Tables) -> Tables:
    return t.replaced(
        orders=dirty.dirty_orders(t), customers=dirty.dirty_customers(t), inventory=dirty.dirty_inventory(t)
    )


def _bad_refs(t: Tables) -> Tables:
    return t.replaced(orders=dirty.dirty_refs(t))


def _delivered_again(t: Tables) -> Tables:
    return t.replaced(deliveries=dirty.dirty_deliveries(t))


def _scratch(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def _refresh_dashboard(spark: SparkSession, folder: str) -> DataFrame:
    path = jobs.refresh_monthly_city_revenue(spark, grading_tables(spark, folder), _scratch(spark))
    return views.shown(spark.read.parquet(path))


def _refresh_months(spark: SparkSession, folder: str) -> DataFrame:
    t, target = grading_tables(spark, folder), _scratch(spark)
    for name in ["cities", "dark_stores", "orders"]:
        write_table(t[name], f"{target}/stored", name)
    first = jobs.refresh_monthly_city_revenue(spark, t, target)
    path = jobs.refresh_stored_months(spark, f"{target}/stored", target, ["1997-03", "1998-11"], first)
    return views.shown(spark.read.parquet(path))


def _refresh_changed(spark: SparkSession, folder: str) -> DataFrame:
    """Two refreshes of stored tables, between which a month gets more orders; the second finds it by itself."""
    t, target = grading_tables(spark, folder), _scratch(spark)
    for name in refresh.SOURCES:
        write_table(t[name], f"{target}/stored", name)
    refresh.refresh_changed(spark, f"{target}/stored", f"{target}/versions")
    more = dirty.more_orders(t, "1997-03").withColumn("month", F.lit("1997-03"))
    more.write.mode("append").partitionBy("month").parquet(f"{target}/stored/orders")
    found = refresh.refresh_changed(spark, f"{target}/stored", f"{target}/versions")
    if found.months != ["1997-03"]:
        raise AssertionError(f"months found: {found.months}")
    return views.shown(refresh.table_of(spark, found.path))


def _flag_again(spark: SparkSession, folder: str) -> DataFrame:
    """A run that is tried twice, and one more run."""
    t, target = grading_tables(spark, folder), _scratch(spark)
    for run in ["first", "first", "second"]:
        path = jobs.flag_low_stock(t, target, run)
    return jobs.read_alerts(spark, path).drop("flagged_at")


def _flag_low_stock(spark: SparkSession, folder: str) -> DataFrame:
    path = jobs.flag_low_stock(grading_tables(spark, folder), _scratch(spark))
    return jobs.read_alerts(spark, path).drop("flagged_at")


def _lasting_view(name: str) -> Callable[[SparkSession, str], DataFrame]:
    """A view over stored tables, read in a session that knows nothing but the catalog."""

    def read(spark: SparkSession, folder: str) -> DataFrame:
        database = f"shelfwise_{uuid.uuid4().hex}"
        spark.sql(f"CREATE DATABASE {database} LOCATION '{_scratch(spark)}'")
        save_tables(grading_tables(spark, folder), database, 8, lasting.SOURCES)
        lasting.create_views(spark, database)
        return spark.newSession().table(f"{database}.{name}")

    return read


def _through_csv(spark: SparkSession, folder: str) -> DataFrame:
    target = _scratch(spark)
    write_csv(grading_tables(spark, folder)["deliveries"], target, "deliveries")
    return read_csv(spark, target, "deliveries").withColumns(
        {c: F.col(c).cast("bigint") for c in ["promised_time_mins", "actual_time_mins"]}
    )


def _clean_messy_orders(spark: SparkSession, folder: str) -> tuple[DataFrame, str]:
    source, target = _scratch(spark), _scratch(spark)
    dirty.messy_orders(grading_tables(spark, folder)).write.csv(f"{source}/orders.csv", header=True, escape='"')
    dirty.messy_cities(grading_tables(spark, folder)).write.csv(f"{source}/cities.csv", header=True, escape='"')
    return cleaning.clean_csv_folder(spark, source, target), target


def _cleaned_orders(spark: SparkSession, folder: str) -> DataFrame:
    _, target = _clean_messy_orders(spark, folder)
    return _plain_money(read_table(spark, target, "orders"))


def _clean_rejects(spark: SparkSession, folder: str) -> DataFrame:
    _, target = _clean_messy_orders(spark, folder)
    return cleaning.rejected(spark, target, "orders").select("order_id", F.col(cleaning.REJECTED).alias("reason"))


def _clean_folder_report(spark: SparkSession, folder: str) -> DataFrame:
    return _clean_messy_orders(spark, folder)[0]


def _through_reordered_csv(spark: SparkSession, folder: str) -> DataFrame:
    target = _scratch(spark)
    products = grading_tables(spark, folder)["products"]
    write_csv(products.select(*reversed(products.columns)), target, "products")
    return read_csv(spark, target, "products").withColumns({c: money(F.col(c)) for c in ["unit_price", "unit_cost"]})


def _inferred(spark: SparkSession, folder: str) -> DataFrame:
    target = _scratch(spark)
    dirty.unknown_text(grading_tables(spark, folder)).write.csv(f"{target}/unknown.csv", header=True, escape='"')
    return read_csv_inferred(spark, f"{target}/unknown.csv")


def _through_parquet(spark: SparkSession, folder: str) -> DataFrame:
    target = _scratch(spark)
    stock = grading_tables(spark, folder)["inventory"]
    write_table(stock, target, "inventory")
    return read_table(spark, target, "inventory")


def _audit_alerts(spark: SparkSession, folder: str) -> DataFrame:
    path = jobs.flag_low_stock(grading_tables(spark, folder), _scratch(spark))
    return audits.primary_keys(Tables.of(low_stock_alerts=jobs.read_alerts(spark, path)), ["low_stock_alerts"])


def _quarantine(spark: SparkSession, folder: str) -> DataFrame:
    t, target = _bad_refs(grading_tables(spark, folder)), _scratch(spark)
    Offenders(t, ["orders"]).quarantine(target)
    written = quarantined(spark, target, "orders", t["orders"].schema, "customer_id in customers")
    return written.select("rule", "order_id", "customer_id", "order_status")


def entry(spark: SparkSession) -> DataFrame:
    """The store scorecard: four measures from orders, deliveries and stock for every store."""
    return dashboard.store_scorecard(grading_tables(spark, "/root/testdata/sf0.001"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bound(question: Question) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: question(grading_tables(spark, folder))

    return {
        **{name: bound(question) for name, question in {**CATALOG, **DIRTY, **REPEATED, **OFFENDERS}.items()},
        **{f"view_{name}_lasting": _lasting_view(name) for name in lasting.VIEWS},
        "source_csv_deliveries": _through_csv,
        "source_csv_reordered": _through_reordered_csv,
        "source_csv_inferred": _inferred,
        "source_parquet_inventory": _through_parquet,
        "source_clean_folder": _cleaned_orders,
        "clean_rejects": _clean_rejects,
        "clean_folder_report": _clean_folder_report,
        "job_refresh_dashboard": _refresh_dashboard,
        "job_refresh_months": _refresh_months,
        "job_refresh_changed": _refresh_changed,
        "job_flag_low_stock": _flag_low_stock,
        "job_flag_low_stock_retried": _flag_again,
        "audit_pk_alerts": _audit_alerts,
        "audit_rows_quarantine": _quarantine,
        **_LLM_QUERIES,
    }


def oracle_sql() -> dict[str, str]:
    return {**_oracle_sql(), **_LLM_SQL}
