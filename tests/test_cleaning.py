"""The cleaning steps, one at a time and together."""

import datetime as dt
from decimal import Decimal

from conftest import rows

from shelfwise.operators import cleaning


def test_rows_equal_only_after_trimming_both_stay(spark):
    df = spark.createDataFrame([(1, "A", "a@b", 1), (1, "A ", "a@b", 1), (1, "A", "a@b", 1)],
                               "customer_id int, full_name string, email string, city_id int")
    assert rows(cleaning.clean_table(df, "customers")) == [(1, "A", "a@b", 1), (1, "A", "a@b", 1)]


def test_any_white_space_is_stripped_and_only_email_is_lower_cased(spark):
    df = spark.createDataFrame([("\t  Ann Lee  \n\x1f", " A@B.Com ")], "full_name string, email string")
    assert rows(cleaning.clean_text(df, "customers")) == [("Ann Lee", "a@b.com")]


def test_missing_text_stays_missing_and_drops_the_row(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "b", 1)], "customer_id int, email string, city_id int")
    assert rows(cleaning.clean_table(df, "customers")) == [(2, "b", 1)]


def test_bad_dates_become_null(spark):
    df = spark.createDataFrame([(1, "2024-01-05", "2024-01-05 10:00:00"), (2, "soon", "2024-13-01"), (3, None, None)],
                               "id int, signup_date string, order_datetime string")
    assert rows(cleaning.parse_dates(df, "customers").select("id", "signup_date")) == [
        (1, dt.date(2024, 1, 5)), (2, None), (3, None)]
    assert rows(cleaning.parse_dates(df, "orders").select("id", "order_datetime")) == [
        (1, dt.datetime(2024, 1, 5, 10)), (2, None), (3, None)]


def test_a_required_date_that_is_bad_drops_the_row(spark):
    df = spark.createDataFrame([(1, 1, "bad", None), (1, 1, "2024-01-01", None)],
                               "store_id int, product_id int, stock_date string, units_wasted int")
    assert rows(cleaning.clean_table(df, "inventory")) == [(1, 1, dt.date(2024, 1, 1), 0)]


def test_defaults_apply_to_any_table_that_has_the_column(spark):
    df = spark.createDataFrame([(1, None), (2, 5)], "promo_id int, discount_pct int")
    assert rows(cleaning.clean_table(df, "promotions")) == [(1, 0), (2, 5)]


def test_default_of_a_decimal_column(spark):
    df = spark.createDataFrame([(1, None), (2, Decimal("5.50"))], "promo_id int, discount_pct decimal(5,2)")
    assert rows(cleaning.fill_defaults(df)) == [(1, Decimal("0.00")), (2, Decimal("5.50"))]


def test_report_counts(spark):
    df = spark.createDataFrame(
        [(1, 1, 1, "Placed"), (1, 1, 1, "Placed"), (1, 1, 1, "Placed"), (2, 1, 1, None), (None, 1, 1, "Placed")],
        "order_id int, customer_id int, store_id int, order_status string")
    assert rows(cleaning.report_table(df, "orders")) == [("orders", 5, 2, 2, 1)]
    assert rows(cleaning.report_table(df.limit(0), "orders")) == [("orders", 0, 0, 0, 0)]
    assert cleaning.clean_table(df, "orders").count() == 1


def test_tables_without_rules_are_only_deduplicated(spark):
    df = spark.createDataFrame([(1, None), (1, None)], "city_id int, tier string")
    assert rows(cleaning.clean_table(df, "cities")) == [(1, None)]
    assert rows(cleaning.report_table(df, "cities")) == [("cities", 2, 1, 0, 1)]
