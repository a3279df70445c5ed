"""Constraint audits and business rules on rows that break them."""

import datetime as dt
from decimal import Decimal

import pytest
from conftest import rows
from test_operators import CITIES, STORES, items, order, snapshot, tables

from shelfwise.operators import audits
from shelfwise.sources.files import BASE_TABLES
from shelfwise.sources.tables import Tables


def broken(df):
    """Rules with violations."""
    return {(r.rule, r.table_name): r.violations for r in df.collect() if r.violations}


def test_primary_keys(spark):
    t = tables(spark, orders=[order(1), order(1), order(1), order(None), order(2)],
               low_stock_alerts=[dict(store_id=1, product_id=1, flagged_at=dt.datetime(2024, 1, 1))] * 2)
    found = audits.primary_keys(t, [*BASE_TABLES, "low_stock_alerts"])
    assert found.count() == 14
    assert broken(found) == {
        ("primary key order_id", "orders"): 3, ("primary key store_id, product_id, flagged_at", "low_stock_alerts"): 1}


def test_a_rule_that_cannot_be_checked_does_not_pass(spark):
    t = tables(spark, orders=[order(1)])
    for check in (audits.primary_keys, audits.unique_keys):
        with pytest.raises(ValueError, match="not checked: orders has no column order_id|not checked: customers has no column email"):
            check(t.replaced(orders=t["orders"].drop("order_id"), customers=t["customers"].drop("email")))
    with pytest.raises(ValueError, match="not checked: there is no table cities"):
        audits.primary_keys(Tables.of(orders=t["orders"]), ["orders", "cities"])


def test_unique_keys_allow_missing_values(spark):
    people = [dict(customer_id=i, email=e) for i, e in enumerate(["a", "a", None, None, "b"])]
    t = tables(spark, customers=people, inventory=[snapshot(1, 1, "2024-01-01"), snapshot(1, 1, "2024-01-01")])
    assert broken(audits.unique_keys(t, BASE_TABLES)) == {
        ("unique email", "customers"): 1, ("unique store_id, product_id, stock_date", "inventory"): 1}


def test_foreign_keys_pass_missing_children(spark):
    t = tables(spark, cities=CITIES, dark_stores=STORES + [dict(store_id=4, store_name="S4", city_id=77)],
               customers=[dict(customer_id=1, city_id=1)],
               orders=[order(1), order(2, customer_id=5), order(3, customer_id=5, promo_id=9)])
    found = audits.foreign_keys(t)
    assert found.count() == 16
    assert broken(found) == {("city_id in cities", "dark_stores"): 1, ("customer_id in customers", "orders"): 2,
                             ("promo_id in promotions", "orders"): 1}


def test_domains_and_ranges_pass_missing_values(spark):
    t = tables(spark, orders=[order(1, status="Lost"), order(2, status=None), order(3, total="-0.01")],
               promotions=[dict(promo_id=1, discount_pct=Decimal("100.01")), dict(promo_id=2, discount_pct=None),
                           dict(promo_id=3, start_date=dt.date(2024, 1, 2), end_date=dt.date(2024, 1, 1))])
    assert broken(audits.domains(t)) == {("order_status domain", "orders"): 1}
    assert broken(audits.ranges(t)) == {
        ("total_amount range", "orders"): 1, ("discount_pct range", "promotions"): 1, ("end_date range", "promotions"): 1}
    assert broken(audits.not_null(t)) == {
        ("order_status not null", "orders"): 1, ("promo_code not null", "promotions"): 3,
        ("discount_pct not null", "promotions"): 2, ("start_date not null", "promotions"): 2,
        ("end_date not null", "promotions"): 2}


def test_defaults(spark):
    t = tables(spark, dark_stores=STORES[:1], inventory=[snapshot(1, 1, "2024-01-01", reorder=None, sold=None)])
    assert rows(audits.apply_defaults(t["dark_stores"], "dark_stores").select("is_active")) == [(True,)]
    assert rows(audits.apply_defaults(t["inventory"], "inventory").select("reorder_level", "units_sold")) == [(20, 0)]


def test_stock(spark):
    t = tables(spark, inventory=[
        snapshot(1, 1, "2024-01-01", opening=5, received=2, sold=3, closing=4),
        snapshot(1, 1, "2024-01-08", opening=4, sold=9, closing=0),
        snapshot(1, 1, "2024-01-15", opening=1, sold=1, closing=1)])
    assert rows(audits.stock_balance(t).select("stock_date")) == [(dt.date(2024, 1, 15),)]
    assert rows(audits.stock_continuity(t).select("stock_date")) == [(dt.date(2024, 1, 15),)]


@pytest.mark.parametrize("total, ok", [("0.13", True), ("0.12", True), ("0.14", False), ("0.11", False)])
def test_order_total_allows_either_rounding_of_half_a_cent(spark, total, ok):
    lines = [dict(order_item_id=1, order_id=1, product_id=1, quantity=1, unit_price=Decimal("0.25"), line_total=Decimal("0.25"))]
    t = tables(spark, orders=[order(1, total=total, promo_id=1)], order_items=lines,
               promotions=[dict(promo_id=1, discount_pct=Decimal(50))])
    assert audits.order_total(t).isEmpty() == ok


def test_order_without_lines_totals_zero(spark):
    t = tables(spark, orders=[order(1, total="0.00"), order(2, total="0.01")])
    assert rows(audits.order_total(t).select("order_id")) == [(2,)]


def test_line_total(spark):
    bad = items((1, 1, 2), (1, 1, 3))
    bad[1]["line_total"] = Decimal("3.01")
    assert rows(audits.line_total(tables(spark, order_items=bad)).select("order_item_id")) == [(1,)]


def delivery(order_id, status, actual=10, **more):
    return dict(delivery_id=order_id, order_id=order_id, promised_time_mins=10, actual_time_mins=actual, delivery_status=status, **more)


def test_delivery_status(spark):
    t = tables(
        spark, orders=[order(1), order(2), order(3), order(4, status="Returned"), order(5, status="Cancelled"),
                       order(6, status="Cancelled"), order(7, status="Placed"), order(8)],
        deliveries=[delivery(1, "Delivered", 15), delivery(2, "Delivered", 16), delivery(3, "Delayed", 16),
                    delivery(4, "Delivered"), delivery(5, "Cancelled", None), delivery(6, "Cancelled", 5),
                    delivery(7, "Delivered")])
    assert rows(audits.delivery_status(t).select("order_id")) == [(2,), (4,), (6,), (7,)]


def test_delivery_clock(spark):
    sent = dt.datetime(2024, 1, 1, 23, 55)
    t = tables(spark, deliveries=[
        delivery(1, "Delivered", 10, dispatched_at=sent, delivered_at=dt.datetime(2024, 1, 2, 0, 5)),
        delivery(2, "Cancelled", None, dispatched_at=sent),
        delivery(3, "Delivered", 10, dispatched_at=sent),
        delivery(4, "Delivered", 10, dispatched_at=sent, delivered_at=dt.datetime(2024, 1, 2, 0, 6))])
    assert rows(audits.delivery_clock(t).select("order_id")) == [(3,), (4,)]


def test_payment(spark):
    def pay(order_id, status, amount):
        return dict(payment_id=order_id, order_id=order_id, payment_method="UPI", payment_status=status, paid_amount=Decimal(amount))

    t = tables(spark, orders=[order(1), order(2), order(3, status="Cancelled"), order(4, status="Cancelled"), order(5)],
               payments=[pay(1, "Success", "10"), pay(2, "Success", "9"), pay(3, "Refunded", "0"), pay(4, "Success", "10"),
                         pay(5, "Failed", "0")])
    assert rows(audits.payment(t).select("order_id")) == [(2,), (4,), (5,)]


def test_geography_counts_orders(spark):
    t = tables(spark, dark_stores=STORES, customers=[dict(customer_id=1, city_id=1)],
               orders=[order(1), order(2, store_id=3), order(3, store_id=3), order(4)],
               deliveries=[dict(delivery_id=4, order_id=4, partner_id=1)],
               delivery_partners=[dict(partner_id=1, city_id=2)])
    assert rows(audits.geography_count(t)) == [("one city per order", "orders", 3)]


def test_returns(spark):
    lines = items((1, 1, 2), (1, 1, 2), (1, 1, 2), (2, 1, 2))

    def back(item, day, refund="2"):
        return dict(return_id=item, order_item_id=item, return_date=dt.date(2024, 1, day), refund_amount=Decimal(refund))

    t = tables(spark, orders=[order(1, status="Returned"), order(2)], order_items=lines,
               returns=[back(0, 10), back(1, 11), back(2, 6, "1"), back(3, 6)])
    assert rows(audits.returns(t).select("return_id")) == [(1,), (2,), (3,)]


def test_promo_window_includes_both_ends(spark):
    promo = dict(promo_id=1, start_date=dt.date(2024, 1, 1), end_date=dt.date(2024, 1, 2))
    t = tables(spark, promotions=[promo], orders=[
        order(1, promo_id=1, when="2024-01-01 00:00:00"), order(2, promo_id=1, when="2024-01-02 23:59:59"),
        order(3, promo_id=1, when="2024-01-03 00:00:00"), order(4), order(5, promo_id=1, when="2024-01-03 10:00:00")])
    assert rows(audits.promo_window(t).select("order_date", "orders")) == [(dt.date(2024, 1, 3), 2)]
    assert rows(audits.promo_window_count(t)) == [("promo window", "orders", 2)]
