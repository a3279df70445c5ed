"""Rounding and exact ratios."""

import random
from decimal import ROUND_HALF_UP, Decimal
from fractions import Fraction

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfwise.functions.exact import cents, mean_money, percent, ratio, share


def half_up(part, whole, digits):
    if whole == 0:
        return None
    scaled = Fraction(part, whole) * 10**digits
    sign = -1 if scaled < 0 else 1
    return sign * int((abs(scaled) + Fraction(1, 2)) // 1) / 10**digits


def check(spark, pairs, digits, kind="decimal(38,0)"):
    df = spark.createDataFrame(pairs, "part bigint, whole bigint")
    got = df.select(ratio(F.col("part"), F.col("whole"), digits, kind)).collect()
    assert [r[0] for r in got] == [half_up(p, w, digits) for p, w in pairs]


def test_ties_go_away_from_zero(spark):
    check(spark, [(1, 8), (-1, 8), (1, -8), (5, 1000), (-5, 1000), (0, 3), (0, -3), (1005, 1000)], 2)


def test_zero_divisor_is_null(spark):
    check(spark, [(1, 0), (0, 0)], 2)


def test_random_ratios(spark):
    rng = random.Random(1)
    pairs = [(rng.randint(-10**12, 10**12), rng.randint(-10**6, 10**6)) for _ in range(2000)]
    check(spark, pairs, 2)
    check(spark, pairs, 3)
    check(spark, [(p % 10**9, w) for p, w in pairs], 2, "bigint")


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(-10**15, 10**15), st.integers(-10**9, 10**9)), min_size=1, max_size=50))
def test_any_ratio(spark, pairs):
    check(spark, pairs, 2)


def test_sums_beyond_a_long(spark):
    df = spark.createDataFrame([(Decimal("99999999999999999999999"),)], "total decimal(30,0)")
    assert df.select(ratio(F.col("total"), F.lit(3), 2)).first()[0] == 99999999999999999999999 / 3


def test_money_mean_is_exact(spark):
    df = spark.createDataFrame([(Decimal("0.01"),), (Decimal("0.02"),)], "x decimal(12,2)")
    out = df.agg(mean_money(F.sum("x"), F.count("x")).alias("m")).first()
    assert out.m == float(Decimal("0.015").quantize(Decimal("0.01"), ROUND_HALF_UP))
    assert df.agg(F.sum(cents(F.col("x")))).first()[0] == 3


def test_percent_and_share(spark):
    df = spark.createDataFrame([(1, 3), (2, 0)], "a bigint, b bigint")
    out = df.select(percent(F.col("a"), F.col("b")), share(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in out] == [(33.33, 1 / 3), (None, None)]
