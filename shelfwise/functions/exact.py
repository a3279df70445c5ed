"""Exact money and ratio arithmetic.

Sums of money stay decimal, so they do not depend on the order in which executors add them.  Ratios
are rounded half up from whole numbers, so the last digit does not depend on floating point either.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cents(amount: Column) -> Column:
    """A decimal amount with two places, as a whole number of cents."""
    return (amount * 100).cast("decimal(38,0)")


def ratio(part: Column, whole: Column, digits: int = 2, kind: str = "decimal(38,0)") -> Column:
    """``part / whole`` for whole numbers, rounded half away from zero; NULL when ``whole`` is 0.

    ``kind`` is the type of the intermediate products.  The default holds sums of any table; rows
    whose values are known to be small may use ``bigint``, which stays in machine words.
    """
    part, whole = part.cast(kind), F.nullif(whole.cast(kind), F.lit(0).cast(kind))
    scaled = F.abs(part) * F.lit(2 * 10**digits).cast(kind) + F.abs(whole)
    divisor = F.abs(whole) * F.lit(2).cast(kind)
    # Without its remainder the division comes out even.  (DIV would do, but it returns a long and wraps.)
    quotient = (scaled - scaled % divisor) / divisor if kind != "bigint" else F.call_function("div", scaled, divisor)
    sign = F.when((part < 0) != (whole < 0), F.lit(-1)).otherwise(F.lit(1))
    return (quotient * sign).cast("double") / F.lit(float(10**digits))


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return ratio(part.cast("decimal(38,0)") * 100, whole, digits)


def mean(total: Column, count: Column, digits: int = 2) -> Column:
    """Rounded mean of whole numbers from their sum and count."""
    return ratio(total, count, digits)


def mean_money(total: Column, count: Column) -> Column:
    """Rounded mean amount from a decimal sum and a count."""
    return ratio(cents(total), count.cast("decimal(38,0)") * 100)


def money(amount: Column) -> Column:
    return amount.cast("double")


def share(part: Column, whole: Column) -> Column:
    """Unrounded fraction, NULL when ``whole`` is 0."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def count_where(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).cast("bigint")


def sum_where(condition: Column, value: Column) -> Column:
    """Sum over matching rows; NULL when none match."""
    return F.sum(F.when(condition, value))
