"""Calendar expressions on timestamps without a zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000


_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"


def moment_of(text: Column) -> Column:
    """A timestamp from text in one of the layouts below, each with or without a time; NULL from anything else.

    ``2026-05-16`` (ISO), ``20260516``, ``05/16/2026`` (month first), ``16-May-2026`` or ``16 May 2026``.  All are turned
    into ISO text first, so the session's time zone plays no part.
    """
    text = F.trim(text)
    compact = F.regexp_replace(text, r"^([0-9]{4})([0-9]{2})([0-9]{2})(?![0-9])", "$1-$2-$3")
    slashes = F.regexp_replace(compact, r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})", "$3-$1-$2")
    named = r"^([0-9]{1,2})[- ]([A-Za-z]{3})[A-Za-z]*[- ]([0-9]{4})(.*)$"
    place = F.instr(F.lit(_MONTHS), F.lower(F.regexp_extract(text, named, 2)))
    by_name = F.concat(
        F.regexp_extract(text, named, 3), F.lit("-"), ((place + 2) / 3).cast("int").cast("string"), F.lit("-"),
        F.regexp_extract(text, named, 1), F.regexp_extract(text, named, 4),
    )
    iso = F.when(text.rlike(named), F.when(place % 3 == 1, by_name)).otherwise(slashes)
    return iso.try_cast("timestamp_ntz")


def month_start(moment: Column) -> Column:
    """First day of the month.  Grouping by this date is cheaper than by its text, which is made once per group."""
    return F.trunc(F.to_date(moment), "month")


def year_month(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def day_type(moment: Column) -> Column:
    """Spark numbers Sunday 1 and Saturday 7."""
    return F.when(F.dayofweek(moment).isin(1, 7), "Weekend").otherwise("Weekday")


def days_between(later: Column, earlier: Column) -> Column:
    """Fractional days; whole-day differences would lose the time of day."""
    return F.timestamp_diff("MICROSECOND", earlier, later) / F.lit(float(MICROS_PER_DAY))


def plus_seconds(moment: Column, seconds: Column) -> Column:
    return F.timestamp_add("SECOND", seconds, moment)
