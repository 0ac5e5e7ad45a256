"""Dates and numbers as Spark column expressions. The session's time zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from narrata.operators.vectors import s_curve  # noqa: F401


def day_key(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def age_days(since: Column, now: Column) -> Column:
    """Whole days from one date to another."""
    return F.datediff(now, since)


def add_month_overflowing(day: Column) -> Column:
    """The same day of the next month; days that month lacks run on into the one after, as calendars that overflow do.

    31 January gives 3 March (2 in leap years); add_months() would give the end of February.
    """
    return F.date_add(F.add_months(F.trunc(day, "month"), 1), F.dayofmonth(day) - 1)


def proximity(distance: Column, scale: float = 1000.0) -> Column:
    return F.exp(-F.abs(distance) / scale)


def usage_units(cost: Column) -> Column:
    """Cost in units of a fifth of a thousandth, rounded up."""
    return F.ceil(cost * 5 * 1000).cast("bigint")


def backoff(attempt: Column, first: int = 1000, most: int = 30000) -> Column:
    """Exponential delay in milliseconds, up to a limit."""
    return F.least(first * F.pow(F.lit(2), attempt), F.lit(most)).cast("bigint")
