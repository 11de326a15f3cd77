"""Durations and month keys over zone-less timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_HOUR = 3_600_000_000.0
MICROS_PER_DAY = 86_400_000_000.0


def hours_between(end: str, start: str) -> Column:
    """Signed hours from ``start`` to ``end``; NULL when either is NULL."""
    return F.timestamp_diff("MICROSECOND", F.col(start), F.col(end)) / F.lit(MICROS_PER_HOUR)


def days_between(end: str, start: str) -> Column:
    """Signed days from ``start`` to ``end``; NULL when either is NULL."""
    return F.timestamp_diff("MICROSECOND", F.col(start), F.col(end)) / F.lit(MICROS_PER_DAY)


def month_start(ts: str | Column) -> Column:
    """First day of the month as a DATE."""
    return F.trunc(ts, "MM")


def months_between_starts(first: Column, later: Column) -> Column:
    """Whole months from one month start to another."""
    years = F.year(later) - F.year(first)
    return years * 12 + F.month(later) - F.month(first)
