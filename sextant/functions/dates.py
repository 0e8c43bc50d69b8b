"""Dates and times. Bad values become null, never errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_A_DAY = 86_400_000_000


def parse_iso_date(x: Column) -> Column:
    """The date that a text begins with as yyyy-MM-dd, whatever follows; null if there is none or it doesn't exist."""
    return F.try_to_date(F.regexp_extract(F.trim(x), r"^\d{4}-\d{2}-\d{2}", 0), "yyyy-MM-dd")


def parse_effective_date(day_month_year: Column, year_month: Column) -> Column:
    """dd/MM/yyyy, or else the first day of yyyyMM."""
    first = F.when(year_month.rlike(r"^\d{6}$"), F.try_to_date(F.concat(year_month, F.lit("01")), "yyyyMMdd"))
    return F.coalesce(F.when(day_month_year.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(day_month_year, "d/M/yyyy")), first)


def month(x: Column) -> Column:
    return F.date_format(x, "yyyy-MM")


def month_start(x: Column) -> Column:
    return F.trunc(x, "MM")


def micros(x: Column) -> Column:
    return F.unix_micros(x.cast("timestamp"))


def floor_days(later: Column, earlier: Column) -> Column:
    """Whole days between two points of time, rounded down (not the difference of calendar days)."""
    return F.floor((micros(later) - micros(earlier)) / F.lit(MICROS_A_DAY)).cast("int")


def midpoint(a: Column, b: Column, otherwise: Column) -> Column:
    middle = F.timestamp_micros(F.expr("0") + F.floor((micros(a) + micros(b)) / 2).cast("long"))
    return F.coalesce(middle, otherwise.cast("timestamp"))


def in_range(day: Column, start: Column, end: Column) -> Column:
    """Closed interval; a null end is open."""
    return (start.isNull() | (day >= start)) & (end.isNull() | (day <= end))
