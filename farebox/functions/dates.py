"""Months, ranges and date words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def yyyymm(day: Column) -> Column:
    return F.year(day) * 100 + F.month(day)


def month_start(day: Column) -> Column:
    return F.trunc(day, "month")


def month_end_exclusive(day: Column) -> Column:
    return F.add_months(F.trunc(day, "month"), 1)


def month_label(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def overlaps(first: Column, last: Column, start: Column, end: Column) -> Column:
    """Whether [first, last] and [start, end] share a day."""
    return (last >= start) & (first <= end)


def window_start(end: Column, days: int = 30) -> Column:
    """First day of the `days` days that end on `end`."""
    return F.date_sub(end, days - 1)


def date_words(day: Column) -> Column:
    return F.coalesce(F.date_format(day, "MMM d, yyyy"), F.lit("—"))


def date_range(start: Column, end: Column) -> Column:
    short = F.date_format(start, "MMM d")
    return (
        F.when(start == end, date_words(start))
        .when(
            F.year(start) == F.year(end),
            F.concat(short, F.lit(" – "), F.date_format(end, "MMM d"), F.lit(", "), F.year(end).cast("string")),
        )
        .otherwise(F.concat(date_words(start), F.lit(" – "), date_words(end)))
    )


def span_words(start: Column, end: Column) -> Column:
    first = F.when(F.year(start) == F.year(end), F.date_format(start, "MMM d")).otherwise(date_words(start))
    return F.when(start == end, F.concat(F.lit("on "), date_words(start))).otherwise(
        F.concat(F.lit("from "), first, F.lit(" to "), date_words(end))
    )
