"""The six metrics. Each has a form over trips and one over rollups, with equal answers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from farebox.operators.rollups import MEASURES

FACT, ROLLUP = "fact", "rollup"
UNDATED = "undated"  # a rollup whose rows hold a set of days in place of a date


def where(condition: Column | None, value: Column) -> Column:
    return value if condition is None else F.when(condition, value)


class Measures:
    """Sums and counts of one table form, optionally restricted by a condition inside the aggregate."""

    def __init__(self, form: str, condition: Column | None = None) -> None:
        self.form, self.condition = form, condition

    def trips(self) -> Column:
        if self.form == FACT:
            return F.count(where(self.condition, F.lit(1)))
        return F.sum(where(self.condition, F.col("trips")))

    def days(self) -> Column:
        if self.form == UNDATED:
            return F.bitmap_count(F.bitmap_or_agg(where(self.condition, F.col("days"))))
        return F.count_distinct(where(self.condition, F.col("pickup_date")))

    def valid(self, index: int) -> Column:
        flag, _, count, _ = MEASURES[index]
        if self.form == FACT:
            return F.count(where(self.condition, F.when(F.col(flag), 1)))
        return F.sum(where(self.condition, F.col(count)))

    def total(self, index: int) -> Column:
        flag, value, _, summed = MEASURES[index]
        if self.form == FACT:
            return F.sum(where(self.condition, F.when(F.col(flag), F.col(value))))
        # A rollup stores 0 for "no valid rows"; the answer is still no data.
        return F.when(self.valid(index) > 0, F.sum(where(self.condition, F.col(summed))))

    def mean(self, index: int) -> Column:
        return F.try_divide(self.total(index).cast("double"), self.valid(index))

    def left_out(self, index: int) -> Column:
        return self.trips() - self.valid(index)


class DailyMeasures(Measures):
    """Over a frame with one row per day: days are counted, not made distinct again."""

    def __init__(self, condition: Column | None = None) -> None:
        super().__init__(ROLLUP, condition)

    def days(self) -> Column:
        return F.count(where(self.condition, F.col("pickup_date")))


@dataclass(frozen=True)
class Metric:
    key: str
    label: str
    unit: str
    value: Callable[[Measures], Column]
    measure: int | None = None  # which valid value it rests on
    reason: str | None = None

    def excluded(self, m: Measures) -> Column:
        return F.lit(0).cast("long") if self.measure is None else m.left_out(self.measure)


METRICS: dict[str, Metric] = {
    m.key: m
    for m in (
        Metric("total_trips", "Total trips", "trips", lambda m: m.trips()),
        Metric("avg_daily_trips", "Trips per day", "trips", lambda m: F.try_divide(m.trips(), m.days())),
        Metric(
            "total_recorded_amount", "Total recorded amount", "usd", lambda m: m.total(0), 0,
            "Implausible amount",
        ),
        Metric(
            "avg_total_amount", "Average total amount per trip", "usd", lambda m: m.mean(0), 0,
            "Implausible amount",
        ),
        Metric(
            "avg_trip_distance", "Average trip distance", "miles", lambda m: m.mean(1), 1,
            "Implausible distance",
        ),
        Metric(
            "avg_trip_duration_minutes", "Average trip duration", "minutes", lambda m: m.mean(2), 2,
            "Implausible duration",
        ),
    )
}
