"""The one filter model every question shares, as a Column."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, fields, replace
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farebox.schema import FLAGS, MAX_ZONE_ID

# Filter name -> (column, smallest, largest value). The ranges of codes, hours and weekdays.
LISTS: dict[str, tuple[str, int, int]] = {
    "pickup_zone": ("pickup_location_id", 1, MAX_ZONE_ID),
    "dropoff_zone": ("dropoff_location_id", 1, MAX_ZONE_ID),
    "payment_type": ("payment_type", 0, 6),
    "vendor_id": ("vendor_id", 1, 99),
    "hour": ("pickup_hour", 0, 23),
    "weekday": ("pickup_day_of_week", 1, 7),
}


@dataclass(frozen=True)
class TripFilter:
    start: date | None = None
    end: date | None = None
    pickup_zone: tuple[int, ...] = ()
    dropoff_zone: tuple[int, ...] = ()
    payment_type: tuple[int, ...] = ()
    vendor_id: tuple[int, ...] = ()
    hour: tuple[int, ...] = ()
    weekday: tuple[int, ...] = ()
    min_distance: float | None = None
    max_distance: float | None = None

    def __post_init__(self) -> None:
        for name, (_, low, high) in LISTS.items():
            values = tuple(sorted(set(getattr(self, name))))
            if any(isinstance(v, bool) or not low <= v <= high for v in values):
                raise ValueError(f"{name} takes values from {low} to {high}")
            object.__setattr__(self, name, values)
        for bound in (self.min_distance, self.max_distance):
            if bound is not None and not 0 <= bound <= 1000:
                raise ValueError("distances run from 0 to 1000")
        if self.start and self.end and self.end < self.start:
            raise ValueError("end must not be before start")
        if None not in (self.min_distance, self.max_distance) and self.max_distance < self.min_distance:
            raise ValueError("max_distance must not be less than min_distance")

    def active(self) -> frozenset[str]:
        """Names of the filters in use; what a table must be able to apply."""
        names = {n for n in LISTS if getattr(self, n)}
        if self.start or self.end:
            names.add("date")
        if self.min_distance is not None or self.max_distance is not None:
            names.add("distance")
        return frozenset(names)

    def between(self, start: date | None, end: date | None) -> TripFilter:
        return replace(self, start=start, end=end)

    def dates_only(self) -> TripFilter:
        return TripFilter(start=self.start, end=self.end)

    def days(self) -> int | None:
        return (self.end - self.start).days + 1 if self.start and self.end else None

    def previous(self) -> TripFilter:
        """Same filters over the equally long window just before this one."""
        days = self.days()
        if days is None:
            raise ValueError("a previous period needs a start and an end")
        return self.between(self.start - timedelta(days=days), self.start - timedelta(days=1))

    def conditions(self) -> list[Column]:
        """A NULL in a filtered column never matches. Long lists become one set lookup, at most one entry per zone id."""
        found = []
        if self.start:
            found.append(F.col("pickup_date") >= F.lit(self.start))
        if self.end:
            found.append(F.col("pickup_date") <= F.lit(self.end))
        for name, (column, *_) in LISTS.items():
            if getattr(self, name):
                found.append(F.col(column).isin(*getattr(self, name)))
        if self.min_distance is not None:
            found.append(F.col("trip_distance") >= float(self.min_distance))
        if self.max_distance is not None:
            found.append(F.col("trip_distance") <= float(self.max_distance))
        return found


assert {f.name for f in fields(TripFilter)} >= set(LISTS)


def keep(df: DataFrame, conditions: Iterable[Column]) -> DataFrame:
    conditions = list(conditions)
    return df.filter(reduce(lambda a, b: a & b, conditions)) if conditions else df


def listed(df: DataFrame, name: str, values: DataFrame) -> DataFrame:
    """Rows whose filtered column (see LISTS) is among the first column of `values`; for lists too long for a TripFilter.

    Any value may be listed, repeated and NULL ones too; a NULL matches nothing. A semi-join on the distinct values: Spark
    broadcasts a list below its own size limit, and sends a longer one through a shuffle, to which it adds a Bloom filter
    of the list on the scan where `spark.sql.optimizer.runtime.bloomFilter` settings find it worth its cost.
    """
    column = LISTS[name][0]
    wanted = values.select(F.col(values.columns[0]).cast(df.schema[column].dataType).alias("_wanted")).distinct()
    return df.join(wanted, F.col(column) == F.col("_wanted"), "left_semi")


def month_bounds(f: TripFilter) -> list[Column]:
    """The same dates on the partition column, so whole months are pruned before the scan.

    Published rows always lie in their month, so this removes no matching row.
    """
    found = []
    if f.start:
        found.append(F.col("data_period") >= F.lit(f.start.replace(day=1)))
    if f.end:
        found.append(F.col("data_period") <= F.lit(f.end.replace(day=1)))
    return found


def apply(df: DataFrame, f: TripFilter) -> DataFrame:
    bounds = month_bounds(f) if "data_period" in df.columns else []
    return keep(df, [*bounds, *f.conditions()])


def published_in(df: DataFrame, periods: DataFrame) -> DataFrame:
    """The same with the periods as a table (one row per month): partitions are pruned at run time."""
    months = periods.select("taxi_type", "data_period").distinct()
    return df.join(months, ["taxi_type", "data_period"], "left_semi")


def with_quality(df: DataFrame, quality: str = "all", flag: str | None = None) -> DataFrame:
    """Row-level scope of the fact: all, clean or flagged rows, or those carrying one flag."""
    found = F.size("quality_flags")
    scopes = {"all": [], "clean": [found == 0], "flagged": [found > 0]}
    if flag is not None and flag not in FLAGS:
        raise ValueError(f"unknown flag {flag!r}")
    return keep(df, scopes[quality] + ([F.array_contains("quality_flags", flag)] if flag else []))
