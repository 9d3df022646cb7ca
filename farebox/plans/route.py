"""The published tables, and which of them answers a question."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farebox.operators import filters, rollups
from farebox.operators.filters import LISTS, TripFilter
from farebox.operators.metrics import FACT, METRICS, ROLLUP, UNDATED
from farebox.session import cut

DIMENSIONS: dict[str, str] = {
    "hour": "pickup_hour",
    "weekday": "pickup_day_of_week",
    "pickup_zone": "pickup_location_id",
    "dropoff_zone": "dropoff_location_id",
    "payment_type": "payment_type",
    "vendor_id": "vendor_id",
}
GRAINS = ("hour", "day", "month")


def bucket(grain: str) -> Column:
    """Start of the hour, day or month as a wall-clock timestamp, the same over trips and rollups."""
    day = F.col("pickup_date")
    if grain == "hour":
        return day.cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("pickup_hour"))
    return {"day": day, "month": F.trunc(day, "month")}[grain].cast("timestamp_ntz")


# Columns of a trip that a question reads, by what it asks for.
TIME_COLUMNS = {"hour": ("pickup_date", "pickup_hour"), "day": ("pickup_date",), "month": ("pickup_date",)}
FILTER_COLUMNS = {name: (column,) for name, (column, *_) in LISTS.items()} | {
    "date": ("pickup_date",), "distance": ("trip_distance",),
}
QUESTION_COLUMNS = {name: (column,) for name, column in DIMENSIONS.items()} | {
    f"time:{grain}": columns for grain, columns in TIME_COLUMNS.items()
}


def columns_read(f: TripFilter, dimensions: Iterable[str]) -> set[str]:
    """What a table must be grouped by to answer: columns that are filtered, and columns that are grouped again."""
    asked = [FILTER_COLUMNS[name] for name in f.active()] + [QUESTION_COLUMNS[name] for name in dimensions]
    return {column for columns in asked for column in columns}


def route(
    f: TripFilter, dimensions: Iterable[str] = (), metrics: Iterable[str] = (), prefer_fact: bool = False
) -> str:
    """Name of the table to read: the first rollup that keeps the columns and measures asked for, else the fact.

    Nothing but the rollups' own keys and measures decides, so a new rollup answers what it can without being listed.
    """
    columns = columns_read(f, dimensions)
    measures = {METRICS[m].measure for m in metrics} - {None}
    if not prefer_fact:
        for name, table in rollups.TABLES.items():
            if table.measures and columns <= {*table.keys} and measures <= {*table.measures}:
                return name
    return FACT


def route_level(
    base: str, f: TripFilter, dimensions: Iterable[str], metrics: Iterable[str], sizes: dict[str, int]
) -> str | None:
    """The smallest level of a rollup that answers too; `sizes` has the rows of each level there is."""
    columns = columns_read(f, dimensions)
    measures = {METRICS[m].measure for m in metrics} - {None}
    fit = [
        (size, name) for name, size in sizes.items()
        if (level := rollups.ANSWERING[name]).base == base and columns <= {*level.keys} and measures <= {*level.measures}
    ]
    return min(fit)[1] if fit else None


@dataclass(frozen=True)
class TripStore:
    """Published tables of one taxi type. Frames are lazy: a table nobody asks for is never read.

    `levels` has the coarser groupings of the rollups by name, and `level_sizes` their rows, as far as they are
    published; a question answered by a rollup goes to the smallest of them that can answer it.
    """

    fact: DataFrame
    hourly: DataFrame
    dropoff_daily: DataFrame
    buckets: DataFrame
    flags_daily: DataFrame
    zones: DataFrame
    periods: DataFrame | None = None
    levels: dict[str, DataFrame] = field(default_factory=dict)
    level_sizes: dict[str, int] = field(default_factory=dict)

    @classmethod
    def over(cls, fact: DataFrame, zones: DataFrame, periods: DataFrame | None = None) -> TripStore:
        """A store whose rollups are computed from `fact` when asked for."""
        return cls(
            fact=fact,
            hourly=rollups.agg_hourly(fact),
            dropoff_daily=rollups.agg_dropoff_daily(fact),
            buckets=rollups.agg_buckets(fact),
            flags_daily=rollups.agg_flags_daily(fact),
            zones=zones,
            periods=periods,
        )

    def pick(
        self,
        f: TripFilter,
        dimensions: Iterable[str] = (),
        metrics: Iterable[str] = (),
        prefer_fact: bool = False,
    ) -> tuple[DataFrame, str]:
        """The filtered frame of the cheapest covering table, and its form."""
        dimensions, metrics = list(dimensions), list(metrics)
        name = route(f, dimensions, metrics, prefer_fact)
        if not prefer_fact and (level := route_level(name, f, dimensions, metrics, self.level_sizes)):
            return filters.apply(self.levels[level], f), ROLLUP if rollups.ANSWERING[level].dated else UNDATED
        return filters.apply(getattr(self, name), f), FACT if name == FACT else ROLLUP

    def narrowed(self, f: TripFilter, chosen: Iterable[str]) -> TripStore:
        """A store of the trips in `f` alone, for many questions about one selection, asked without a filter.

        The chosen levels, "pairs" and "buckets" are grouped once, from the cheapest tables that can apply the filter,
        and written together; what is asked of them later reads that one small table. Anything else is answered as
        before, from the filtered tables.
        """

        def rows_of(name: str) -> DataFrame:
            table = rollups.TABLES[name]
            if columns_read(f, ()) <= {*table.keys}:
                return filters.apply(getattr(self, name), f)
            return table.build(filters.apply(self.fact, f))

        chosen = {*chosen}
        fact, tables = filters.apply(self.fact, f), {name: rows_of(name) for name in ("hourly", "dropoff_daily", "buckets")}
        parts = []
        if levels := {*rollups.LEVELS} & chosen:
            parts.append(rollups.level_rows(tables, levels))
        if "pairs" in chosen:
            parts.append(rollups.pair_rows(fact))
        if "buckets" in chosen:
            sums = tables["buckets"].groupBy("metric", "bucket_start").agg(F.sum("trips").alias("trips"))
            parts.append(sums.select(F.lit("buckets").alias("level"), "*"))
        if not parts:
            return replace(self, fact=fact, **tables, levels={}, level_sizes={})
        rows = cut(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), "narrowed")
        written = {name: rows.filter(F.col("level") == name) for name in chosen}
        if "buckets" in chosen:
            tables["buckets"] = written.pop("buckets")
        # All are in one table, so any that answers costs the same: they are taken in the order of `ANSWERING`.
        order = [name for name in rollups.ANSWERING if name in written]
        return replace(self, fact=fact, **tables, levels=written, level_sizes={name: k for k, name in enumerate(order)})

    def histogram_rows(self, f: TripFilter) -> DataFrame | None:
        """The bucket rollup where only dates are filtered, else nothing: the fact must answer."""
        return filters.apply(self.buckets, f) if f.active() <= {"date"} else None
