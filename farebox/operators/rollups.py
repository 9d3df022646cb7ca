"""Pre-aggregates that keep sums and counts only, so grouping them again is exact."""

from __future__ import annotations

from collections.abc import Callable, Collection
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farebox.schema import WIDE_MONEY

# (valid-row column, value column, count name, sum name)
MEASURES: tuple[tuple[str, str, str, str], ...] = (
    ("is_amount_valid", "total_amount", "amount_valid_trips", "total_amount_valid_sum"),
    ("is_distance_valid", "trip_distance", "distance_valid_trips", "trip_distance_valid_sum"),
    ("is_duration_valid", "trip_duration_minutes", "duration_valid_trips", "trip_duration_valid_sum"),
)
HOURLY_KEYS = (
    "taxi_type", "pickup_date", "pickup_hour", "pickup_day_of_week", "pickup_location_id", "payment_type",
    "vendor_id",
)
DROPOFF_KEYS = ("taxi_type", "pickup_date", "dropoff_location_id", "payment_type", "vendor_id")
BUCKET_KEYS = ("taxi_type", "pickup_date", "metric", "bucket_start")
FLAG_KEYS = ("taxi_type", "pickup_date", "flag")

# Histogram bucket width and the start of the open bucket.
BUCKETS: dict[str, tuple[float, float]] = {"trip_distance": (1.0, 50.0), "total_amount": (5.0, 200.0)}


def measures(durations: bool = True) -> list[Column]:
    """Trips, and per valid value its count and sum; an empty sum is 0."""
    columns = [F.count(F.lit(1)).alias("trips")]
    for valid, value, count, total in MEASURES if durations else MEASURES[:2]:
        summed = F.coalesce(F.sum(F.when(F.col(valid), F.col(value))), F.lit(0))
        kind = WIDE_MONEY if value == "total_amount" else "double"
        columns += [F.count_if(valid).alias(count), summed.cast(kind).alias(total)]
    return columns


def rollup(fact: DataFrame, keys: tuple[str, ...], aggregates: list[Column]) -> DataFrame:
    """Group on `keys` plus the partition column, so a month's rollup can replace a month's partition."""
    return fact.groupBy(*keys, "data_period").agg(*aggregates, F.min("run_id").alias("run_id"))


class Runs:
    """The runs of a table by number, in the order of their ids. The least number of a group is kept in place as rows come
    in; the least text isn't, and Spark would sort all rows by their groups for it."""

    def __init__(self, df: DataFrame) -> None:
        found = df.select("run_id").distinct().where(F.col("run_id").isNotNull()).collect()  # one or a few per month
        ids = sorted((r.run_id for r in found), key=str.encode)
        self.table = F.broadcast(df.sparkSession.createDataFrame(list(enumerate(ids)), "_nth_run int, _run string"))

    def _put(self, df: DataFrame, old: str, new: str) -> DataFrame:
        joined = df.join(self.table, F.col("run_id") == F.col(old), "left")
        return joined.select(*[F.col(new).alias(c) if c == "run_id" else F.col(f"`{c}`") for c in df.columns])

    def numbered(self, df: DataFrame) -> DataFrame:
        return self._put(df, "_run", "_nth_run")

    def named(self, df: DataFrame) -> DataFrame:
        return self._put(df, "_nth_run", "_run")


def agg_hourly(fact: DataFrame) -> DataFrame:
    return rollup(fact, HOURLY_KEYS, measures())


def agg_dropoff_daily(fact: DataFrame) -> DataFrame:
    return rollup(fact, DROPOFF_KEYS, measures(durations=False))


def bucket_start(metric: str) -> Column:
    width, cap = BUCKETS[metric]
    return F.least(F.floor(F.col(metric).cast("double") / width) * width, F.lit(cap)).cast("double")


def agg_buckets(fact: DataFrame) -> DataFrame:
    """Both histograms from one scan: each row offers at most two (metric, bucket) pairs."""
    pairs = F.array(
        *[
            F.when(
                F.col(valid), F.struct(F.lit(value).alias("metric"), bucket_start(value).alias("bucket_start"))
            )
            for valid, value, _, _ in (MEASURES[1], MEASURES[0])
        ]
    )
    rows = fact.select("taxi_type", "pickup_date", "data_period", "run_id", F.inline(F.array_compact(pairs)))
    return rollup(rows, BUCKET_KEYS, [F.count(F.lit(1)).alias("trips")])


def agg_flags_daily(fact: DataFrame) -> DataFrame:
    rows = fact.select(
        "taxi_type", "pickup_date", "data_period", "run_id", F.explode("quality_flags").alias("flag")
    )
    return rollup(rows, FLAG_KEYS, [F.count(F.lit(1)).alias("flagged_trips")])


@dataclass(frozen=True)
class Rollup:
    """A pre-aggregate: how it is built, the columns it is grouped by, and the measures it keeps (of MEASURES)."""

    build: Callable[[DataFrame], DataFrame]
    keys: tuple[str, ...]
    measures: tuple[int, ...] = ()


# The smallest tables come first among those that hold trips per group.
TABLES: dict[str, Rollup] = {
    "hourly": Rollup(agg_hourly, HOURLY_KEYS, (0, 1, 2)),
    "dropoff_daily": Rollup(agg_dropoff_daily, DROPOFF_KEYS, (0, 1)),
    "buckets": Rollup(agg_buckets, BUCKET_KEYS),
    "flags_daily": Rollup(agg_flags_daily, FLAG_KEYS),
}
ROLLUPS = {name: table.build for name, table in TABLES.items()}


# ---- coarser levels -------------------------------------------------------------------------------------------

DAY_ONE = "1990-01-01"  # bit 0 of a set of days; days are told apart for the 89 years from here


@dataclass(frozen=True)
class Level:
    """A grouping of a rollup's rows by fewer columns. Without the date, a set of days stands for it."""

    base: str
    keys: tuple[str, ...]
    measures: tuple[int, ...] = (0, 1, 2)

    @property
    def dated(self) -> bool:
        return "pickup_date" in self.keys


LEVELS: dict[str, Level] = {
    "daily": Level("hourly", ("taxi_type", "pickup_date")),
    "clock_daily": Level("hourly", ("taxi_type", "pickup_date", "pickup_hour", "pickup_day_of_week")),
    "zone_daily": Level("hourly", ("taxi_type", "pickup_date", "pickup_location_id")),
    "clock": Level("hourly", ("taxi_type", "pickup_hour", "pickup_day_of_week")),
    "zones": Level("hourly", ("taxi_type", "pickup_location_id")),
    "codes": Level("hourly", ("taxi_type", "payment_type", "vendor_id")),
    "dropoff_zones": Level("dropoff_daily", ("taxi_type", "dropoff_location_id"), (0, 1)),
}


# Trips between two zones, which no rollup has: made from trips, for a selection that is asked more than once.
PAIRS = Level("fact", ("taxi_type", "pickup_location_id", "dropoff_location_id"))
ANSWERING = {**LEVELS, "pairs": PAIRS}


def day_set() -> Column:
    """The days of a group as a bitmap: sets of groups unite, and their size is the number of distinct days."""
    return F.bitmap_construct_agg(F.expr(f"bitmap_bit_position(datediff(pickup_date, DATE'{DAY_ONE}') + 1)"))


MONTH, MONTH_DAYS = "_month", "_days"


def by_month(df: DataFrame) -> DataFrame:
    return df.withColumn(MONTH, F.trunc("pickup_date", "month"))


def month_days() -> Column:
    """The days of a group within one month, a bit each: 8 bytes a row, where a `day_set` of every task has 4 KB."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.dayofmonth("pickup_date"))).alias(MONTH_DAYS)


def united_months(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows grouped by `keys` and month, with `month_days`, as rows grouped by `keys` alone with their `day_set`."""
    first = F.coalesce(F.col("_nth"), F.lit(0)) == 0  # a row's sums count once, its days one by one
    bits = F.filter(F.sequence(F.lit(1), F.lit(31)), lambda d: F.call_function("getbit", F.col(MONTH_DAYS), d) == 1)
    tall = rows.select("*", F.posexplode_outer(bits).alias("_nth", "_day")).withColumn(
        "pickup_date", F.date_add(MONTH, F.col("_day") - 1)
    )
    kinds = {f.name: f.dataType for f in rows.schema.fields if f.name not in (*keys, MONTH, MONTH_DAYS, "run_id")}
    sums = [F.sum(F.when(first, F.col(n))).cast(kind).alias(n) for n, kind in kinds.items()]
    return tall.groupBy(*keys).agg(*sums, day_set().alias("days"), F.min("run_id").alias("run_id"))


def pair_rows(trips: DataFrame) -> DataFrame:
    """The level of zone pairs as rows like those of `level_rows`."""
    keys = [*PAIRS.keys, "data_period"]
    rows = by_month(trips).groupBy(*keys, MONTH).agg(*measures(), month_days(), F.min("run_id").alias("run_id"))
    return united_months(rows, keys).select(F.lit("pairs").alias("level"), "*")


def level_rows(bases: dict[str, DataFrame], chosen: Collection[str] = LEVELS) -> DataFrame:
    """The chosen levels as one frame with `level`, each base read once for its dated and once for its undated ones.

    Columns that a level is not grouped by are null. Sums of sums and counts are exact, so a level answers as its base.
    """
    out: DataFrame | None = None
    for base in dict.fromkeys(LEVELS[n].base for n in LEVELS if n in chosen):
        for dated in (True, False):
            names = [n for n, level in LEVELS.items() if n in chosen and level.base == base and level.dated == dated]
            if not names:
                continue
            columns = list(dict.fromkeys(k for n in names for k in LEVELS[n].keys))
            always = ["data_period"] if dated else ["data_period", MONTH]
            sets = [[F.col(k) for k in (*LEVELS[n].keys, *always)] for n in names]
            sums = [F.sum("trips").alias("trips")]
            for i in LEVELS[names[0]].measures:
                _, value, count, total = MEASURES[i]
                kind = WIDE_MONEY if value == "total_amount" else "double"
                sums += [F.sum(count).alias(count), F.sum(total).cast(kind).alias(total)]
            # which set a row is of: by the columns that are grouped away
            which = F.array(*[F.grouping(k) for k in columns])
            name = F.coalesce(*[
                F.when(which == F.array(*[F.lit(int(k not in LEVELS[n].keys)).cast("byte") for k in columns]), F.lit(n)) for n in names
            ])
            days = F.lit(None).cast("binary").alias("days") if dated else month_days()
            table = bases[base] if dated else by_month(bases[base])
            rows = table.groupingSets(sets, *[F.col(k) for k in (*columns, *always)]).agg(
                name.alias("level"), *sums, days, F.min("run_id").alias("run_id")
            )
            if not dated:
                rows = united_months(rows, [*columns, "data_period", "level"])
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out

