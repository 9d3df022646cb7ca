"""The fixed analytic questions: metric, filters and dimension in, one small DataFrame out.

Every answer starts with one grouped aggregation that combines before its shuffle. What follows (ranking,
shares, running totals) works on the grouped rows. Windows without a partition are used on days, hours and buckets
only; codes and zone ids come from raw data and may be many, so their totals are scalar aggregates.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from farebox.functions import labels
from farebox.functions.numbers import change, share
from farebox.operators import filters
from farebox.operators.filters import TripFilter
from farebox.operators.metrics import METRICS, DailyMeasures, Measures
from farebox.operators.rollups import BUCKETS, MEASURES, bucket_start
from farebox.plans.route import DIMENSIONS, TripStore, bucket, route, route_level

ALL = TripFilter()
SHORT_RANGE = 31  # days; a page of so few is read without asking which of them hold it
RANKED = ("pickup_zone", "dropoff_zone", "payment_type", "vendor_id")


def whole() -> WindowSpec:
    """All rows at once: for grouped frames only, whose size a dimension bounds."""
    return Window.partitionBy()


def grouped(source: tuple[DataFrame, str], metric: str, **keys: Column) -> DataFrame:
    """(keys, value, trips) per group of the source."""
    df, form = source
    m = Measures(form)
    by = [column.alias(name) for name, column in keys.items()]
    return df.groupBy(*by).agg(METRICS[metric].value(m).alias("value"), m.trips().alias("trips"))


def daily(store: TripStore, f: TripFilter = ALL, prefer_fact: bool = False) -> DataFrame:
    """Every sum and count per day: the frame whole-selection answers are built from."""
    df, form = store.pick(f, ["time:day"], list(METRICS), prefer_fact)
    m = Measures(form)
    columns = [m.trips().alias("trips")]
    for i, (_, _, count, total) in enumerate(MEASURES):
        columns += [m.valid(i).alias(count), F.coalesce(m.total(i), F.lit(0)).alias(total)]
    return df.groupBy("pickup_date").agg(*columns)


# ---- headline figures -----------------------------------------------------------------------------------------


def overview(store: TripStore, f: TripFilter = ALL, prefer_fact: bool = False) -> DataFrame:
    """Six metrics, the trips each leaves out, and the dates that have data, in one row."""
    m = DailyMeasures()
    columns = [metric.value(m).alias(key) for key, metric in METRICS.items()]
    columns += [
        metric.excluded(m).alias(f"excluded__{key}")
        for key, metric in METRICS.items()
        if metric.measure is not None
    ]
    return daily(store, f, prefer_fact).agg(
        *columns,
        F.min("pickup_date").alias("first_date"),
        F.max("pickup_date").alias("last_date"),
        F.count(F.lit(1)).alias("days"),
    )


def metric_value(store: TripStore, metric: str, f: TripFilter = ALL, prefer_fact: bool = False) -> DataFrame:
    """One metric over the selection, with the trips it leaves out."""
    df, form = store.pick(f, (), [metric], prefer_fact)
    m = Measures(form)
    return df.agg(
        METRICS[metric].value(m).alias("value"),
        METRICS[metric].excluded(m).alias("excluded_rows"),
        m.trips().alias("trips"),
    )


def tall_metrics(row: DataFrame, *columns: str) -> DataFrame:
    """One row of `<metric>__<column>` values as one row per metric."""
    cells = [
        F.struct(
            F.lit(i + 1).alias("position"),
            F.lit(key).alias("metric"),
            *[F.col(f"{key}__{c}").cast("double").alias(c) for c in columns],
        )
        for i, key in enumerate(METRICS)
    ]
    return row.select(F.inline(F.array(*cells)))


def two_windows(frame: DataFrame, first: Column, second: Column, names: tuple[str, str]) -> DataFrame:
    """All metrics for two date conditions over one daily frame; the conditions may overlap."""
    columns = []
    for name, condition in zip(names, (first, second)):
        m = DailyMeasures(condition)
        for key, metric in METRICS.items():
            columns += [
                metric.value(m).alias(f"{key}__{name}"),
                metric.excluded(m).alias(f"{key}__{name}_excluded"),
            ]
    return tall_metrics(frame.agg(*columns), *names, *[f"{n}_excluded" for n in names])


def dates(f: TripFilter) -> Column:
    return F.col("pickup_date").between(F.lit(f.start), F.lit(f.end))


def compare_previous(store: TripStore, f: TripFilter, coverage_start: date | Column) -> DataFrame:
    """Each metric beside its value over the equally long window before, from one scan of both windows.

    The previous window must lie inside published coverage; otherwise previous values are NULL.
    """
    before = f.previous()
    frame = daily(store, f.between(before.start, f.end))
    both = two_windows(frame, dates(f), dates(before), ("value", "previous"))
    covered = F.lit(before.start) >= (
        coverage_start if isinstance(coverage_start, Column) else F.lit(coverage_start)
    )
    previous = F.when(covered, F.col("previous"))
    return both.select(
        "position",
        "metric",
        "value",
        previous.alias("previous"),
        change(F.col("value"), previous).alias("change"),
        F.col("value_excluded").cast("long").alias("excluded_rows"),
        F.when(~covered, f"The previous {f.days()} days start before published coverage.").alias("reason"),
    )


# ---- series and breakdowns ------------------------------------------------------------------------------------


def time_series(
    store: TripStore, f: TripFilter = ALL, metric: str = "total_trips", grain: str = "day",
    prefer_fact: bool = False,
) -> DataFrame:
    """Metric and trips per bucket that has data, over any range."""
    points = grouped(store.pick(f, [f"time:{grain}"], [metric], prefer_fact), metric, bucket=bucket(grain))
    return points.orderBy("bucket")


def at_most(df: DataFrame, limit: int | None) -> DataFrame:
    """The first rows where a caller asks for so many, else all."""
    if limit is None:
        return df
    if limit < 1:
        raise ValueError("a limit is 1 or more")
    return df.limit(limit)


def breakdown(
    store: TripStore, dimension: str, f: TripFilter = ALL, metric: str = "total_trips",
    limit: int | None = None, prefer_fact: bool = False,
) -> DataFrame:
    """Metric per hour, weekday, code or zone with its label; codes and zones ranked by value."""
    source = store.pick(f, [dimension], [metric], prefer_fact)
    groups = grouped(source, metric, key=F.col(DIMENSIONS[dimension]))
    if dimension in RANKED:
        order = [F.desc_nulls_last("value"), F.desc("trips"), F.asc_nulls_last("key")]
    else:
        order = [F.asc_nulls_last("key")]
    top = at_most(groups.orderBy(*order), limit)
    if dimension.endswith("_zone"):
        return labels.with_zone(top, store.zones, "key").orderBy(*order)
    label = {
        "hour": labels.hour_label,
        "weekday": labels.weekday_label,
        "payment_type": labels.payment_label,
        "vendor_id": labels.vendor_label,
    }[dimension]
    return top.withColumn("label", label(F.col("key")))


def top_zones(
    store: TripStore, side: str, f: TripFilter = ALL, metric: str = "total_trips", limit: int = 10
) -> DataFrame:
    return breakdown(store, f"{side}_zone", f, metric, limit)


def zone_totals(
    store: TripStore, side: str = "pickup", f: TripFilter = ALL, metric: str = "total_trips"
) -> DataFrame:
    """Every zone for a map: its value, the log scale the map colours by, and its share of the selection."""
    zones = breakdown(store, f"{side}_zone", f, metric)
    value = F.col("value").cast("double")
    total = zones.agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("total")).scalar()
    top = F.log10(F.greatest(zones.agg(F.max(value).alias("top")).scalar(), F.lit(10.0)))
    return zones.select(
        "*",
        F.when(value > 0, F.log10(value)).alias("log_value"),
        top.alias("scale_max"),
        share(value, total).alias("share"),
    )


def hour_weekday(
    store: TripStore, f: TripFilter = ALL, metric: str = "total_trips", prefer_fact: bool = False
) -> DataFrame:
    source = store.pick(f, ["weekday", "hour"], [metric], prefer_fact)
    cells = grouped(source, metric, weekday=F.col("pickup_day_of_week"), hour=F.col("pickup_hour"))
    return cells.orderBy("weekday", "hour")


def flows(store: TripStore, f: TripFilter = ALL, metric: str = "total_trips", limit: int = 15) -> DataFrame:
    """Ranked pickup and drop-off pairs; only the top rows are labelled."""
    source = store.pick(f, ["pickup_zone", "dropoff_zone"], [metric])
    pairs = grouped(
        source, metric, pickup_zone=F.col("pickup_location_id"), dropoff_zone=F.col("dropoff_location_id")
    )
    order = [
        F.desc_nulls_last("value"), F.desc("trips"), F.asc_nulls_last("pickup_zone"),
        F.asc_nulls_last("dropoff_zone"),
    ]
    top = at_most(pairs.orderBy(*order), limit)
    for side in ("pickup", "dropoff"):
        top = labels.with_zone(top, store.zones, f"{side}_zone", f"{side}_").drop(f"{side}_mapped")
    same = F.col("pickup_zone").eqNullSafe(F.col("dropoff_zone"))
    return top.withColumn("same_zone", same).orderBy(*order)


# ---- distributions --------------------------------------------------------------------------------------------


def histogram(store: TripStore, metric: str, f: TripFilter = ALL) -> DataFrame:
    """(start, end, trips, open_ended) per bucket of valid values, from the rollup where it can answer."""
    width, cap = BUCKETS[metric]
    rows = store.histogram_rows(f)
    if rows is not None:
        counted = rows.filter(F.col("metric") == metric).groupBy(F.col("bucket_start").alias("start"))
        counted = counted.agg(F.sum("trips").alias("trips"))
    else:
        valid = next(v for v, value, _, _ in MEASURES if value == metric)
        trips, _ = store.pick(f, prefer_fact=True)
        counted = trips.filter(F.col(valid)).groupBy(bucket_start(metric).alias("start"))
        counted = counted.agg(F.count(F.lit(1)).alias("trips"))
    opened = F.col("start") >= cap
    return counted.select(
        "start", F.when(~opened, F.col("start") + width).alias("end"), "trips", opened.alias("open_ended")
    ).orderBy("start")


def running(hist: DataFrame) -> DataFrame:
    so_far = Window.orderBy("start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return hist.withColumns(
        {"_so_far": F.sum("trips").over(so_far), "_total": F.sum("trips").over(whole())}
    )


def reached(q: float) -> Column:
    return F.col("_so_far") >= F.lit(q) * F.col("_total")


def quantile_bucket(hist: DataFrame, *quantiles: float) -> DataFrame:
    """For each q the first bucket whose running total reaches q of all; an interval, never a point."""
    found = running(hist).agg(
        *[
            F.min_by(F.struct("start", "end"), F.when(reached(q), F.col("start"))).alias(f"q{i}")
            for i, q in enumerate(quantiles)
        ]
    )
    rows = [
        F.struct(
            F.lit(float(q)).alias("q"), F.col(f"q{i}.start").alias("start"), F.col(f"q{i}.end").alias("end")
        )
        for i, q in enumerate(quantiles)
    ]
    return found.select(F.inline(F.array(*rows)))


def distribution_summary(store: TripStore, metric: str, f: TripFilter = ALL) -> DataFrame:
    """Counted and excluded trips, bucket width and cap, median and p90 buckets, trips above the cap."""
    width, cap = BUCKETS[metric]
    key = "avg_trip_distance" if metric == "trip_distance" else "total_recorded_amount"
    left_out = metric_value(store, key, f).select("excluded_rows").scalar()
    return running(histogram(store, metric, f)).agg(
        F.coalesce(F.sum("trips"), F.lit(0)).cast("long").alias("counted_trips"),
        F.lit(float(width)).alias("bucket_width"),
        F.lit(float(cap)).alias("cap"),
        F.min(F.when(reached(0.5), F.col("start"))).alias("median_start"),
        F.min(F.when(reached(0.9), F.col("start"))).alias("p90_start"),
        F.coalesce(F.sum(F.when(F.col("open_ended"), F.col("trips"))), F.lit(0)).cast("long").alias(
            "above_cap_trips"
        ),
    ).withColumn("excluded_trips", F.coalesce(left_out, F.lit(0)).cast("long"))


# ---- rows -----------------------------------------------------------------------------------------------------

# The columns of a row page, in order, and those it may be sorted by.
ROW_COLUMNS: tuple[str, ...] = (
    "pickup_datetime", "dropoff_datetime", "pickup_location_id", "dropoff_location_id", "trip_distance",
    "trip_duration_minutes", "passenger_count", "payment_type", "vendor_id", "rate_code_id", "fare_amount",
    "tip_amount", "tolls_amount", "total_amount", "congestion_surcharge", "airport_fee", "cbd_congestion_fee",
    "average_speed_mph", "quality_flags", "source_file", "run_id",
)
SORTABLE: tuple[str, ...] = (
    "pickup_datetime", "trip_distance", "trip_duration_minutes", "total_amount", "fare_amount", "tip_amount",
    "passenger_count", "average_speed_mph",
)


def scoped_rows(store: TripStore, f: TripFilter, quality: str = "all", flag: str | None = None) -> DataFrame:
    trips, _ = store.pick(f, prefer_fact=True)
    return filters.with_quality(trips, quality, flag)


def sort_columns(sort: str) -> list[str]:
    """The column asked for, then pickup and drop-off; the remaining columns make ties reproducible."""
    if sort not in SORTABLE:
        raise KeyError(f"not sortable: {sort!r}")
    first = [sort, *(c for c in ("pickup_datetime", "dropoff_datetime") if c != sort)]
    return first + [c for c in ROW_COLUMNS if c not in (*first, "quality_flags")]


def row_order(sort: str, descending: bool) -> list[Column]:
    """NULLs last either way; only the column asked for is ever descending."""
    first, *ties = sort_columns(sort)
    return [F.desc_nulls_last(first) if descending else F.asc_nulls_last(first), *map(F.asc_nulls_last, ties)]


def is_behind(row: dict, sort: str, descending: bool) -> Column:
    """Whether a row comes after the given one in that order: equal in some columns, then later in the next."""
    behind, equal = F.lit(False), F.lit(True)
    for i, name in enumerate(sort_columns(sort)):
        column, value = F.col(name), F.lit(row[name])
        if row[name] is None:
            later = F.lit(False)  # NULL comes last
        else:
            later = (column < value if descending and i == 0 else column > value) | column.isNull()
        behind = behind | (equal & F.coalesce(later, F.lit(False)))
        equal = equal & column.eqNullSafe(value)
    return behind


def page_days(
    store: TripStore, f: TripFilter, descending: bool, skip: int, size: int, behind: date | None = None
) -> tuple[TripFilter, int] | None:
    """The filter narrowed to the days a page by pickup time lies on, and the rows to skip there; None without an index.

    The published level of trips by day is the index: one small row per day comes to the driver. `behind` is the day of
    a row already seen, from which rows are skipped; how many trips of that day lie behind it isn't known.
    """
    asked = (["time:day"], ["total_trips"])
    short = f.days() is not None and f.days() <= SHORT_RANGE
    if short or not route_level(route(f, *asked), f, *asked, store.level_sizes):
        return None
    rows, _ = store.pick(f, *asked)
    if behind is not None:
        day = F.col("pickup_date")
        rows = rows.filter(day <= F.lit(behind) if descending else day >= F.lit(behind))
    counts = rows.groupBy("pickup_date").agg(F.sum("trips").alias("trips")).collect()
    days = sorted(((r.pickup_date, r.trips) for r in counts), reverse=descending)
    if not days:
        return None
    before, reached, start = 0, 0, None
    for day, n in days:
        if start is None and behind is None and before + n <= skip and day != days[-1][0]:
            before += n
            continue
        start, end = start or day, day
        reached += 0 if day == behind else n
        if reached >= skip - before + size:
            break
    return f.between(min(start, end), max(start, end)), skip - before


def not_before(row: dict, sort: str, descending: bool) -> Column:
    """A bound on the column asked for alone, which a scan can hold against the least and greatest of a file."""
    column, value = F.col(sort), F.lit(row[sort])
    if row[sort] is None:
        return column.isNull()
    return (column <= value if descending else column >= value) | column.isNull()


def explore(
    store: TripStore, f: TripFilter = ALL, sort: str = "pickup_datetime", descending: bool = True,
    quality: str = "all", flag: str | None = None, page: int = 1, page_size: int = 50,
    after: dict | None = None,
) -> DataFrame:
    """A page of rows, by number or behind a row already seen.

    `after` is the last row of the page before, as a dict: the page then starts right behind it however deep it lies.
    By pickup time, a store with levels reads only the days that the page lies on, for either kind of page; with a flag,
    a scope or a filter that the levels can't answer, and by other columns, numbered pages sort all rows up to their own.
    """
    if page_size < 1 or page < 1:
        raise ValueError("pages and page sizes are 1 or more")
    skip = (page - 1) * page_size
    if sort == "pickup_datetime" and quality == "all" and flag is None:
        behind = after["pickup_datetime"].date() if after is not None else None
        f, skip = page_days(store, f, descending, skip, page_size, behind) or (f, skip)
    rows = scoped_rows(store, f, quality, flag).select(*ROW_COLUMNS)
    if after is not None:
        rows = rows.filter(not_before(after, sort, descending)).filter(is_behind(after, sort, descending))
    return rows.orderBy(*row_order(sort, descending)).offset(skip).limit(page_size)


def explore_count(
    store: TripStore, f: TripFilter = ALL, quality: str = "all", flag: str | None = None
) -> DataFrame:
    return scoped_rows(store, f, quality, flag).agg(F.count(F.lit(1)).alias("total"))


def zones_list(zones: DataFrame) -> DataFrame:
    return zones.select("location_id", "borough", "zone", "service_zone", "is_geographic").orderBy("location_id")


def find_zones(zones: DataFrame, text: str, limit: int | None = None) -> DataFrame:
    """All zones whose name or borough contains the text, ignoring case."""
    needle = F.lit(text.strip().lower())
    hit = F.lower("zone").contains(needle) | F.lower("borough").contains(needle)
    return at_most(zones.filter(hit).select("location_id", "zone", "borough").orderBy("location_id"), limit)


# ---- daily quality --------------------------------------------------------------------------------------------


def daily_quality(store: TripStore, f: TripFilter = ALL) -> DataFrame:
    """Per day and flag, the flagged trips and the day's trips; both sides are grouped before they meet."""
    f = f.dates_only()
    flagged = filters.apply(store.flags_daily, f).groupBy("pickup_date", "flag")
    trips = filters.apply(store.hourly, f).groupBy("pickup_date").agg(F.sum("trips").alias("trips"))
    return (
        flagged.agg(F.sum("flagged_trips").alias("flagged_trips"))
        .join(trips, "pickup_date")
        .select("pickup_date", "flag", "flagged_trips", "trips")
        .orderBy("pickup_date", "flag")
    )


def daily_flag_rate(quality: DataFrame, flag: str) -> DataFrame:
    """Share of each day's trips with one flag; a day without it is 0."""
    flagged = F.max(F.when(F.col("flag") == flag, F.col("flagged_trips")))
    days = quality.groupBy("pickup_date").agg(
        F.coalesce(flagged, F.lit(0)).alias("flagged"), F.max("trips").alias("trips")
    )
    return days.withColumn("rate", share(F.col("flagged"), F.col("trips"))).orderBy("pickup_date")


# ---- agreement of tables --------------------------------------------------------------------------------------


def answer_rows(store: TripStore, f: TripFilter, dimensions: list[str], metric: str, prefer_fact: bool) -> DataFrame:
    """One question's answer as text keys and an exact number, to be laid beside another table's answer."""
    columns = {d: bucket(d[5:]) if d.startswith("time:") else F.col(DIMENSIONS[d]) for d in dimensions}
    answer = grouped(
        store.pick(f, dimensions, [metric], prefer_fact), metric,
        **{f"k{i}": column for i, column in enumerate(columns.values())},
    )
    keys = [F.coalesce(F.col(f"k{i}").cast("string"), F.lit("none")) for i in range(len(dimensions))]
    value = F.round(F.col("value").cast("double"), 6)
    return answer.select(F.concat_ws("|", *keys).alias("key"), value.alias("value"), "trips")


def rollup_equals_fact(store: TripStore, questions: list[tuple[str, TripFilter, list[str], str]]) -> DataFrame:
    """Per question the number of groups and of groups the routed table and the fact disagree on.

    Both answers are stacked with opposite signs and added up, so whole rows are compared both ways in one
    pass over the grouped answers.
    """
    sides = []
    for name, f, dimensions, metric in questions:
        for prefer_fact, sign in ((False, 1), (True, -1)):
            answer = answer_rows(store, f, dimensions, metric, prefer_fact)
            sides.append(answer.select(F.lit(name).alias("question"), "*", F.lit(sign).alias("sign")))
    stacked = sides[0]
    for side in sides[1:]:
        stacked = stacked.unionByName(side)
    rows = stacked.groupBy("question", "key", "value", "trips").agg(
        F.sum("sign").alias("net"), F.count_if(F.col("sign") == -1).alias("from_fact")
    )
    return rows.groupBy("question").agg(
        F.sum("from_fact").alias("groups"), F.count_if(F.col("net") != 0).alias("differing")
    )


