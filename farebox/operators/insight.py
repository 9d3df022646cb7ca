"""Comparisons, shares, rankings and unusual days on top of the questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farebox.functions import labels
from farebox.functions.numbers import change, share
from farebox.operators import questions
from farebox.operators.filters import TripFilter
from farebox.operators.quality import overlapping, quality_totals
from farebox.operators.questions import ALL, whole
from farebox.plans.route import TripStore

# Fixed values of the unusual-day score.
NORMAL_SCALE = 0.6745
UNUSUAL = 3.5
MIN_SAMPLE = 4


# ---- series ---------------------------------------------------------------------------------------------------


def series_change(points: DataFrame) -> DataFrame:
    """Each point with its change from the bucket before."""
    before = F.lag("value").over(Window.orderBy("bucket"))
    return points.withColumn("change", change(F.col("value"), before))


def first_max(value: Column, order: Column) -> Column:
    """Sort key whose maximum is the largest value, the earliest one on ties; NULL values never win."""
    return F.when(value.isNotNull(), F.struct(value, -order))


def first_min(value: Column, order: Column) -> Column:
    return F.when(value.isNotNull(), F.struct(value, order))


def position(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def series_summary(points: DataFrame, edge: int = 5) -> DataFrame:
    """Number of points, highest, lowest and mean value, and the first and last few points."""
    at = position("bucket")
    value = F.col("value").cast("double")
    near_edge = Window.orderBy("bucket")
    ends = points.withColumns(
        {
            "_from_start": F.row_number().over(near_edge),
            "_from_end": F.row_number().over(Window.orderBy(F.desc("bucket"))),
        }
    )
    first = F.when(F.col("_from_start") <= edge, F.struct("bucket", value.alias("value")))
    last = F.when(F.col("_from_end") <= edge, F.struct("bucket", value.alias("value")))
    return ends.agg(
        F.count(F.lit(1)).alias("points"),
        F.max_by("bucket", first_max(value, at)).alias("highest_bucket"),
        F.max(value).alias("highest"),
        F.min_by("bucket", first_min(value, at)).alias("lowest_bucket"),
        F.min(value).alias("lowest"),
        F.avg(value).alias("mean"),
        F.sort_array(F.collect_list(first)).alias("first_points"),
        F.sort_array(F.collect_list(last)).alias("last_points"),
    )


def largest_change(points: DataFrame) -> DataFrame:
    """Largest rise and largest fall between neighbouring buckets that have a value."""
    moves = series_change(points.filter(F.col("value").isNotNull()))
    at, size = position("bucket"), F.col("change")
    return moves.agg(
        F.max_by("bucket", first_max(size, at)).alias("rise_bucket"),
        F.max("change").alias("rise"),
        F.min_by("bucket", first_min(size, at)).alias("fall_bucket"),
        F.min("change").alias("fall"),
    )


# ---- comparisons ----------------------------------------------------------------------------------------------


def compare_periods(store: TripStore, a: TripFilter, b: TripFilter, coverage: tuple | None = None) -> DataFrame:
    """Six metrics over two date ranges and the change from a to b, from one scan of their union.

    The ranges may overlap. `coverage` is the (first, last) published date; a range outside it is an error.
    """
    if a.between(None, None) != b.between(None, None) or a.days() is None or b.days() is None:
        raise ValueError("both ranges need dates and the same other filters")
    for name, f in (("A", a), ("B", b)):
        if coverage and (f.end < coverage[0] or f.start > coverage[1]):
            raise ValueError(f"period {name} has no published data")
    span = a.between(min(a.start, b.start), max(a.end, b.end))
    frame = questions.daily(store, span)
    both = questions.two_windows(frame, questions.dates(a), questions.dates(b), ("period_a", "period_b"))
    return both.select(
        "position",
        "metric",
        "period_a",
        "period_b",
        change(F.col("period_b"), F.col("period_a")).alias("change_b_vs_a"),
    )


def zones_share(
    store: TripStore, side: str = "pickup", f: TripFilter = ALL, metric: str = "total_trips", limit: int = 10
) -> DataFrame:
    """Top zones with rank and their share of all matching trips, whether listed or not."""
    source = store.pick(f, [f"{side}_zone"], [metric])
    zones = questions.grouped(source, metric, key=F.col(questions.DIMENSIONS[f"{side}_zone"]))
    order = [F.desc_nulls_last("value"), F.desc("trips"), F.asc_nulls_last("key")]
    total = zones.agg(F.sum("trips").alias("total")).scalar()
    first = questions.at_most(zones.orderBy(*order), limit)  # so many rows are ranked, whatever number of zones
    ranked = first.select("*", share(F.col("trips"), total).alias("share"), F.row_number().over(Window.orderBy(*order)).alias("rank"))
    top = labels.with_zone(ranked, store.zones, "key")
    return top.select("rank", "key", "label", "borough", "value", "trips", "share").orderBy("rank")


def breakdown_share(
    store: TripStore, dimension: str, f: TripFilter = ALL, metric: str = "total_trips"
) -> DataFrame:
    groups = questions.breakdown(store, dimension, f, metric)
    return groups.withColumn("share", share(F.col("trips"), groups.agg(F.sum("trips").alias("total")).scalar()))


def by_weekday(days: DataFrame) -> DataFrame:
    """Trips and days with data per ISO weekday, from one row per day."""
    weekday = (F.weekday("pickup_date") + 1).alias("weekday")
    return days.groupBy(weekday).agg(F.sum("trips").alias("trips"), F.count(F.lit(1)).alias("days"))


def weekday_per_day(store: TripStore, f: TripFilter = ALL) -> DataFrame:
    per = F.try_divide(F.col("trips").cast("double"), F.col("days"))
    return (
        by_weekday(questions.daily(store, f))
        .withColumns({"label": labels.weekday_label(F.col("weekday")), "trips_per_day": per})
        .orderBy("weekday")
    )


def weekend_split(store: TripStore, f: TripFilter = ALL) -> DataFrame:
    """Monday to Friday beside Saturday and Sunday: trips, days, trips per day and the difference."""
    weekend = F.weekday("pickup_date") >= 5
    sums = questions.daily(store, f).agg(
        *[
            column
            for name, condition in (("weekday", ~weekend), ("weekend", weekend))
            for column in (
                F.coalesce(F.sum(F.when(condition, F.col("trips"))), F.lit(0)).alias(f"{name}_trips"),
                F.count_if(condition).alias(f"{name}_days"),
            )
        ]
    )
    for name in ("weekday", "weekend"):
        per = F.try_divide(F.col(f"{name}_trips").cast("double"), F.col(f"{name}_days"))
        sums = sums.withColumn(f"{name}_per_day", per)
    return sums.withColumn("change", change(F.col("weekend_per_day"), F.col("weekday_per_day")))


def busiest_buckets(hist: DataFrame, limit: int = 8) -> DataFrame:
    """Histogram buckets with the most trips and their share of all counted trips."""
    part = share(F.col("trips"), F.sum("trips").over(whole()))
    return hist.withColumn("share", part).orderBy(F.desc("trips"), "start").limit(limit)


def quality_window(runs: DataFrame, periods: DataFrame, start: Column, end: Column) -> DataFrame:
    """Quality totals of the published months that overlap a range; flags as a share of accepted rows."""
    covered = overlapping(periods, start, end).select("taxi_type", "data_period", "run_id")
    chosen = runs.join(F.broadcast(covered), ["taxi_type", "data_period", "run_id"], "left_semi")
    totals = quality_totals(chosen)
    accepted = F.max(F.when(F.col("name") == "accepted_rows", F.col("rows"))).over(whole())
    flag_share = F.when(F.col("kind") == "flag", share(F.col("rows"), accepted))
    return totals.withColumn("share_of_accepted", flag_share)


def anomaly_scores(points: DataFrame) -> DataFrame:
    """Robust z of each day against the days of the same weekday, or all days where those are fewer than four.

    `points` has one row per day (pickup_date, value), so the windows hold days, never trips.
    """
    days = points.filter(F.col("value").isNotNull()).select(
        "pickup_date", (F.weekday("pickup_date") + 1).alias("weekday"), F.col("value").cast("double").alias("value")
    )
    same = Window.partitionBy("weekday")
    enough = F.count(F.lit(1)).over(same) >= MIN_SAMPLE
    centred = days.withColumns(
        {
            "_enough": enough,
            "_same": F.percentile("value", F.lit(0.5)).over(same),
            "_all": F.percentile("value", F.lit(0.5)).over(whole()),
        }
    )
    spread = centred.withColumns(
        {
            "_same_mad": F.percentile(F.abs(F.col("value") - F.col("_same")), F.lit(0.5)).over(same),
            "_all_mad": F.percentile(F.abs(F.col("value") - F.col("_all")), F.lit(0.5)).over(whole()),
        }
    )
    median = F.when(F.col("_enough"), F.col("_same")).otherwise(F.col("_all"))
    mad = F.when(F.col("_enough"), F.col("_same_mad")).otherwise(F.col("_all_mad"))
    z = F.coalesce(F.try_divide(NORMAL_SCALE * (F.col("value") - median), mad), F.lit(0.0))
    return spread.select(
        "pickup_date",
        "weekday",
        labels.weekday_label(F.col("weekday")).alias("label"),
        "value",
        median.alias("baseline_median"),
        F.round(z, 2).alias("robust_z"),
    )


def anomaly_days(store: TripStore, f: TripFilter = ALL, metric: str = "total_trips", limit: int = 10) -> DataFrame:
    """The most unusual days by robust z-score."""
    source = store.pick(f, ["time:day"], [metric])
    points = questions.grouped(source, metric, pickup_date=F.col("pickup_date"))
    size = F.abs("robust_z")
    return (
        anomaly_scores(points).filter(size >= UNUSUAL).orderBy(size.desc(), "pickup_date").limit(limit)
    )


def hour_extremes(store: TripStore, metric: str = "avg_trip_distance", f: TripFilter = ALL) -> DataFrame:
    """Hours with the largest and the smallest value, and the trips behind them."""
    return extremes(questions.breakdown(store, "hour", f, metric))


def extremes(groups: DataFrame) -> DataFrame:
    """(high_key, high_value, high_trips, low_key, low_value, low_trips); the smaller key wins a tie."""
    key, value = F.col("key"), F.col("value").cast("double")
    row = F.struct(key.alias("key"), value.alias("value"), F.col("trips").alias("trips"))
    return groups.agg(
        F.max_by(row, first_max(value, key)).alias("high"), F.min_by(row, first_min(value, key)).alias("low")
    ).select(*[F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in ("high", "low") for c in ("key", "value", "trips")])
