"""Report tables: each section as tidy rows, built from a few shared grouped frames."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, replace
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farebox.functions import dates, labels
from farebox.functions.numbers import display, integer, percent, plain, share, short_number, signed_change, trimmed
from farebox.operators import insight, questions, quality, registry
from farebox.operators.filters import TripFilter
from farebox.operators.insight import first_max, first_min, position
from farebox.operators.metrics import METRICS
from farebox.operators.questions import whole
from farebox.plans.route import TripStore

# Report limits and the headline metrics of each template.
TOP_ZONES = 10
TOP_PAIRS = 15
TOP_SLOTS = 10
MIN_GROUP_TRIPS = 1000
TEMPLATE_KPIS: dict[str, tuple[str, ...]] = {
    "executive_overview": tuple(METRICS),
    "demand_patterns": ("total_trips", "avg_daily_trips", "avg_trip_duration_minutes"),
    "fares_distance": (
        "total_recorded_amount", "avg_total_amount", "avg_trip_distance", "avg_trip_duration_minutes",
    ),
    "zone_analysis": ("total_trips", "avg_trip_distance", "avg_total_amount"),
    "data_quality": (),
}
TEMPLATE_SECTIONS: dict[str, tuple[str, ...]] = {
    "executive_overview": ("trend", "weekday", "top_pickup_zones", "payment_mix", "quality_snapshot"),
    "demand_patterns": ("trend", "hour", "weekday", "heatmap", "peak_slots"),
    "fares_distance": (
        "distance_distribution", "amount_distribution", "payment_types", "amount_by_hour", "exclusions",
    ),
    "zone_analysis": ("boroughs", "top_pickup_zones", "top_dropoff_zones", "top_flows"),
    "data_quality": ("processing", "quarantine", "flags", "daily_flags", "schema"),
}


@dataclass(frozen=True)
class ReportInput:
    """What a report reads: the published tables, a date range, and the run and schema records."""

    store: TripStore
    f: TripFilter
    periods: DataFrame
    runs: DataFrame
    schemas: DataFrame
    min_group_trips: int = MIN_GROUP_TRIPS
    grain: str = "day"  # of the trend

    def range(self) -> tuple[Column, Column]:
        return F.lit(self.f.start).cast("date"), F.lit(self.f.end).cast("date")

    def covered_months(self) -> DataFrame:
        return quality.overlapping(self.periods, *self.range())

    def covered_runs(self) -> DataFrame:
        return quality.quality_periods(self.runs, self.covered_months())

    def daily(self) -> DataFrame:
        return questions.daily(self.store, self.f)

    def total_trips(self) -> Column:
        return questions.metric_value(self.store, "total_trips", self.f).select("value").scalar()


def part_of_all(column: str = "trips") -> Column:
    return share(F.col(column), F.sum(column).over(whole()))


def ranked(order: list[Column]) -> Column:
    return F.row_number().over(Window.orderBy(*order))


def is_first(order: list[Column]) -> Column:
    return ranked(order) == 1


# ---- headline figures -----------------------------------------------------------------------------------------


def unit_display(value: Column) -> Column:
    """A metric's value in its own unit, chosen by the row's metric."""
    text = F.lit(None).cast("string")
    for key, metric in METRICS.items():
        text = F.when(F.col("metric") == key, display(value, metric.unit)).otherwise(text)
    return text


def kpis(r: ReportInput, template: str, coverage_start: date | Column) -> DataFrame:
    """The template's metrics with the previous window, the change and the trips left out."""
    rows = questions.compare_previous(r.store, r.f, coverage_start)
    names = labels.lookup(F.col("metric"), {k: m.label for k, m in METRICS.items()})
    return rows.filter(F.col("metric").isin(*TEMPLATE_KPIS[template])).select(
        "position",
        "metric",
        names.alias("label"),
        "value",
        unit_display(F.col("value")).alias("display"),
        "previous",
        F.when(F.col("previous").isNotNull(), unit_display(F.col("previous"))).alias("previous_display"),
        "change",
        F.when(F.col("change").isNotNull(), signed_change(F.col("change"))).alias("change_display"),
        "excluded_rows",
    )


# ---- time -----------------------------------------------------------------------------------------------------


def trend(r: ReportInput) -> DataFrame:
    """Trips per day or month, as the report's grain says, and the busiest and quietest day (the earlier on a tie)."""
    days = r.daily().select(F.col("pickup_date").cast("timestamp_ntz").alias("bucket"), "trips")
    if r.grain == "day":
        points = days
    else:
        month = F.date_trunc("month", "bucket").cast("timestamp_ntz").alias("bucket")
        points = days.groupBy(month).agg(F.sum("trips").alias("trips"))
    at = position("bucket")
    row = F.struct("bucket", "trips")
    edges = days.agg(
        F.max_by(row, first_max(F.col("trips"), at)).alias("high"),
        F.min_by(row, first_min(F.col("trips"), at)).alias("low"),
    ).select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(name).alias("kind"), F.col(f"{c}.bucket").alias("bucket"), F.col(f"{c}.trips").alias("trips"))
                    for name, c in (("busiest", "high"), ("quietest", "low"))
                ]
            )
        )
    )
    return points.select(F.lit("point").alias("kind"), "bucket", "trips").unionByName(edges)


def weekday(r: ReportInput) -> DataFrame:
    """Trips, share, days and trips per day by weekday, marking the busiest and the quietest."""
    days = insight.by_weekday(r.daily())
    per_day = F.col("trips") / F.col("days")
    return days.select(
        "weekday",
        labels.weekday_name(F.col("weekday")).alias("label"),
        "trips",
        part_of_all().alias("share"),
        "days",
        F.round(per_day, 1).alias("per_day"),
        is_first([per_day.desc(), F.col("weekday").asc()]).alias("busiest"),
        is_first([per_day.asc(), F.col("weekday").asc()]).alias("quietest"),
    ).orderBy("weekday")


def hour(r: ReportInput) -> DataFrame:
    """Trips and share by pickup hour, marking the peak and the quietest hour."""
    rows = questions.breakdown(r.store, "hour", r.f)
    key, trips = F.col("key"), F.col("trips")
    return rows.select(
        F.col("key").alias("hour"),
        "label",
        "trips",
        part_of_all().alias("share"),
        is_first([trips.desc(), key.asc()]).alias("peak"),
        is_first([trips.asc(), key.asc()]).alias("quietest"),
    ).orderBy("hour")


def heatmap(r: ReportInput) -> DataFrame:
    """Seven weekdays by 24 hours; a slot without data stays NULL."""
    cells = questions.hour_weekday(r.store, r.f).withColumn("slot", F.format_string("h%02d", "hour"))
    grid = cells.groupBy("weekday").pivot("slot", [f"h{h:02d}" for h in range(24)]).agg(F.first("trips"))
    week = r.store.zones.sparkSession.range(1, 8).select(F.col("id").cast("int").alias("weekday"))
    return (
        week.join(F.broadcast(grid), "weekday", "left")
        .withColumn("label", labels.weekday_label(F.col("weekday")))
        .orderBy("weekday")
    )


def peak_slots(r: ReportInput) -> DataFrame:
    """The ten busiest weekday-and-hour slots with their share and the share so far."""
    cells = questions.hour_weekday(r.store, r.f).withColumns(
        {
            "share": part_of_all(),
            "rank": ranked([F.desc("trips"), F.asc("weekday"), F.asc("hour")]),
        }
    )
    top = cells.filter(F.col("rank") <= TOP_SLOTS)
    so_far = F.sum("share").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return top.select(
        "rank",
        labels.weekday_name(F.col("weekday")).alias("weekday"),
        labels.hour_label(F.col("hour")).alias("hour"),
        "trips",
        "share",
        so_far.alias("combined_share"),
    )


# ---- places ---------------------------------------------------------------------------------------------------


def zone_table(r: ReportInput, side: str) -> DataFrame:
    top = insight.zones_share(r.store, side, r.f, limit=TOP_ZONES)
    so_far = F.sum("share").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return top.select(
        "rank", "key", "label", F.coalesce("borough", F.lit("—")).alias("borough"), "trips", "share",
        so_far.alias("combined_share"),
    )


def boroughs(r: ReportInput) -> DataFrame:
    """Pickups by borough; zones that are no place, and missing zones, are one group."""
    zones = questions.breakdown(r.store, "pickup_zone", r.f)
    name = F.coalesce("borough", F.lit("Unmapped")).alias("borough")
    return (
        zones.groupBy(name)
        .agg(F.sum("trips").alias("trips"))
        .withColumn("share", part_of_all())
        .orderBy(F.desc("trips"), "borough")
    )


def flow_table(r: ReportInput) -> DataFrame:
    pairs = questions.flows(r.store, r.f, limit=TOP_PAIRS)
    order = [F.desc("trips"), F.asc_nulls_last("pickup_zone"), F.asc_nulls_last("dropoff_zone")]
    return pairs.select(
        ranked(order).alias("rank"),
        "pickup_zone",
        "dropoff_zone",
        F.col("pickup_label").alias("pickup"),
        F.when(F.col("same_zone"), "same zone").otherwise(F.col("dropoff_label")).alias("dropoff"),
        "trips",
        share(F.col("trips"), r.total_trips()).alias("share"),
    )


# ---- money ----------------------------------------------------------------------------------------------------


def payment(r: ReportInput) -> DataFrame:
    """Trips, share, average amount and average distance per payment type, from one aggregation."""
    df, form = r.store.pick(r.f, ["payment_type"], ["total_trips", "avg_total_amount", "avg_trip_distance"])
    m = questions.Measures(form)
    rows = df.groupBy(F.col("payment_type").alias("key")).agg(
        m.trips().alias("trips"), m.mean(0).alias("avg_total_amount"), m.mean(1).alias("avg_trip_distance")
    )
    return rows.select(
        "key",
        labels.payment_label(F.col("key")).alias("label"),
        "trips",
        part_of_all().alias("share"),
        "avg_total_amount",
        "avg_trip_distance",
    ).orderBy(F.desc("trips"), F.asc_nulls_last("key"))


def payment_top(r: ReportInput) -> DataFrame:
    """The payment type with the highest average amount among those with enough trips."""
    rows = payment(r).filter((F.col("trips") >= r.min_group_trips) & F.col("avg_total_amount").isNotNull())
    order = [F.desc("avg_total_amount"), F.desc("trips"), F.asc_nulls_last("key")]
    return rows.select("key", "label", "avg_total_amount", "trips").orderBy(*order).limit(1)


def distribution(r: ReportInput, metric: str) -> DataFrame:
    """Histogram with bucket labels and the buckets that hold the median and the 90th percentile."""
    hist = questions.running(questions.histogram(r.store, metric, r.f))
    before = F.col("_so_far") - F.col("trips")
    miles = metric == "trip_distance"

    def bound(column: str) -> Column:
        text = short_number(F.col(column))
        return text if miles else F.concat(F.lit("$"), text)

    suffix = " mi" if miles else ""
    closed = F.concat(bound("start"), F.lit("–"), bound("end"), F.lit(suffix))
    label = F.when(F.col("open_ended"), F.concat(bound("start"), F.lit(f"+{suffix}"))).otherwise(closed)

    def holds(q: float) -> Column:
        return questions.reached(q) & ~(before >= F.lit(q) * F.col("_total"))

    marker = F.concat_ws(",", F.when(holds(0.5), "median"), F.when(holds(0.9), "p90"))
    return hist.select(
        "start", "end", label.alias("label"), "trips", "open_ended", F.nullif(marker, F.lit("")).alias("marker")
    ).orderBy("start")


def amount_by_hour(r: ReportInput) -> DataFrame:
    """Average amount by hour, marking the highest and lowest hour among those with enough trips."""
    rows = questions.breakdown(r.store, "hour", r.f, "avg_total_amount")
    value, key = F.col("value"), F.col("key")
    fits = value.isNotNull() & (F.col("trips") >= r.min_group_trips)
    counted = F.when(fits, value)
    return rows.select(
        F.col("key").alias("hour"),
        "label",
        "value",
        "trips",
        (fits & is_first([counted.desc_nulls_last(), key.asc()])).alias("highest"),
        (fits & is_first([counted.asc_nulls_last(), key.asc()])).alias("lowest"),
    ).orderBy("hour")


def exclusions(r: ReportInput) -> DataFrame:
    """Trips each metric leaves out, why, and their share of all trips."""
    row = questions.overview(r.store, r.f)
    cells = [
        F.struct(
            F.lit(key).alias("metric"),
            F.lit(m.label).alias("label"),
            F.lit(m.reason).alias("reason"),
            F.col(f"excluded__{key}").alias("excluded_rows"),
            share(F.col(f"excluded__{key}"), F.col("total_trips")).alias("share"),
        )
        for key, m in METRICS.items()
        if m.measure is not None
    ]
    return row.select(F.inline(F.array(*cells)))


# ---- quality --------------------------------------------------------------------------------------------------


def totals_wide(r: ReportInput) -> DataFrame:
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in quality.COUNTS[:4]]
    return r.covered_runs().agg(*sums, F.count(F.lit(1)).alias("months"))


def quality_snapshot(r: ReportInput) -> DataFrame:
    """Rows read, published and quarantined with shares, and the three commonest flags."""
    wide = totals_wide(r)
    accepted = wide.select("accepted_rows").scalar()
    names = (("Rows read", "input_rows"), ("Rows published", "accepted_rows"), ("Rows quarantined", "quarantined_rows"))
    rows = wide.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(i + 1).alias("position"),
                        F.lit(label).alias("measure"),
                        F.col(c).alias("rows"),
                        (share(F.col(c), F.col("input_rows")) if i else F.lit(None).cast("double")).alias("share"),
                    )
                    for i, (label, c) in enumerate(names)
                ]
            )
        )
    )
    top = flags(r).filter(F.col("rank") <= 3).select(
        (F.col("rank") + 3).alias("position"),
        F.concat(F.lit("Flag: "), "label").alias("measure"),
        F.col("trips").alias("rows"),
        share(F.col("trips"), accepted).alias("share"),
    )
    return rows.unionByName(top)


def quality_kpis(r: ReportInput) -> DataFrame:
    rate = share(F.col("quarantined_rows"), F.col("input_rows"))
    cells = (
        ("rows_read", F.col("input_rows"), "rows"),
        ("rows_published", F.col("accepted_rows"), "rows"),
        ("rows_quarantined", F.col("quarantined_rows"), "rows"),
        ("quarantine_rate", rate, "share"),
        ("months", F.col("months"), "count"),
    )
    return totals_wide(r).select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(i + 1).alias("position"),
                        F.lit(name).alias("kpi"),
                        value.cast("double").alias("value"),
                        display(value, unit).alias("display"),
                    )
                    for i, (name, value, unit) in enumerate(cells)
                ]
            )
        )
    )


def processing(r: ReportInput) -> DataFrame:
    """Each published month and its run; shortest and longest run beside every row."""
    return (
        r.covered_runs()
        .select(
            F.date_format("data_period", "yyyy-MM").alias("period"),
            F.col("run_id").alias("run"),
            "input_rows",
            "accepted_rows",
            "quarantined_rows",
            "duration_seconds",
            F.col("schema_version").alias("schema"),
            F.min("duration_seconds").over(whole()).alias("min_seconds"),
            F.max("duration_seconds").over(whole()).alias("max_seconds"),
        )
        .orderBy("period")
    )


def ranked_counts(r: ReportInput, kind: str, base: str, key: str, count: str, label) -> DataFrame:
    totals = quality.quality_totals(r.covered_runs())
    of = F.max(F.when(F.col("name") == base, F.col("rows"))).over(whole())
    rows = totals.withColumn("_whole", of).filter(F.col("kind") == kind)
    return rows.select(
        ranked([F.desc("rows"), F.asc("name")]).alias("rank"),
        F.col("name").alias(key),
        label(F.col("name")).alias("label"),
        F.col("rows").alias(count),
        share(F.col("rows"), F.col("_whole")).alias("share"),
    )


def quarantine(r: ReportInput) -> DataFrame:
    return ranked_counts(r, "reason", "quarantined_rows", "reason", "rows", labels.reason_label)


def flags(r: ReportInput) -> DataFrame:
    return ranked_counts(r, "flag", "accepted_rows", "flag", "trips", labels.flag_label)


def daily_flags(r: ReportInput, top: int = 4) -> DataFrame:
    """Daily share of the commonest flags; a day without one is 0. Days come from days with any flag."""
    rows = questions.daily_quality(r.store, r.f)
    totals = rows.groupBy("flag").agg(F.sum("flagged_trips").alias("n"))
    order = ranked([F.desc("n"), F.asc("flag")])
    commonest = totals.withColumn("rank", order).filter(F.col("rank") <= top).agg(
        F.sort_array(F.collect_list(F.struct("rank", "flag"))).alias("top")
    )
    # One row per day with its flags in a map: at most seven entries, so the top flags are looked up in the row.
    days = rows.groupBy("pickup_date").agg(
        F.max("trips").alias("trips"),
        F.map_from_entries(F.collect_list(F.struct("flag", "flagged_trips"))).alias("by_flag"),
    )
    tall = days.select("*", F.inline(commonest.scalar()))
    flagged = F.coalesce(F.try_element_at("by_flag", F.col("flag")), F.lit(0))
    return tall.select(
        "rank",
        "flag",
        labels.flag_label(F.col("flag")).alias("label"),
        "pickup_date",
        share(flagged, F.col("trips")).alias("share"),
    ).orderBy("rank", "pickup_date")


def schema_changes(r: ReportInput) -> DataFrame:
    """Schema versions and changed pairs inside the covered months.

    (kind, name, detail, columns, periods, added, removed): a version's format, number of columns and months; or a pair
    of months and the columns that came and went between them.
    """
    months = r.covered_months().agg(F.collect_set(F.date_format("data_period", "yyyy-MM")).alias("m")).scalar()
    versions = registry.schema_versions(r.schemas).filter(F.arrays_overlap("periods", months))
    drift = registry.schema_drift(r.schemas).filter(
        F.col("changed") & F.array_contains(months, F.col("from_period")) & F.array_contains(months, F.col("to_period"))
    )

    def listed(column: str) -> Column:
        return F.when(F.size(column) == 0, "—").otherwise(F.array_join(column, ", "))

    return versions.select(
        F.lit("version").alias("kind"),
        F.col("schema_version").alias("name"),
        F.col("file_format").alias("detail"),
        F.col("column_count").cast("long").alias("columns"),
        F.array_join("periods", ", ").alias("periods"),
        F.lit(None).cast("string").alias("added"),
        F.lit(None).cast("string").alias("removed"),
    ).unionByName(
        drift.select(
            F.lit("drift").alias("kind"),
            F.col("from_period").alias("name"),
            F.col("to_period").alias("detail"),
            F.lit(None).cast("long").alias("columns"),
            F.lit(None).cast("string").alias("periods"),
            listed("added").alias("added"),
            listed("removed").alias("removed"),
        )
    )


# ---- findings and the tidy report -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Section:
    """How a section's table is made, and the sentence and the values that are found in it.

    `levels` are the parts of the shared table that the section asks (see `TripStore.narrowed`); a section without any
    reads run records, schemas or daily quality. `found` takes the report and the section's table to one row, or none.
    """

    table: Callable[[ReportInput], DataFrame]
    levels: tuple[str, ...] = ()
    found: Callable[[ReportInput, DataFrame], DataFrame] | None = None
    words: Callable[[], list[Column | str]] = list
    values: tuple[str, ...] = ()
    source: str = ""
    caveat: str | None = None


c = F.col


def first_of(table: DataFrame, *order: Column) -> DataFrame:
    return table.orderBy(*order).limit(1)


def leading(table: DataFrame, *columns: str, **others: Column) -> DataFrame:
    """The first row's columns beside aggregates of all rows."""
    return table.agg(*[F.min_by(name, "rank").alias(name) for name in columns], *[v.alias(k) for k, v in others.items()])


def where_marked(table: DataFrame, **cells: tuple[str, str]) -> DataFrame:
    """name -> (mark, column): the column's value in the row that carries the mark."""
    return table.agg(*[F.max(F.when(c(mark), c(column))).alias(name) for name, (mark, column) in cells.items()])


def trend_edges(r: ReportInput, table: DataFrame) -> DataFrame:
    cells = [(kind, name, column) for kind in ("busiest", "quietest") for name, column in (("date", "bucket"), ("trips", "trips"))]
    return table.agg(
        *[
            F.max(F.when(c("kind") == kind, c(column).cast("date") if name == "date" else c(column))).alias(f"{kind}_{name}")
            for kind, name, column in cells
        ]
    ).filter(c("busiest_date").isNotNull())


def zone_section(side: str, level: str) -> Section:
    return Section(
        lambda r: zone_table(r, side),
        (level,),
        lambda r, t: leading(t, "label", "trips", "share", combined_share=F.max("combined_share")).select(
            c("label").alias("zone"), "trips", "share", "combined_share"
        ),
        lambda: [
            c("zone"), " led with ", integer(c("trips")), " trips (", percent(c("share")), "); the listed zones hold ",
            percent(c("combined_share")), ".",
        ],
        ("zone", "trips", "share", "combined_share"),
        "zones_share",
        "Shares are of all trips of the selection, with or without a known zone.",
    )


def distribution_section(metric: str) -> Section:
    return Section(
        lambda r: distribution(r, metric),
        ("buckets", "codes"),
        lambda r, t: questions.distribution_summary(r.store, metric, r.f),
        lambda: [
            "The median lies in the bucket from ", short_number(c("median_start")), " and the 90th percentile in the one from ",
            short_number(c("p90_start")), "; ", integer(c("above_cap_trips")), " trips are in the open bucket.",
        ],
        ("median_start", "p90_start", "above_cap_trips", "counted_trips", "excluded_trips"),
        "distribution_summary",
        "Buckets say between which bounds a quantile lies, not its value; implausible values are left out.",
    )


def ranked_section(table: Callable[[ReportInput], DataFrame], key: str, count: str, caveat: str) -> Section:
    return Section(
        table,
        (),
        lambda r, t: t.filter(c("rank") == 1),
        lambda: [c("label"), " was commonest: ", integer(c(count)), " rows (", percent(c("share")), ")."],
        (key, count, "share"),
        "quality_totals",
        caveat,
    )


SECTIONS: dict[str, Section] = {
    "trend": Section(
        trend, ("daily",), trend_edges,
        lambda: [
            "Most trips on ", dates.date_words(c("busiest_date")), " (", integer(c("busiest_trips")), "), fewest on ",
            dates.date_words(c("quietest_date")), " (", integer(c("quietest_trips")), ").",
        ],
        ("busiest_date", "busiest_trips", "quietest_date", "quietest_trips"), "daily",
        "Only days that have trips are compared.",
    ),
    "weekday": Section(
        weekday, ("daily",), lambda r, t: insight.weekend_split(r.store, r.f),
        lambda: [
            "Weekend days averaged ", integer(c("weekend_per_day")), " trips against ", integer(c("weekday_per_day")),
            " on weekdays (", signed_change(c("change")), ").",
        ],
        ("weekend_per_day", "weekday_per_day", "change"), "weekend_split",
        "Averages count the days that have trips.",
    ),
    "hour": Section(
        hour, ("clock",),
        lambda r, t: where_marked(
            t, peak_hour=("peak", "hour"), peak_trips=("peak", "trips"), peak_share=("peak", "share"),
            quiet_hour=("quietest", "hour"), quiet_trips=("quietest", "trips"),
        ).filter(c("peak_hour").isNotNull()),
        lambda: [
            "The busiest hour was ", labels.hour_label(c("peak_hour")), " (", percent(c("peak_share")),
            " of trips), the quietest ", labels.hour_label(c("quiet_hour")), ".",
        ],
        ("peak_hour", "peak_trips", "peak_share", "quiet_hour", "quiet_trips"), "by_hour",
    ),
    "heatmap": Section(heatmap, ("clock",)),
    "peak_slots": Section(
        peak_slots, ("clock",),
        lambda r, t: leading(
            t, "weekday", "hour", "trips", top_trips=F.sum("trips"), combined_share=F.max("combined_share")
        ).filter(c("hour").isNotNull()),
        lambda: [
            "The busiest slot was ", c("weekday"), " at ", c("hour"), "; the top slots hold ", percent(c("combined_share")),
            " of trips.",
        ],
        ("weekday", "hour", "trips", "top_trips", "combined_share"), "hour_weekday",
    ),
    "top_pickup_zones": zone_section("pickup", "zones"),
    "top_dropoff_zones": zone_section("dropoff", "dropoff_zones"),
    "payment_mix": Section(
        payment, ("codes",), lambda r, t: first_of(t, F.desc("trips"), F.asc_nulls_last("key")),
        lambda: [
            c("label"), " paid ", percent(c("share")), " of trips, ", display(c("avg_total_amount"), "usd"), " on average.",
        ],
        ("label", "trips", "share", "avg_total_amount"), "by_payment",
        "Averages leave out implausible amounts.",
    ),
    "payment_types": Section(
        payment, ("codes",), lambda r, t: payment_top(r),
        lambda: [c("label"), " had the highest average amount, ", display(c("avg_total_amount"), "usd"), "."],
        ("label", "avg_total_amount", "trips"), "by_payment",
        "Payment types with too few trips are not compared.",
    ),
    "distance_distribution": distribution_section("trip_distance"),
    "amount_distribution": distribution_section("total_amount"),
    "amount_by_hour": Section(
        amount_by_hour, ("clock",),
        lambda r, t: where_marked(
            t, highest_hour=("highest", "hour"), highest_value=("highest", "value"), lowest_hour=("lowest", "hour"),
            lowest_value=("lowest", "value"),
        ).filter(c("highest_hour").isNotNull()),
        lambda: [
            "Average amounts peaked at ", labels.hour_label(c("highest_hour")), " (", display(c("highest_value"), "usd"),
            ") and were lowest at ", labels.hour_label(c("lowest_hour")), " (", display(c("lowest_value"), "usd"), ").",
        ],
        ("highest_hour", "highest_value", "lowest_hour", "lowest_value"), "by_hour",
        "Hours with too few trips are not compared.",
    ),
    "exclusions": Section(
        exclusions, ("daily",),
        lambda r, t: t.agg(
            *[
                F.max(F.when(c("metric") == metric, c("excluded_rows"))).alias(name)
                for metric, name in (("avg_total_amount", "amount_excluded"), ("avg_trip_distance", "distance_excluded"))
            ]
        ),
        lambda: ["Amounts leave out ", integer(c("amount_excluded")), " trips, distances ", integer(c("distance_excluded")), "."],
        ("amount_excluded", "distance_excluded"), "overview",
    ),
    "boroughs": Section(
        boroughs, ("zones",), lambda r, t: first_of(t, F.desc("trips"), F.asc("borough")),
        lambda: [c("borough"), " saw ", percent(c("share")), " of pickups."],
        ("borough", "trips", "share"), "by_zone",
        "Pickups in no known zone are one group.",
    ),
    "top_flows": Section(
        flow_table, ("pairs",), lambda r, t: t.filter(c("rank") == 1),
        lambda: ["The busiest pair was ", c("pickup"), " to ", c("dropoff"), ", ", integer(c("trips")), " trips."],
        ("pickup_zone", "dropoff_zone", "trips", "share"), "flows",
    ),
    "quality_snapshot": Section(
        quality_snapshot, (), lambda r, t: totals_wide(r),
        lambda: [
            integer(c("quarantined_rows")), " of ", integer(c("input_rows")), " rows read (",
            percent(share(c("quarantined_rows"), c("input_rows"))), ") were quarantined.",
        ],
        ("input_rows", "quarantined_rows"), "quality_totals",
        "Counts are of whole months that the range touches.",
    ),
    "processing": Section(
        processing, (),
        lambda r, t: t.agg(
            F.count(F.lit(1)).alias("months"), F.min("duration_seconds").alias("min_seconds"),
            F.max("duration_seconds").alias("max_seconds"),
        ),
        lambda: [
            integer(c("months")), " months were published, in ", display(c("min_seconds"), "seconds"), " to ",
            display(c("max_seconds"), "seconds"), " each.",
        ],
        ("months", "min_seconds", "max_seconds"), "run_records",
    ),
    "quarantine": ranked_section(quarantine, "reason", "rows", "A row may have several reasons."),
    "flags": ranked_section(flags, "flag", "trips", "Flagged trips are published; a trip may have several flags."),
    "daily_flags": Section(
        daily_flags, (),
        lambda r, t: t.filter(c("rank") == 1).agg(
            F.first("flag").alias("flag"), F.min("share").alias("min_share"), F.max("share").alias("max_share")
        ).filter(c("flag").isNotNull()),
        lambda: [
            "The daily share of the commonest flag ran from ", percent(c("min_share")), " to ", percent(c("max_share")), ".",
        ],
        ("flag", "min_share", "max_share"), "daily_quality",
        "Days without any flag are not shown.",
    ),
    "schema": Section(
        schema_changes, (),
        lambda r, t: t.agg(
            F.count_if(c("kind") == "version").alias("versions"), F.count_if(c("kind") == "drift").alias("changes")
        ),
        lambda: [
            "The files use ", integer(c("versions")), " schema versions; columns changed ", integer(c("changes")), " times.",
        ],
        ("versions", "changes"), "schema_drift",
    ),
}


def stack_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def plain_text(df: DataFrame, name: str) -> Column:
    """A value as text: doubles with up to six digits, so that it is the same whatever order sums were taken in."""
    value = c(f"`{name}`")
    if df.schema[name].dataType.typeName() == "double":
        return trimmed(plain(value, 6))
    return value.cast("string")


def selected(r: ReportInput, sections: Iterable[str]) -> Callable[[str], ReportInput]:
    """What each section reads: one small written table for all that ask the trips, the report itself for the others."""
    levels = {level for name in sections for level in SECTIONS[name].levels}
    if not levels:
        return lambda name: r
    narrow = replace(r, store=r.store.narrowed(r.f, levels), f=TripFilter())
    return lambda name: narrow if SECTIONS[name].levels else r


def finding(r: ReportInput, name: str, table: DataFrame) -> DataFrame:
    """A section's sentence with each value it rests on: (section, statement, position, field, value)."""
    section = SECTIONS[name]
    row = section.found(r, table)
    cells = [
        F.struct(F.lit(k + 1).alias("position"), F.lit(field).alias("field"), plain_text(row, field).alias("value"))
        for k, field in enumerate(section.values)
    ]
    statement = F.concat(*[F.lit(w) if isinstance(w, str) else w for w in section.words()])
    return row.select(F.lit(name).alias("section"), statement.alias("statement"), F.inline(F.array(*cells)))


def evidence(r: ReportInput, sections: Sequence[str]) -> DataFrame:
    """The findings of the given sections as rows."""
    reads, parts = selected(r, sections), []
    for name in sections:
        if SECTIONS[name].found:
            parts.append(finding(reads(name), name, SECTIONS[name].table(reads(name))))
    return stack_all(parts)


TIDY = ("section", "block", "row", "field", "label", "value", "unit")
COLUMN_UNITS = {"trips": "trips", "rows": "rows", "share": "share", "combined_share": "share", "duration_seconds": "seconds"}


def tidy_cells(rows: DataFrame, section: str, block: str, row: Column, cells: list[tuple]) -> DataFrame:
    """(field, label, value, unit) cells of each row; plain strings are constants."""
    parts = [
        F.struct(
            *[
                (F.lit(v) if v is None or isinstance(v, str) else v).cast("string").alias(k)
                for k, v in zip(("field", "label", "value", "unit"), cell)
            ]
        )
        for cell in cells
    ]
    return rows.select(F.lit(section).alias("section"), F.lit(block).alias("block"), row.cast("int").alias("row"), F.inline(F.array(*parts)))


def tidy_table(section: str, block: str, df: DataFrame) -> DataFrame:
    """A section's table as (section, block, row, field, label, value, unit) rows, ordered by its columns."""
    numbered = df.withColumn("_row", ranked([F.col(name) for name in df.columns]))
    label = plain_text(df, df.columns[0])
    cells = [(name, label, plain_text(df, name), COLUMN_UNITS.get(name, "text")) for name in df.columns]
    return tidy_cells(numbered, section, block, c("_row"), cells)


def tidy_head(r: ReportInput, template: str) -> list[DataFrame]:
    """What the report is of: template, range, filters, dataset version, and the run and rows of each month."""
    filters_used = [
        (name, ", ".join(map(str, value)) if isinstance(value, tuple) else str(value))
        for name, value in vars(r.f).items()
        if name not in ("start", "end") and value not in (None, ())
    ]
    known = [("template", template), ("period_start", str(r.f.start)), ("period_end", str(r.f.end)), *filters_used]
    version = quality.dataset_version(r.periods, *r.range())
    names = [*known, ("dataset_version", c("version"))]
    numbered = version.select("version", F.posexplode(F.array(*[F.lit(k) for k, _ in names])).alias("_at", "_name"))
    value = F.lit(None).cast("string")
    for k, (_, v) in enumerate(names):
        value = F.when(c("_at") == k, F.lit(v) if isinstance(v, str) else v).otherwise(value)
    months = r.covered_months().select(
        F.date_format("data_period", "yyyy-MM").alias("period"), "run_id", "row_count",
        ranked([F.asc("data_period"), F.asc("taxi_type")]).alias("_row"),
    )
    return [
        tidy_cells(numbered, "report", "metadata", c("_at") + 1, [(c("_name"), c("_name"), value, "text")]),
        tidy_cells(
            months, "report", "dataset_version", c("_row"),
            [("run_id", c("period"), c("run_id"), "text"), ("row_count", c("period"), c("row_count"), "rows")],
        ),
    ]


def tidy_finding(rows: DataFrame, name: str, number: int) -> DataFrame:
    """A finding as rows: its sentence, where it comes from, what to bear in mind, and each value."""
    section = SECTIONS[name]
    about = [("statement", name, c("statement"), "text"), ("evidence_source", name, section.source, "text")]
    if section.caveat:
        about.append(("caveat", name, section.caveat, "text"))
    value = (F.concat(F.lit("evidence."), "field"), name, c("value"), "text")
    first = tidy_cells(rows.filter(c("position") == 1), "findings", "findings", F.lit(number), about)
    return first.unionByName(tidy_cells(rows, "findings", "findings", F.lit(number), [value]))


def tidy_report(r: ReportInput, template: str, coverage_start: date | Column) -> DataFrame:
    """A whole template as one tidy table: what it is of, KPIs, every section's table, every finding with its evidence.

    Only the template's sections are built. Those about trips ask one small table, written when this is called, which
    holds every grouping they need of the selection; their findings are read from their tables.
    """
    sections = TEMPLATE_SECTIONS[template]
    reads = selected(r, sections)
    head = quality_kpis(r) if template == "data_quality" else kpis(r, template, coverage_start)
    parts = [*tidy_head(r, template), tidy_table("summary", "kpis", head)]
    number = 0
    for name in sections:
        table = SECTIONS[name].table(reads(name))
        parts.append(tidy_table(name, name, table))
        if SECTIONS[name].found:
            number += 1
            parts.append(tidy_finding(finding(reads(name), name, table), name, number))
    return stack_all(parts).select(*TIDY)
