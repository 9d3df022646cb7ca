from __future__ import annotations

import datetime as dt
import itertools
import statistics

import pytest
from pyspark.sql import functions as F

from farebox.operators import clean, filters, insight, quality, questions
from farebox.operators.filters import TripFilter
from farebox.operators.metrics import METRICS
from farebox.plans.route import DIMENSIONS, TripStore, route

TESTDATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def store(spark, zones):
    from workload import trips

    fact = trips.fact(spark, TESTDATA).cache()
    return TripStore.over(fact, trips.zones(spark, TESTDATA), quality.published_periods(fact))


@pytest.mark.parametrize(
    ("f", "dimensions", "metrics", "table"),
    [
        (TripFilter(), [], ["total_trips"], "hourly"),
        (TripFilter(hour=(8,), weekday=(1,)), ["pickup_zone"], ["avg_trip_duration_minutes"], "hourly"),
        (TripFilter(dropoff_zone=(1,)), ["dropoff_zone"], ["avg_total_amount"], "dropoff_daily"),
        (TripFilter(dropoff_zone=(1,)), [], ["avg_trip_duration_minutes"], "fact"),
        (TripFilter(dropoff_zone=(1,), hour=(8,)), [], ["total_trips"], "fact"),
        (TripFilter(pickup_zone=(1,)), ["dropoff_zone"], ["total_trips"], "fact"),
        (TripFilter(min_distance=1), [], ["total_trips"], "fact"),
        (TripFilter(), ["pickup_zone", "dropoff_zone"], ["total_trips"], "fact"),
        (TripFilter(), ["time:hour"], ["total_trips"], "hourly"),
        (TripFilter(dropoff_zone=(1,)), ["time:hour"], ["total_trips"], "fact"),
        (TripFilter(dropoff_zone=(1,)), ["time:month"], ["total_trips"], "dropoff_daily"),
    ],
)
def test_routing_table(f, dimensions, metrics, table):
    assert route(f, dimensions, metrics) == table
    assert route(f, dimensions, metrics, prefer_fact=True) == "fact"


def test_unknown_names_are_refused(store):
    for bad in ([["rate_code"], ["total_trips"]], [["hour"], ["sum(x)"]]):
        with pytest.raises(KeyError):
            route(TripFilter(), *bad)
    with pytest.raises(KeyError):
        questions.explore(store, sort="run_id; drop")


@pytest.mark.parametrize(
    "bad",
    [
        {"pickup_zone": (0,)}, {"pickup_zone": (10_001,)}, {"hour": (24,)}, {"weekday": (0,)}, {"payment_type": (7,)},
        {"min_distance": -1.0}, {"min_distance": 5.0, "max_distance": 2.0}, {"start": dt.date(2025, 2, 1), "end": dt.date(2025, 1, 1)},
        {"vendor_id": (True,)},
    ],
)
def test_filters_are_bounded(bad):
    with pytest.raises(ValueError):
        TripFilter(**bad)


def test_lists_as_frames(spark):
    rows = spark.range(2000).selectExpr("cast(id % 700 AS int) AS pickup_location_id", "id").unionByName(
        spark.createDataFrame([(None, -1)], "pickup_location_id int, id long"))
    some = [3, 5, 5, 699, 20_000, -4]
    frame = spark.createDataFrame([(x,) for x in some] + [(None,)], "zone long")
    wanted = {r.id for r in rows.where(F.col("pickup_location_id").isin(some)).collect()}
    assert {r.id for r in filters.listed(rows, "pickup_zone", frame).collect()} == wanted
    long_list = spark.range(100, 1_000_100).selectExpr("id AS pickup_location_id")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = filters.listed(rows, "pickup_zone", long_list)
        assert "LeftSemi" in found._jdf.queryExecution().executedPlan().toString()
        assert {r.id for r in found.collect()} == {r.id for r in rows.where("pickup_location_id >= 100").collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


GRID_FILTERS = [
    TripFilter(),
    TripFilter(start=dt.date(1996, 1, 1), end=dt.date(1997, 6, 30)),
    TripFilter(payment_type=(1, 2), vendor_id=(1, 6)),
    TripFilter(hour=(7, 8, 9), weekday=(1, 2, 3)),
    TripFilter(dropoff_zone=tuple(range(1, 40))),
    TripFilter(pickup_zone=tuple(range(1, 40)), payment_type=(0, 3)),
]


def test_rollups_and_fact_agree_over_the_grid(store):
    asked = []
    for i, f in enumerate(GRID_FILTERS):
        for metric, dimension in itertools.product(METRICS, ("hour", "payment_type", "time:day")):
            if route(f, [dimension], [metric]) != "fact" and (i + len(metric)) % 3 == 0:
                asked.append((f"{i}/{metric}/{dimension}", f, [dimension], metric))
    assert len(asked) > 15
    answers = questions.rollup_equals_fact(store, asked).collect()
    assert len(answers) == len(asked) and all(r.groups > 0 and r.differing == 0 for r in answers)


def test_a_disagreement_is_found(store):
    off = TripStore.over(store.fact.limit(5000), store.zones)
    mixed = TripStore(**{**vars(store), "hourly": off.hourly})
    (row,) = questions.rollup_equals_fact(mixed, [("q", TripFilter(), ["hour"], "total_trips")]).collect()
    assert row.differing > 0


def test_no_matching_rows_is_no_data(store):
    f = TripFilter(start=dt.date(1980, 1, 1), end=dt.date(1980, 1, 2))
    for fact in (True, False):
        row = questions.overview(store, f, prefer_fact=fact).first()
        assert row.avg_total_amount is None and row.total_recorded_amount is None and row.days == 0
    assert questions.time_series(store, f).count() == 0
    assert questions.quantile_bucket(questions.histogram(store, "trip_distance", f), 0.5).first().start is None


def test_previous_period(store):
    f = TripFilter(start=dt.date(1996, 3, 1), end=dt.date(1996, 3, 31))
    assert f.previous() == TripFilter(start=dt.date(1996, 1, 30), end=dt.date(1996, 2, 29))
    rows = {r.metric: r for r in questions.compare_previous(store, f, dt.date(1995, 1, 1)).collect()}
    before = questions.overview(store, f.previous()).first()
    assert rows["total_trips"].previous == before.total_trips
    late = questions.compare_previous(store, f, dt.date(1996, 2, 1)).first()
    assert late.previous is None and late.change is None and "before published coverage" in late.reason
    with pytest.raises(ValueError):
        questions.compare_previous(store, TripFilter(), dt.date(1995, 1, 1))


def test_overlapping_ranges_compare(store):
    a = TripFilter(start=dt.date(1996, 1, 1), end=dt.date(1996, 12, 31))
    b = TripFilter(start=dt.date(1996, 6, 1), end=dt.date(1997, 6, 30))
    rows = {r.metric: r for r in insight.compare_periods(store, a, b).collect()}
    for name, f in (("period_a", a), ("period_b", b)):
        one = questions.overview(store, f).first()
        assert rows["avg_daily_trips"][name] == pytest.approx(one.avg_daily_trips)
        assert rows["avg_trip_distance"][name] == pytest.approx(one.avg_trip_distance)
    with pytest.raises(ValueError, match="no published data"):
        insight.compare_periods(store, a, b, coverage=(dt.date(1997, 1, 1), dt.date(1999, 1, 1)))


def test_answers_are_never_cut(spark, store, january, zones):
    """400 zones, a series of twenty years, hours of the whole coverage, and a filter of many values."""
    wide = TripStore(**{**vars(store), "hourly": store.hourly.withColumn("pickup_date", F.explode(F.sequence(F.lit(dt.date(1990, 1, 1)), F.lit(dt.date(2010, 1, 1)))))})
    assert questions.time_series(wide).count() == 7306
    assert questions.time_series(store, grain="hour").agg(F.sum("trips")).first()[0] == store.fact.count()
    one = clean.accepted(january).limit(1).drop("pickup_location_id")
    many = one.withColumn("pickup_location_id", F.explode(F.sequence(F.lit(1), F.lit(400)))).select(*clean.accepted(january).columns)
    places = TripStore.over(many, zones)
    rows = questions.zone_totals(places).collect()
    assert len(rows) == 400 and all(r.share == pytest.approx(1 / 400) for r in rows)
    assert questions.top_zones(places, "pickup", limit=350).count() == 350
    some = TripFilter(pickup_zone=tuple(range(1, 61)))
    assert questions.overview(places, some, prefer_fact=True).first().total_trips == 60
    with pytest.raises(ValueError):
        questions.top_zones(places, "pickup", limit=0)


def test_quantiles_are_buckets(spark):
    hist = spark.createDataFrame(
        [(0.0, 1.0, 10, False), (1.0, 2.0, 30, False), (50.0, None, 60, True)], "start double, end double, trips long, open_ended boolean"
    )
    low, high = questions.quantile_bucket(hist, 0.3, 0.9).collect()
    assert (low.start, low.end) == (1.0, 2.0) and (high.start, high.end) == (50.0, None)


def test_missing_zones_are_a_group(spark, january, zones):
    fact = clean.accepted(january).withColumn(
        "pickup_location_id", F.when(F.col("trip_distance") > 5, F.lit(None).cast("int")).otherwise(F.col("pickup_location_id"))
    )
    store = TripStore.over(fact, zones)
    labels = {r.key: (r.label, r.borough, r.mapped) for r in questions.breakdown(store, "pickup_zone").collect()}
    assert labels[None] == ("Unmapped (None)", None, False) and labels[264] == ("Unmapped (264)", None, False)
    assert labels[161] == ("Zone 161", "Borough 2", True)
    pairs = questions.flows(store).collect()
    assert any(p.pickup_zone is None and p.pickup_label == "Unmapped (None)" for p in pairs)


def test_codes_without_a_label(spark, january, zones):
    fact = clean.accepted(january).withColumn("vendor_id", F.when(F.col("vendor_id") == 2, 42))
    labels = {r.key: r.label for r in questions.breakdown(TripStore.over(fact, zones), "vendor_id").collect()}
    assert labels == {42: "Vendor 42 (undocumented)", None: "Not recorded"}


def test_explorer_orders_nulls_last_both_ways(store):
    for descending in (True, False):
        rows = questions.explore(store, sort="average_speed_mph", descending=descending, page_size=100).collect()
        speeds = [r.average_speed_mph for r in rows]
        assert None not in speeds and speeds == sorted(speeds, reverse=descending)
    total = questions.explore_count(store).first().total
    page = questions.explore(store, page=total // 100 + 1, page_size=100).count()
    assert page == total % 100
    with pytest.raises(ValueError):
        questions.explore(store, page_size=0)


@pytest.mark.parametrize("descending", [True, False])
def test_pages_behind_a_row_are_numbered_pages(store, descending):
    last = None
    for page in range(1, 5):
        options = {"sort": "average_speed_mph", "descending": descending, "page_size": 700}
        rows = questions.explore(store, page=page, **options).collect()
        assert questions.explore(store, after=last, **options).collect() == rows
        last = rows[-1].asDict()


def brute_anomalies(points):
    found = {}
    for day, value in points:
        same = [v for d, v in points if d.isoweekday() == day.isoweekday()]
        sample = same if len(same) >= 4 else [v for _, v in points]
        median = statistics.median(sample)
        mad = statistics.median(abs(v - median) for v in sample)
        found[day] = round(0.6745 * (value - median) / mad, 2) if mad else 0.0
    return found


@pytest.mark.parametrize("days", [3, 12, 40])
def test_unusual_days_against_brute_force(spark, days):
    points = [(dt.date(2025, 1, 1) + dt.timedelta(days=i), float((i * 37) % 11 + (90 if i == 9 else 0))) for i in range(days)]
    df = spark.createDataFrame(points, "pickup_date date, value double")
    ours = {r.pickup_date: r.robust_z for r in insight.anomaly_scores(df).collect()}
    assert ours == pytest.approx(brute_anomalies(points), abs=0.011)


def test_ties_take_the_earlier(spark):
    points = spark.createDataFrame(
        [(dt.datetime(2025, 1, d), v) for d, v in ((1, 5), (2, 9), (3, 9), (4, 1), (5, 1))], "bucket timestamp_ntz, value long"
    )
    row = insight.series_summary(points).first()
    assert row.highest_bucket.day == 2 and row.lowest_bucket.day == 4 and row["mean"] == 5.0
    assert [p.value for p in row.first_points] == [5.0, 9.0, 9.0, 1.0, 1.0]


def test_whole_months_are_pruned_by_date_filters():
    f = TripFilter(start=dt.date(2025, 1, 15), end=dt.date(2025, 3, 2))
    assert len(filters.month_bounds(f)) == 2 and filters.month_bounds(TripFilter()) == []
    assert set(DIMENSIONS) == {"hour", "weekday", "pickup_zone", "dropoff_zone", "payment_type", "vendor_id"}
