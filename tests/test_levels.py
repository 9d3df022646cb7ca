"""Coarser levels: which one answers, that it answers as its rollup does, and stores published before there were any."""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from conftest import source_dicts, write_month
from farebox.operators import questions, rollups
from farebox.operators.filters import TripFilter
from farebox.plans import publish
from farebox.plans.publish import Source
from farebox.plans.route import route_level

SIZES = {name: 10 * (k + 1) for k, name in enumerate(rollups.LEVELS)}
JANUARY = TripFilter(start=dt.date(2025, 1, 6), end=dt.date(2025, 1, 10))


@pytest.mark.parametrize(("base", "f", "dimensions", "metrics", "level"), [
    ("hourly", TripFilter(), [], ["avg_daily_trips"], "daily"),
    ("hourly", JANUARY, ["time:month"], ["total_trips"], "daily"),
    ("hourly", JANUARY, ["hour"], ["total_trips"], "clock_daily"),
    ("hourly", TripFilter(), ["time:hour"], ["total_trips"], "clock_daily"),
    ("hourly", TripFilter(pickup_zone=(1,)), ["pickup_zone"], ["avg_daily_trips"], "zone_daily"),
    ("hourly", TripFilter(vendor_id=(1,)), ["payment_type"], ["avg_trip_duration_minutes"], "codes"),
    ("hourly", TripFilter(vendor_id=(1,)), ["hour"], ["total_trips"], None),
    ("dropoff_daily", TripFilter(), ["dropoff_zone"], ["total_trips"], "dropoff_zones"),
    ("dropoff_daily", JANUARY, ["dropoff_zone"], ["total_trips"], None),
    ("fact", TripFilter(), [], ["total_trips"], None),
])
def test_the_smallest_level_that_can_answer(base, f, dimensions, metrics, level):
    assert route_level(base, f, dimensions, metrics, SIZES) == level
    assert route_level(base, f, dimensions, metrics, {}) is None


def test_sizes_decide_not_the_order():
    ask = ("hourly", TripFilter(), ["pickup_zone"], ["total_trips"])
    assert route_level(*ask, {"zone_daily": 5, "zones": 9}) == "zone_daily"
    assert route_level(*ask, {"zone_daily": 9, "zones": 5}) == "zones"


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory, zones):
    folder = tmp_path_factory.mktemp("levels")
    sources = [
        Source(f"y-{y}-01", "yellow", f"{y}-01", write_month(folder / f"{y}.parquet", source_dicts(y))) for y in (2024, 2025)
    ]
    publish.replace_table(zones, f"{folder}/root/zones")
    publish.publish_months(spark, sources, zones, f"{folder}/root")
    return f"{folder}/root"


def test_published_levels_answer_as_trips_do(spark, root):
    store = publish.open_store(spark, root)
    assert set(store.level_sizes) == set(rollups.LEVELS)
    counted = {n: frame.count() for n, frame in store.levels.items()}
    assert counted == store.level_sizes
    asked = [
        (f"{'/'.join(d)}/{m}/{f.start}", f, d, m)
        for f in (TripFilter(), JANUARY)
        for d in ([], ["hour"], ["pickup_zone"], ["dropoff_zone"], ["vendor_id"], ["time:day"])
        for m in ("avg_daily_trips", "total_recorded_amount")
    ]
    rows = questions.rollup_equals_fact(store, asked).collect()
    assert len(rows) == len(asked) and all(r.groups > 0 and r.differing == 0 for r in rows)
    by_level, by_trip = (questions.overview(store, prefer_fact=x).first().asDict() for x in (False, True))
    assert all(v == (pytest.approx(by_trip[k]) if isinstance(v, float) else by_trip[k]) for k, v in by_level.items())


def test_rebuilt_levels_and_older_periods(spark, root):
    publish.rebuild_rollups(spark, root, [dt.date(2025, 1, 1)])
    store = publish.open_store(spark, root)
    assert store.level_sizes and questions.metric_value(store, "avg_daily_trips").first().trips == 30
    old = store.periods.withColumn("level_rows", F.when(F.col("data_period") == dt.date(2025, 1, 1), F.col("level_rows")))
    assert publish.level_sizes(old) == {} and publish.level_sizes(old.drop("level_rows")) == {}


def test_day_sets_unite(spark):
    days = spark.createDataFrame([(k % 3, dt.date(1990, 1, 1) + dt.timedelta(days=(k * k) % 4000)) for k in range(500)], "g int, pickup_date date")
    sets = days.groupBy("g", F.month("pickup_date")).agg(rollups.day_set().alias("days"))
    united = sets.groupBy("g").agg(F.bitmap_count(F.bitmap_or_agg("days")).alias("n")).collect()
    exact = days.groupBy("g").agg(F.count_distinct("pickup_date").alias("n")).collect()
    assert sorted(united) == sorted(exact)


def scanned_files(df) -> int:
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = (plan.executedPlan() if "Adaptive" in plan.nodeName() else plan).collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size()))


@pytest.mark.parametrize("descending", [True, False])
def test_pages_by_time_read_the_days_they_lie_on(spark, root, descending):
    store = publish.open_store(spark, root)
    plain = replace(store, levels={}, level_sizes={})
    options = {"descending": descending, "page_size": 3}
    total, last = questions.explore_count(store).first().total, None
    for page in range(1, total // 3 + 3):
        rows = questions.explore(plain, page=page, **options).collect()
        assert questions.explore(store, page=page, **options).collect() == rows
        if last is not None:
            assert questions.explore(store, after=last, **options).collect() == rows
            assert questions.explore(store, after=last, page=2, **options).collect() == questions.explore(plain, page=page + 1, **options).collect()
        last = rows[-1].asDict() if rows else last
    some = TripFilter(pickup_zone=(132, 100, 48, 161), start=dt.date(2023, 1, 1), end=dt.date(2025, 12, 31))
    assert questions.explore(store, some, page=2, **options).collect() == questions.explore(plain, some, page=2, **options).collect()
    none = TripFilter(pickup_zone=(9,))
    assert not questions.explore(store, none, page=2, **options).collect()
    assert scanned_files(questions.explore(store, page=1, **options)) < scanned_files(questions.explore(plain, page=1, **options))
