"""Work that must be done once or in bounded size, whatever the size of the tables."""

from __future__ import annotations

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from farebox.operators import clean, quality, rollups
from farebox.plans import publish
from farebox.plans.publish import Source, read_source
from farebox.schema import FIELD_NAMES, SOURCE_KEYS
from farebox.session import cut
from workload import queries, trips


def plan(df, capsys) -> str:
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def test_variants_stay_in_order_where_a_value_is_unreadable(spark, month_file):
    rows = read_source(spark, Source("y-2025-01", "yellow", "2025-01", month_file, run_id="run-1")).limit(1)
    failures = [[], [], ["extra"], ["tip_amount"], ["extra", "tip_amount"]]
    variants = rows.drop("_cast_failures").crossJoin(
        spark.createDataFrame([(f,) for f in failures], "_cast_failures array<string>")
    )
    found = clean.collapse_copies(variants.select(*SOURCE_KEYS, *FIELD_NAMES, "_cast_failures")).collect()
    assert {(tuple(r["_cast_failures"]), r["_copies"], r["_copies_before"]) for r in found} == {
        ((), 2, 0), (("extra",), 1, 2), (("tip_amount",), 1, 3), (("extra", "tip_amount"), 1, 4)
    }


def hours(spark):
    days = [dt.date(2025, 1, 1), dt.date(2025, 1, 31), dt.date(2025, 2, 1), dt.date(2024, 2, 29), dt.date(2025, 1, 1), None]
    rows = [
        ("yellow", day, i % 2, None if i == 5 else 3, 7, 1, None, 10 + i, 5, 2.5, 5, 1.5, 5, 3.5, "r", dt.date(2025, 1, 1))
        for i, day in enumerate(days)
    ]
    kinds = "taxi_type string, pickup_date date, pickup_hour int, pickup_day_of_week int, pickup_location_id int, payment_type int, "
    kinds += "vendor_id int, trips long, amount_valid_trips long, total_amount_valid_sum double, distance_valid_trips long, "
    kinds += "trip_distance_valid_sum double, duration_valid_trips long, trip_duration_valid_sum double, run_id string, data_period date"
    return spark.createDataFrame(rows, kinds)


def test_levels_unite_the_days_of_months_and_count_sums_once(spark, capsys):
    levels = rollups.level_rows({"hourly": hours(spark)}, ("clock", "zones", "codes"))
    assert "bit_or" in plan(levels, capsys)  # tasks hand on 8 bytes a group and month, not 4 KB
    found = {
        (r.level, r.pickup_hour, r.pickup_day_of_week, r.trips, r.days, float(r.total_amount_valid_sum))
        for r in levels.withColumn("days", F.bitmap_count("days").cast("int")).collect()
    }
    assert found == {
        ("clock", 0, 3, 36, 2, 7.5), ("clock", 1, 3, 24, 2, 5.0), ("clock", 1, None, 15, 0, 2.5),
        ("zones", None, None, 75, 4, 15.0), ("codes", None, None, 75, 4, 15.0),
    }


def test_republishing_sorts_nothing_and_restores_the_setting(spark, january, tmp_path):
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before, stage = spark.conf.get(name), str(tmp_path / "stage")
    publish.write_curated(clean.accepted(january), stage, 1_000)
    staged, seen = spark.read.parquet(stage), []
    reader = type(spark.conf)

    original = reader.set
    try:
        reader.set = lambda self, key, value: (seen.append((key, value)), original(self, key, value))[1]
        checked = publish.publish(staged, str(tmp_path / "target"))
    finally:
        reader.set = original
    assert (name, str(publish.OPEN_MONTHS)) in seen and spark.conf.get(name) == before
    assert checked.where("NOT ok").isEmpty()


def test_a_file_over_the_limit_is_never_read(spark, tmp_path):
    (tmp_path / "orders.parquet").write_bytes(b"orders")
    (tmp_path / "part.parquet").write_bytes(b"part")
    with open(tmp_path / "lineitem.parquet", "wb") as big:
        big.truncate((1 << 31) + 1)  # sparse; more than Spark reads of one file
    found = {r.file_name: r.status for r in queries.QUERIES["verify_checksums"](spark, str(tmp_path)).collect()}
    assert found == {
        "orders.parquet": "ok", "part.parquet": "unpinned", "lineitem.parquet": "oversize", "gone.parquet": "missing"
    }


@pytest.fixture
def seen(spark, january, zones, monkeypatch):
    """The registered queries over the fixture month; labels of what they write."""
    labels, cut = [], queries.cut
    monkeypatch.setattr(trips, "annotated", lambda *_: january)
    monkeypatch.setattr(trips, "fact", lambda *_: clean.accepted(january))
    monkeypatch.setattr(trips, "zones", lambda *_: zones)
    monkeypatch.setattr(queries, "cut", lambda df, label: (labels.append(label), cut(df, label))[1])
    return labels


@pytest.mark.parametrize(
    ("name", "written"),
    [
        ("record_run", {"annotated", "records", "periods"}),
        ("write_curated", {"fact"}),
        ("publish_partition", {"fact"}),
        ("filter_published", {"fact", "periods"}),
        ("agg_levels", {"fact", "hourly", "dropoff-daily"}),
        ("avg_daily_trips__zone_level", {"fact", "hourly", "dropoff-daily", "levels"}),
        ("claim_candidates", {"values"}),
    ],
)
def test_trips_are_cleaned_once(spark, seen, name, written):
    rows = queries.QUERIES[name](spark, "")
    assert written <= set(seen) and len(seen) == len(set(seen))
    assert rows.count() > 0


def test_store_with_hours_writes_its_hours(spark, seen):
    s = queries.store_with_hours(spark, "")
    assert seen == ["hourly"] and s.hourly.agg(F.sum("trips")).first()[0] == s.fact.count()
    assert quality.published_periods(s.fact).count() == 1


def variant_rows(spark, month_file, failures):
    rows = read_source(spark, Source("y-2025-01", "yellow", "2025-01", month_file, run_id="run-1"))
    lists = spark.createDataFrame([(f,) for f in failures], "_cast_failures array<string>")
    return rows.drop("_cast_failures").crossJoin(lists).select(*SOURCE_KEYS, *FIELD_NAMES, "_cast_failures")


@pytest.mark.parametrize("failures", [[[]], [[], [], ["extra"], ["tip_amount"], ["extra", "tip_amount"]], [["extra"], ["fare_amount"]]])
def test_written_trips_put_in_order_are_those_of_one_plan(spark, month_file, failures):
    """Trips without unreadable values beside one of which a copy has some, null fields among them."""
    some = variant_rows(spark, month_file, failures).where("trip_distance > 2")
    rows = some.unionByName(variant_rows(spark, month_file, [[], []]).where("NOT trip_distance > 2"))
    got = clean.ordered(cut(clean.collapse_unordered(rows), "variants"))
    expected = clean.collapse_copies(rows)
    assert got.schema == expected.schema or got.dtypes == expected.dtypes
    assert sorted(map(repr, got.select(*expected.columns).collect())) == sorted(map(repr, expected.collect()))


def test_trips_that_are_written_are_shuffled_once(spark, capsys):
    text = plan(trips.annotated(spark, "/root/testdata/sf0.001", False), capsys)
    above = text[: text.index("partial_count(1)")]
    assert above.count("Exchange hashpartitioning") == 1 and "Window" not in above


def shuffle_files(spark) -> int:
    return len(list(Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0].getPath()).rglob("shuffle_*")))


@pytest.mark.parametrize("write", [
    lambda df, path: cut(df, "kept"),
    lambda df, path: publish.write_curated(df, path, 1_000),
    lambda df, path: publish.write_partitions(df, path),
])
def test_a_write_leaves_no_shuffle_files(spark, january, tmp_path, write):
    rows = clean.accepted(january).repartition(3, "pickup_datetime")
    before, name = shuffle_files(spark), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    kept = spark.conf.get(name)
    write(rows, str(tmp_path / "out"))
    assert shuffle_files(spark) <= before and spark.conf.get(name) == kept


def test_rows_of_a_file_follow_from_the_number_of_trips(spark, seen, monkeypatch):
    given, write = [], publish.write_curated
    monkeypatch.setattr(publish, "write_curated", lambda df, path, rows: (given.append(rows), write(df, path, rows)))
    for name in ("write_curated", "publish_partition"):
        assert queries.QUERIES[name](spark, "").count() > 0
    assert given == [15, 15]


def test_listed_trips_are_cleaned_once(spark, seen):
    assert queries.QUERIES["filter_listed"](spark, "").count() > 0 and seen == ["fact"]


def test_rollups_and_levels_are_hashed_not_sorted(spark, january, tmp_path, monkeypatch):
    """The least run of a group is kept as a number; runs come back by name, missing ones too."""
    fact = clean.accepted(january).withColumn("run_id", F.when(F.col("pickup_hour") < 9, "b").when(F.col("pickup_hour") < 12, "a"))
    fact, plans, write = cut(fact, "fact"), [], publish.write_partitions
    noted = lambda df, path: (plans.append(df._jdf.queryExecution().toString()), write(df, path))
    monkeypatch.setattr(publish, "write_partitions", noted)
    frames = publish.build_rollups(fact, str(tmp_path), "p1")
    assert len(plans) == len(rollups.ROLLUPS) and all("HashAggregate" in p and "SortAggregate" not in p for p in plans)
    for name, build in rollups.ROLLUPS.items():
        expected, got = build(fact), frames[name]
        assert sorted(map(repr, got.select(*expected.columns).collect())) == sorted(map(repr, expected.collect()))
    levels = spark.read.parquet(f"{tmp_path}/levels/publication=p1")
    plain = rollups.level_rows(frames).select(*levels.columns)
    assert sorted(map(repr, levels.collect())) == sorted(map(repr, plain.collect())) and levels.where("run_id = 'a'").count()
