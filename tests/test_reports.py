"""Whole reports: sections read from one written table equal the same asked of the published tables."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import source_dicts, write_month
from farebox.operators import questions
from farebox.operators.filters import TripFilter
from farebox.plans import publish, report
from farebox.plans.publish import Source

YEAR = TripFilter(start=dt.date(2025, 1, 1), end=dt.date(2025, 12, 31))
LONG = TripFilter(start=dt.date(2025, 1, 2), end=dt.date(2025, 1, 31), min_distance=2.0)
NONE = TripFilter(start=dt.date(2020, 1, 1), end=dt.date(2020, 1, 31))


@pytest.fixture(scope="module")
def published(spark, tmp_path_factory, zones):
    folder = tmp_path_factory.mktemp("reports")
    root = f"{folder}/root"
    sources = [
        Source(f"y-{y}-01", "yellow", f"{y}-01", write_month(folder / f"{y}.parquet", source_dicts(y)), run_id=f"r{y}")
        for y in (2024, 2025)
    ]
    publish.replace_table(zones, f"{root}/zones")
    publish.publish_months(spark, sources, zones, root)
    store = publish.open_store(spark, root)
    runs, schemas = publish.published_runs(spark, root).cache(), publish.published_schemas(spark, root).cache()
    return lambda f: report.ReportInput(store, f, store.periods, runs, schemas, min_group_trips=2)


@pytest.mark.parametrize(("f", "names"), [
    (YEAR, [n for n, s in report.SECTIONS.items() if s.levels]),
    (LONG, ["trend", "peak_slots", "top_dropoff_zones", "amount_distribution", "top_flows", "exclusions"]),
    (NONE, ["trend", "boroughs", "top_flows"]),
], ids=["year", "long trips", "no trips"])
def test_sections_from_the_shared_table_equal_the_published_tables(published, f, names):
    r = published(f)
    reads = report.selected(r, names)
    for name in names:
        shared, plain = report.SECTIONS[name].table(reads(name)), report.SECTIONS[name].table(r)
        assert shared.columns == plain.columns
        order = [F.to_json(F.struct(*plain.columns))]
        rounded = [F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in plain.dtypes]
        assert shared.select(*rounded).orderBy(*order).collect() == plain.select(*rounded).orderBy(*order).collect(), name


def test_a_narrowed_store_reads_its_trips_once_and_counts_days(published):
    r = published(YEAR)
    narrow = r.store.narrowed(YEAR, ["pairs", "zones", "codes"])
    assert list(narrow.level_sizes) == ["zones", "codes", "pairs"]
    pairs = questions.flows(narrow, metric="avg_daily_trips", limit=100)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "narrowed" in pairs.inputFiles()[0] or any("narrowed" in x for x in pairs.inputFiles())
    assert "quality_flags" not in plan
    columns = ["pickup_zone", "dropoff_zone", "value", "trips"]
    assert pairs.select(*columns).collect() == questions.flows(r.store, YEAR, "avg_daily_trips", 100).select(*columns).collect()
    # rows themselves still come from trips, whatever levels there are
    assert narrow.pick(TripFilter(), prefer_fact=True)[1] == "fact"
    total = questions.metric_value(narrow, "total_trips").first().trips
    assert questions.explore_count(narrow).first().total == total == questions.explore_count(r.store, YEAR).first().total


def test_a_report_says_what_it_is_of_and_what_its_findings_rest_on(published):
    rows = report.tidy_report(published(YEAR), "zone_analysis", dt.date(2024, 1, 1)).collect()
    cell = {(x.section, x.block, x.row, x.field): x.value for x in rows}
    assert len(cell) == len(rows)
    head = {x.field: x.value for x in rows if x.block == "metadata"}
    assert head["template"] == "zone_analysis" and head["period_start"] == "2025-01-01" and len(head["dataset_version"]) == 12
    assert cell["report", "dataset_version", 1, "run_id"] == "r2025"
    found = {x.label: x for x in rows if x.section == "findings" and x.field == "statement"}
    assert list(found) and set(found) == {"boroughs", "top_pickup_zones", "top_dropoff_zones", "top_flows"}
    first = found["top_pickup_zones"]
    zone = cell["top_pickup_zones", "top_pickup_zones", 1, "label"]
    assert first.value.startswith(f"{zone} led with ")
    assert cell["findings", "findings", first.row, "evidence.zone"] == zone
    assert cell["findings", "findings", first.row, "evidence.trips"] == cell["top_pickup_zones", "top_pickup_zones", 1, "trips"]
    assert cell["findings", "findings", first.row, "evidence_source"] == "zones_share"
    assert {x.section for x in rows} == {"report", "summary", "findings", *report.TEMPLATE_SECTIONS["zone_analysis"]}


def test_quality_template_and_a_selection_without_trips(published):
    rows = report.tidy_report(published(YEAR), "data_quality", dt.date(2024, 1, 1)).collect()
    assert {x.label for x in rows if x.field == "statement"} >= {"processing", "quarantine", "flags", "daily_flags", "schema"}
    assert any(x.field == "caveat" for x in rows)
    empty = report.evidence(published(NONE), ["trend", "hour", "peak_slots", "boroughs", "top_flows"]).collect()
    assert empty == []
