"""Physical plans: what is pruned, broadcast and shuffled."""

from __future__ import annotations

import datetime as dt
import re

import pytest

import __spark_entry__ as contract
from conftest import source_dicts, write_month
from farebox.operators import questions
from farebox.operators.filters import TripFilter
from farebox.plans import publish
from farebox.plans.publish import Source
from workload import trips
from workload.oracle import ORACLES
from workload.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory, zones):
    folder = tmp_path_factory.mktemp("plans")
    sources = [
        Source(f"y-{y}-01", "yellow", f"{y}-01", write_month(folder / f"{y}.parquet", source_dicts(y))) for y in (2023, 2024, 2025)
    ]
    publish.publish_months(spark, sources, zones, str(folder / "root"))
    return publish.open_store(spark, str(folder / "root"), zones=zones)


def plan(df, mode: str = "formatted") -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


def test_dates_prune_months_before_the_scan(store):
    f = TripFilter(start=dt.date(2024, 1, 5), end=dt.date(2024, 1, 20))
    text = plan(questions.overview(store, f, prefer_fact=True))
    assert re.search(r"PartitionFilters: .*data_period.*>= 2024-01-01.*data_period.*<= 2024-01-01", text)
    assert re.search(r"PushedFilters: .*GreaterThanOrEqual\(pickup_date,2024-01-05\)", text)


def test_only_needed_columns_are_read(store):
    text = plan(questions.breakdown(store, "hour", metric="avg_trip_distance", prefer_fact=True))
    schema = re.search(r"ReadSchema: (.*)", text).group(1)
    assert "trip_distance" in schema and "pickup_hour" in schema and "total_amount" not in schema and "store_and_fwd" not in schema


def test_aggregates_combine_before_their_shuffle(store):
    text = plan(questions.breakdown(store, "payment_type", limit=10, prefer_fact=True), "simple")
    assert text.count("HashAggregate") == 2 and text.count("Exchange hashpartitioning") == 1 and "TakeOrderedAndProject" in text


def test_zone_labels_are_broadcast(store):
    text = plan(questions.flows(store), "simple")
    assert text.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in text


def test_cleaning_shuffles_rows_once_by_trip_after_combining(spark):
    text = plan(trips.fact(spark, SMALL), "simple")
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert text.count("SortMergeJoin") == 1  # the trip view itself; zones are broadcast
    assert text.count("BroadcastHashJoin") >= 2
    partial = text.index("partial_count(1)")
    above = text[:partial]  # what runs after the per-task count
    assert len(re.findall(r"Exchange hashpartitioning\((?:yellow#\d+, )?data_period", above)) == 2 and "Window" in above


def test_no_python_workers_and_no_row_products(spark):
    """Every query that only builds a plan stays in compiled operators and joins on keys."""
    writes = {
        "scan_csv", "inspect_csv", "verify_checksums", "write_curated", "write_quarantine", "publish_partition", "replace_dimension",
        "publish_aggregates", "backfill_aggregates", "record_run", "verify_claims",
    }
    for name, build in QUERIES.items():
        if name in writes or name.endswith("__fact") or name.startswith(("rpt_k", "rpt_q", "rpt_z", "rpt_p", "report_", "fn_")):
            continue  # writers run jobs; the others repeat plans that are checked under another name
        text = plan(build(spark, SMALL), "simple")
        for bad in ("PythonUDF", "ArrowEvalPython", "BatchEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
            assert bad not in text, (name, bad)


def test_oracles_name_registered_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())
    assert set(QUERIES) - set(ORACLES) == {"verify_checksums", "rpt_evidence"} | {n for n in QUERIES if n.startswith("report_")}


def test_entry(spark):
    row = contract.entry(spark).first()
    assert row.total_trips == 5829 and row.total_recorded_amount == pytest.approx(359446.36)
