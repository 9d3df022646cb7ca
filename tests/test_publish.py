from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import source_dicts, write_csv, write_month
from farebox.operators import clean, quality, questions
from farebox.operators.filters import TripFilter
from farebox.plans import extract, publish, report
from farebox.plans.publish import Source
from farebox.sources.mapping import SourceError

PATTERN = "MM/dd/yyyy hh:mm:ss a"


@pytest.fixture(scope="module")
def published(spark, tmp_path_factory, zones):
    """A Parquet month and an older CSV month with other columns, published together."""
    folder = tmp_path_factory.mktemp("pub")
    sources = [
        Source("y-2025-01", "yellow", "2025-01", write_month(folder / "2025-01.parquet", source_dicts())),
        Source("y-2023-01", "yellow", "2023-01", write_csv(folder / "2023-01.csv", source_dicts(2023)), "csv", PATTERN),
    ]
    root = str(folder / "root")
    publish.replace_table(zones, f"{root}/zones")
    publish.publish_months(spark, sources, zones, root)
    return root, sources


def test_two_formats_in_one_job(spark, published):
    root, _ = published
    store = publish.open_store(spark, root)
    rows = {r.data_period: r for r in store.periods.collect()}
    assert {p: r.row_count for p, r in rows.items()} == {dt.date(2025, 1, 1): 15, dt.date(2023, 1, 1): 15}
    assert store.fact.count() == 30 and spark.read.parquet(f"{root}/quarantine").count() == 10
    assert questions.overview(store).first().total_trips == 30
    old = store.fact.filter("data_period = DATE '2023-01-01'")
    assert old.filter("cbd_congestion_fee IS NOT NULL").count() == 0
    same = old.agg(F.sum("total_amount")).first()[0]
    assert same == store.fact.filter("data_period = DATE '2025-01-01'").agg(F.sum("total_amount")).first()[0]


def test_a_rerun_replaces_and_never_appends(spark, published, zones):
    root, sources = published
    before = publish.open_store(spark, root)
    runs = spark.read.parquet(f"{root}/runs").count()
    publish.publish_months(spark, sources[:1], zones, root)
    after = publish.open_store(spark, root)
    assert after.fact.count() == 30 and after.hourly.agg(F.sum("trips")).first()[0] == 30
    assert before.fact.count() == 30  # a reader that opened the old publication still reads it whole
    assert spark.read.parquet(f"{root}/runs").count() == runs + 1


def test_rollups_are_rebuilt_for_chosen_months(spark, published):
    root, _ = published
    old = publish.open_store(spark, root)
    expected = sorted(old.hourly.drop("publication").collect())
    rows = publish.rebuild_rollups(spark, root, [dt.date(2025, 1, 1)]).collect()
    assert {r.data_period for r in rows} == {dt.date(2025, 1, 1)} and len(rows) == 4
    assert sorted(publish.open_store(spark, root).hourly.drop("publication").collect()) == expected


def test_a_bad_csv_publishes_nothing(spark, published, zones, tmp_path):
    root, sources = published
    bad = Source("bad", "yellow", "2023-02", write_csv(tmp_path / "bad.csv", source_dicts(2023), truncate_after=3), "csv", PATTERN)
    months = publish.published_months(spark, root).count()
    with pytest.raises(SourceError):
        publish.publish_months(spark, [sources[0], bad], zones, root)
    assert publish.published_months(spark, root).count() == months


def test_an_empty_period_is_refused(spark, zones, tmp_path):
    path = write_month(tmp_path / "m.parquet", source_dicts())
    with pytest.raises(quality.VerificationError):
        publish.publish_months(spark, [Source("k", "yellow", "2020-06", path)], zones, str(tmp_path / "root"))


def test_publish_replaces_only_the_staged_months(spark, january, tmp_path):
    fact = clean.accepted(january)
    target = str(tmp_path / "t")
    assert all(r.ok for r in publish.publish(fact, target).collect())
    later = fact.withColumns({"data_period": F.lit(dt.date(2025, 2, 1)), "pickup_date": F.lit(dt.date(2025, 2, 3))})
    publish.publish(later, target)
    assert all(r.ok for r in publish.publish(fact, target).collect())
    assert spark.read.parquet(target).count() == 30
    with pytest.raises(quality.VerificationError, match="outside the period"):
        publish.publish(fact.withColumn("pickup_date", F.lit(dt.date(2025, 4, 1))), target)
    assert spark.read.parquet(target).count() == 30  # a bad stage leaves what was there
    with pytest.raises(quality.VerificationError):
        publish.publish(fact.limit(0), target)


def test_verification_names_every_mismatch(january):
    fact, metrics = clean.accepted(january), quality.run_metrics(january)
    assert all(r.ok for r in quality.verify_staged(fact, metrics).collect())
    short = {r.check: r.ok for r in quality.verify_staged(fact.limit(14), metrics).collect()}
    assert not short["rows"]
    stray = quality.verify_staged(fact.unionByName(fact.withColumn("data_period", F.lit(dt.date(2024, 5, 1)))), metrics)
    assert {r.check for r in stray.filter("NOT ok").collect()} == {"rows", "amount", "rows outside the period", "period is expected"}
    with pytest.raises(quality.VerificationError, match="rows"):
        quality.require(quality.verify_staged(fact.limit(14), metrics), "fact")


def test_curated_files_are_sorted_and_bounded(spark, january, tmp_path):
    path = str(tmp_path / "c")
    publish.write_curated(clean.accepted(january), path, 15, rows_per_file=4)
    files = spark.read.parquet(path).groupBy(F.input_file_name()).agg(F.count(F.lit(1)).alias("n")).collect()
    assert len(files) >= 4 and max(r.n for r in files) <= 4
    assert publish.write_tasks(3_500_000) == 4 and publish.write_tasks(0) == 1 and publish.write_tasks(10**13) == publish.MAX_WRITE_TASKS
    assert publish.write_tasks(600_000, cores=8) == 8 and publish.write_tasks(10_000, cores=8) == 1


def test_versioned_tables(spark, tmp_path):
    path = str(tmp_path / "v")
    assert publish.current_table(spark, path) is None
    for n in (3, 5):
        publish.replace_table(spark.range(n).toDF("x"), path)
        assert publish.current_table(spark, path).count() == n


def test_extract(spark, published, tmp_path):
    store = publish.open_store(spark, published[0])
    done = extract.write_extract(store, str(tmp_path / "x"), TripFilter(), columns=["pickup_datetime", "total_amount"], max_rows=7)
    assert done == {"matched": 30, "exported": 7, "truncated": True}
    back = spark.read.option("header", True).csv(str(tmp_path / "x"))
    assert back.columns == ["pickup_datetime", "total_amount"] and back.count() == 7
    with pytest.raises(KeyError):
        extract.extract(store, columns=["secret"])
    flagged = extract.extract(store, quality="flagged").count()
    assert flagged + extract.extract(store, quality="clean").count() == 30


def test_csv_cells(spark):
    df = spark.sql(
        "SELECT '=1+1' AS a, '-x' AS b, 'fine' AS c, -5.5 AS d, true AS e, TIMESTAMP_NTZ '2025-01-06 08:00:00' AS f, "
        "array('+a', 'b') AS g, CAST(NULL AS INT) AS h, '\t' AS i, DATE '2025-01-06' AS j"
    )
    assert list(extract.csv_safe(df).first()) == ["'=1+1", "'-x", "fine", "-5.5", "true", "2025-01-06 08:00:00", "'+a;b", "", "'\t", "2025-01-06"]


def test_schema_registry_row(spark, published):
    _, sources = published
    row = publish.registry_row(spark, sources[1]).first()
    assert row.file_format == "csv" and "cbd_congestion_fee" in row.unavailable and row.columns["airport_fee"] == "string"


def test_runs_and_schemas_are_read_back_from_a_root(spark, zones, tmp_path):
    """Reports and quality totals work on what publish_months wrote; a month published again counts once."""
    root = str(tmp_path / "root")
    old = write_month(tmp_path / "a.parquet", source_dicts(2024), drop=("cbd_congestion_fee",))
    sources = [
        Source("y-2024-01", "yellow", "2024-01", old, run_id="r1"),
        Source("y-2025-01", "yellow", "2025-01", write_month(tmp_path / "b.parquet", source_dicts()), run_id="r2"),
    ]
    publish.publish_months(spark, sources, zones, root)
    publish.publish_months(spark, sources[1:], zones, root)
    store = publish.open_store(spark, root, zones=zones)
    runs, schemas = publish.published_runs(spark, root), publish.published_schemas(spark, root)
    r = report.ReportInput(store, TripFilter(), store.periods, runs, schemas)
    rows = report.processing(r).collect()
    assert [x.period for x in rows] == ["2024-01", "2025-01"] and all(x.schema.startswith("yellow-") for x in rows)
    totals = {(x.kind, x.name): x.rows for x in quality.quality_totals(r.covered_runs()).collect()}
    assert totals["rows", "input_rows"] == 40 and totals["rows", "accepted_rows"] == 30
    assert report.schema_changes(r).filter("kind = 'version'").count() == 2
    first = runs.filter("run_id = 'r1'").first()
    assert "cbd_congestion_fee" not in first.missingness and first.input_bytes > 0 and first.started_at is not None
    failed = runs.limit(1).withColumn("publication", F.lit("never-visible"))
    failed.write.mode("append").parquet(f"{root}/runs")
    assert publish.published_runs(spark, root).count() == 3


def test_publications_without_a_folder_and_overlapping_publishers(spark, zones, tmp_path):
    root = str(tmp_path / "root")
    months = [Source(f"k{y}", "yellow", f"{y}-01", write_month(tmp_path / f"{y}.parquet", source_dicts(y))) for y in (2023, 2024)]
    for source in months:
        publish.publish_months(spark, [source], zones, root)
    found = publish.by_publication(publish.published_months(spark, root), "publication")
    whole = publish.read_publications(spark, root, "flags_daily", found).count()
    gone = {**found, "p-without-flags": [dt.date(2022, 1, 1)]}
    assert whole and publish.read_publications(spark, root, "flags_daily", gone).count() == whole
    # Two publishers that both started from the same state: neither loses the other's month.
    a, b = (publish.published_months(spark, root).filter(F.year("data_period") == y) for y in (2023, 2024))
    for rows in (a, b):
        publish.append_periods(rows.withColumn("published_at", F.current_timestamp()), root)
    assert publish.published_months(spark, root).count() == 2


def test_all_failed_checks_are_kept(spark):
    checked = quality.checks(spark.range(25), ["id"], ("n", F.lit(1), F.lit(2)))
    with pytest.raises(quality.VerificationError, match="25 checks in (.*?):") as error:
        quality.require(checked, "fact")
    path = str(error.value).split(" checks in ")[1].split(": {")[0]
    assert spark.read.parquet(path).count() == 25
