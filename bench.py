"""Headline timings at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Jobs (cleaning, publication, rollup rebuild) run once after a warm-up at the smallest scale. Questions run on the
published tables, as a user asks them; each is the median of warm runs.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import statistics
import sys
import time
from collections.abc import Callable
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from farebox.operators import clean, insight, questions  # noqa: E402
from farebox.operators.filters import TripFilter  # noqa: E402
from farebox.plans import extract, publish, report  # noqa: E402
from farebox.plans.route import TripStore  # noqa: E402
from farebox.session import build, scratch_path  # noqa: E402
from workload import inputs, trips  # noqa: E402
from workload.queries import QUERIES  # noqa: E402

RUNS = int(os.environ.get("BENCH_RUNS", "5"))
YEAR = TripFilter(start=dt.date(1997, 1, 1), end=dt.date(1997, 12, 31))
DAY = TripFilter(start=dt.date(1997, 5, 5), end=dt.date(1997, 5, 5))


def session(cpus: str) -> SparkSession:
    spark = build(
        "farebox-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.sql.files.openCostInBytes": "262144",  # small monthly files: pack many into one task
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    return spark


def sink(df: DataFrame) -> None:
    """Compute every row and column without keeping them."""
    df.write.format("noop").mode("overwrite").save()


def timed(work: Callable[[], object]) -> float:
    started = time.perf_counter()
    work()
    return time.perf_counter() - started


def publish_all(spark: SparkSession, sf_dir: str, root: str) -> None:
    zones = trips.zones(spark, sf_dir)
    publish.replace_table(zones, f"{root}/zones")
    publish.publish_normalized(spark, trips.normalized(spark, sf_dir), zones, root)


def store_questions(s: TripStore) -> dict[str, Callable[[], DataFrame]]:
    q = questions
    return {
        "overview_fact": lambda: q.overview(s, prefer_fact=True),
        "overview_rollup": lambda: q.overview(s),
        "overview_distance_filter": lambda: q.overview(s, TripFilter(min_distance=2.0, max_distance=20.0)),
        "series_day_fact": lambda: q.time_series(s, prefer_fact=True),
        "series_day_rollup": lambda: q.time_series(s),
        "top_pickup_zones_fact": lambda: q.breakdown(s, "pickup_zone", limit=10, prefer_fact=True),
        "top_pickup_zones_rollup": lambda: q.top_zones(s, "pickup"),
        "dropoff_totals_rollup": lambda: q.zone_totals(s, "dropoff"),
        "by_hour": lambda: q.breakdown(s, "hour", metric="avg_total_amount"),
        "by_payment": lambda: q.breakdown(s, "payment_type"),
        "hour_weekday": lambda: q.hour_weekday(s),
        "top_flows": lambda: q.flows(s),
        "dist_distance": lambda: q.histogram(s, "trip_distance"),
        "dist_amount": lambda: q.histogram(s, "total_amount"),
        "explore_rows": lambda: q.explore(s, DAY, page_size=50),
        "anomaly_days": lambda: insight.anomaly_days(s),
        "compare_previous": lambda: q.compare_previous(s, YEAR, dt.date(1995, 1, 1)),
        "daily_quality": lambda: q.daily_quality(s),
    }


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(cpus)
    small = str(Path(sf_dir).parent / "sf0.001")
    if Path(small).exists():
        publish_all(spark, small, scratch_path(spark, "warm"))

    results: dict[str, float] = {}
    root = scratch_path(spark, "bench")
    results["clean_all_months"] = timed(lambda: sink(clean.accepted(trips.annotated(spark, sf_dir))))
    results["publish_all_months"] = timed(lambda: publish_all(spark, sf_dir, root))
    results["rebuild_rollups"] = timed(lambda: publish.rebuild_rollups(spark, root))

    store = publish.open_store(spark, root)
    for name, ask in store_questions(store).items():
        ask().collect()
        results[name] = statistics.median(timed(lambda: ask().collect()) for _ in range(RUNS))
    folder = scratch_path(spark, "extract")
    results["extract_csv_100k"] = timed(lambda: extract.write_extract(store, folder))

    runs = inputs.runs(trips.annotated(spark, sf_dir), inputs.schemas(spark, sf_dir)).persist()
    registry = inputs.schemas(spark, sf_dir).persist()
    runs.count(), registry.count()
    r = report.ReportInput(store, YEAR, store.periods, runs, registry)
    results["report_zone_analysis"] = timed(
        lambda: report.tidy_report(r, "zone_analysis", dt.date(1995, 1, 1)).collect()
    )
    for name in ("verify_claims", "score_summary"):
        results[name] = timed(lambda: QUERIES[name](spark, sf_dir).collect())
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_total_seconds",
                "value": round(sum(results.values()), 3),
                "unit": "sec",
                "queries": {k: round(v, 3) for k, v in results.items()},
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
