from __future__ import annotations

import datetime as dt
import sys
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from farebox.session import build  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build(
        "farebox-tests",
        "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.default.parallelism": "4"},
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def zones(spark):
    rows = [(i, f"Borough {i % 3}", f"Zone {i}", "Zone", i not in (264, 265)) for i in range(1, 266)]
    return spark.createDataFrame(
        rows, "location_id int, borough string, zone string, service_zone string, is_geographic boolean"
    ).cache()


def at(text: str | None, year: int = 2025) -> dt.datetime | None:
    return None if text is None else dt.datetime.fromisoformat(text if text[:2] == "20" else f"{year}-{text}")


# label, pickup, drop-off, miles, total, fare, overrides; every row states one outcome
OUTCOME_ROWS: list[tuple] = [
    ("normal-mon-8", "01-06 08:00:00", "01-06 08:20:00", 5.0, 30.0, 22.0, {}),
    ("normal-mon-9-cash", "01-06 09:00:00", "01-06 09:30:00", 3.0, 70.0, 60.0, {"PULocationID": 132, "DOLocationID": 161, "passenger_count": 2, "payment_type": 2}),
    ("cross-midnight", "01-07 23:30:00", "01-08 00:10:00", 10.0, 50.0, 40.0, {}),
    ("zero-distance", "01-07 10:00:00", "01-07 10:05:00", 0.0, 5.0, 3.0, {}),
    ("negative-amount", "01-07 11:00:00", "01-07 11:10:00", 1.0, -12.5, -10.0, {"payment_type": 4}),
    ("dropoff-before-pickup", "01-08 12:00:00", "01-08 11:50:00", 2.0, 15.0, 10.0, {}),
    ("previous-month", "2024-12-31 23:50:00", "01-01 00:05:00", 2.0, 15.0, 10.0, {}),
    ("zero-duration", "01-09 14:00:00", "01-09 14:00:00", 2.0, 10.0, 7.0, {}),
    ("implausible-speed", "01-09 15:00:00", "01-09 15:00:01", 10.0, 40.0, 30.0, {}),
    ("unmapped-zones", "01-10 16:00:00", "01-10 16:15:00", 4.0, 25.0, 18.0, {"PULocationID": 264, "DOLocationID": 265}),
    ("flex-fare-nulls", "01-11 17:00:00", "01-11 17:12:00", 2.5, 20.0, 14.0, {"payment_type": 0, "passenger_count": None, "RatecodeID": None, "store_and_fwd_flag": None, "congestion_surcharge": None, "Airport_fee": None}),
    ("extreme-total", "01-12 18:00:00", "01-12 18:30:00", 8.0, 5000.0, 4990.0, {}),
    ("extreme-distance", "01-12 19:00:00", "01-12 23:00:00", 300.0, 400.0, 380.0, {}),
    ("missing-pickup", None, "01-13 09:00:00", 1.0, 9.0, 6.0, {}),
    ("zero-passengers", "01-13 10:00:00", "01-13 10:10:00", 1.5, 12.0, 8.0, {"passenger_count": 0}),
    ("very-long", "01-14 01:00:00", "01-14 15:00:00", 20.0, 90.0, 80.0, {}),
    ("last-second", "01-31 23:59:59", "02-01 00:10:00", 2.0, 14.0, 10.0, {}),
    ("next-month", "02-01 00:00:00", "02-01 00:09:00", 2.0, 14.0, 10.0, {}),
    ("normal-sun-12", "01-12 12:00:00", "01-12 12:45:00", 6.0, 35.0, 28.0, {"VendorID": 1}),
    ("duplicate", "01-06 08:00:00", "01-06 08:20:00", 5.0, 30.0, 22.0, {}),
]
PHYSICAL = {
    "VendorID": pa.int32(), "tpep_pickup_datetime": pa.timestamp("us"), "tpep_dropoff_datetime": pa.timestamp("us"),
    "passenger_count": pa.int64(), "trip_distance": pa.float64(), "RatecodeID": pa.int64(), "store_and_fwd_flag": pa.string(),
    "PULocationID": pa.int32(), "DOLocationID": pa.int32(), "payment_type": pa.int64(), "fare_amount": pa.float64(),
    "extra": pa.float64(), "mta_tax": pa.float64(), "tip_amount": pa.float64(), "tolls_amount": pa.float64(),
    "improvement_surcharge": pa.float64(), "total_amount": pa.float64(), "congestion_surcharge": pa.float64(),
    "Airport_fee": pa.float64(), "cbd_congestion_fee": pa.float64(),
}


def source_dicts(year: int = 2025) -> list[dict]:
    rows = []
    for _, pickup, dropoff, miles, total, fare, other in OUTCOME_ROWS:
        if pickup and pickup.startswith("2024"):
            pickup = f"{year - 1}{pickup[4:]}"
        row = {
            "VendorID": 2, "tpep_pickup_datetime": at(pickup, year), "tpep_dropoff_datetime": at(dropoff, year),
            "passenger_count": 1, "trip_distance": miles, "RatecodeID": 1, "store_and_fwd_flag": "N", "PULocationID": 161,
            "DOLocationID": 236, "payment_type": 1, "fare_amount": fare, "extra": 1.0, "mta_tax": 0.5, "tip_amount": 2.0,
            "tolls_amount": 0.0, "improvement_surcharge": 1.0, "total_amount": total, "congestion_surcharge": 2.5,
            "Airport_fee": 0.0, "cbd_congestion_fee": 0.75,
        }
        rows.append({**row, **other})
    return rows


def write_month(path: Path, rows: list[dict], drop: tuple[str, ...] = ()) -> str:
    names = [n for n in PHYSICAL if n not in drop]
    table = pa.table({n: pa.array([r[n] for r in rows], PHYSICAL[n]) for n in names})
    pq.write_table(table, path)
    return str(path)


def write_csv(path: Path, rows: list[dict], truncate_after: int | None = None) -> str:
    names = [n for n in PHYSICAL if n != "cbd_congestion_fee"]

    def text(value) -> str:
        if value is None:
            return ""
        return value.strftime("%m/%d/%Y %I:%M:%S %p") if isinstance(value, dt.datetime) else str(value)

    lines = [",".join(f'"{"airport_fee" if n == "Airport_fee" else n}"' for n in names)]
    lines += [",".join(f'"{text(r[n])}"' for n in names) for r in rows]
    if truncate_after is not None:
        lines = lines[: truncate_after + 1] + ['{"error": true, "message": "Internal error"}']
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


@pytest.fixture(scope="session")
def month_file(tmp_path_factory) -> str:
    return write_month(tmp_path_factory.mktemp("src") / "yellow_tripdata_2025-01.parquet", source_dicts())


@pytest.fixture(scope="session")
def january(spark, month_file, zones):
    """The annotated outcome fixture."""
    from farebox.operators import clean
    from farebox.plans.publish import Source, read_source

    rows = read_source(spark, Source("y-2025-01", "yellow", "2025-01", month_file, run_id="run-1"))
    return clean.with_ingest_time(clean.annotate(clean.collapse_copies(rows), zones)).cache()
