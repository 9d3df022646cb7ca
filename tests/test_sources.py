from __future__ import annotations

import gzip
import hashlib
import random

import pytest

from conftest import source_dicts, write_csv, write_month
from farebox.operators import registry
from farebox.session import settings
from farebox.sources import files, mapping, zones
from farebox.sources.mapping import SourceError


def test_good_csv_passes(spark, tmp_path):
    path = write_csv(tmp_path / "ok.csv", source_dicts())
    assert files.require_valid_csv(spark, path) == 20
    row = files.validate_csv(spark, path).first()
    assert row.ok and row.rows_before_bad is None and not row.truncated


def test_truncated_csv_reports_the_rows_before(spark, tmp_path):
    path = write_csv(tmp_path / "cut.csv", source_dicts(), truncate_after=4)
    row = files.validate_csv(spark, path).first()
    assert (row.ok, row.truncated, row.rows_before_bad, row.bad_rows) == (False, True, 4, 1)
    with pytest.raises(SourceError, match="after 4 rows"):
        files.require_valid_csv(spark, path)


@pytest.mark.parametrize(
    ("content", "message"),
    [
        ('"a","b"\n"1","2","3"\n', "line 2"),
        ('"a","b"\n"1","2"\n"1"\n', "line 3"),
        ('"a",""\n"1","2"\n', "empty column names"),
        ('"a","A"\n"1","2"\n', "duplicate column names"),
        ('"a","b"\n', "no rows"),
        ("", "header is missing"),
    ],
)
def test_malformed_csv(spark, tmp_path, content, message):
    path = tmp_path / "bad.csv"
    path.write_text(content)
    with pytest.raises(SourceError, match=message):
        files.require_valid_csv(spark, str(path))


def test_csv_must_be_utf8(spark, tmp_path):
    path = tmp_path / "latin.csv"
    path.write_bytes('"zone"\n"Café"\n'.encode("latin-1"))
    with pytest.raises(SourceError, match="UTF-8"):
        files.require_valid_csv(spark, str(path))


def test_reading_a_csv_with_another_header_fails(spark, tmp_path):
    path = tmp_path / "h.csv"
    path.write_text("a,b\n1,2\n")
    with pytest.raises(Exception):  # noqa: B017 - Spark's own error
        files.read_csv(spark, str(path), ["a", "c"]).collect()


def test_inspect_parquet(spark, tmp_path):
    path = write_month(tmp_path / "m.parquet", source_dicts())
    found = files.inspect_parquet(spark, path).collect()
    assert {r.rows for r in found} == {20} and len(found) == 20
    (tmp_path / "no.parquet").write_text("not parquet at all")
    with pytest.raises(Exception):  # noqa: B017
        files.inspect_parquet(spark, str(tmp_path / "no.parquet")).collect()
    with pytest.raises(SourceError, match="no rows"):
        files.inspect_parquet(spark, write_month(tmp_path / "empty.parquet", []))


def test_every_file_has_its_own_schema(spark, tmp_path):
    full = write_month(tmp_path / "m.parquet", source_dicts())
    spark.range(7).selectExpr("id", "cast(id AS int) AS VendorID").coalesce(1).write.parquet(str(tmp_path / "other"))
    found = files.inspect_parquet(spark, full, str(tmp_path / "other")).collect()
    other = {r.column: r.type for r in found if "/other/" in r.file}
    assert other == {"id": "bigint", "VendorID": "int"} and {r.rows for r in found if "/other/" in r.file} == {7}
    assert len([r for r in found if r.file.endswith("m.parquet")]) == 20
    with pytest.raises(SourceError, match="no rows: .*empty.parquet"):
        files.inspect_parquet(spark, full, write_month(tmp_path / "empty.parquet", []))


def test_manifest_checks(spark, tmp_path):
    for name, text in (("good", "aaaa"), ("wrong", "bbbb"), ("big", "c" * 5000), ("free", "dddd")):
        (tmp_path / f"{name}.bin").write_text(text)
    pin = hashlib.sha256(b"aaaa").hexdigest()
    manifest = spark.createDataFrame(
        [("g", "good.bin", pin), ("w", "wrong.bin", pin), ("b", "big.bin", pin), ("f", "free.bin", None), ("m", "missing.bin", pin)],
        "source_key string, file_name string, expected_sha256 string",
    )
    found = {r.source_key: r for r in files.verify_manifest(spark, manifest, str(tmp_path), 4096).collect()}
    assert {k: r.status for k, r in found.items()} == {"g": "ok", "w": "mismatch", "b": "oversize", "f": "unpinned", "m": "missing"}
    assert found["b"].sha256 is None and found["g"].sha256 == pin


def test_mapping_rules():
    columns = {"VendorID": "int", "tpep_pickup_datetime": "t", "TPEP_dropoff_datetime": "t", "Airport_fee": "double", "odd": "string"}
    found = mapping.map_schema("yellow", columns)
    assert found.by_field["airport_fee"] == "Airport_fee" and found.unexpected == ("odd",)
    assert "fare_amount" in found.unavailable and found.version.startswith("yellow-")
    with pytest.raises(SourceError, match="required"):
        mapping.map_schema("yellow", {"VendorID": "int"})
    with pytest.raises(SourceError, match="ambiguous"):
        mapping.map_schema("yellow", {**columns, "vendorid": "int"})


def test_fingerprints_agree_between_driver_and_table(spark):
    columns = {"b": "int", "a": "double", "a1": "int", "B": "string"}
    df = spark.createDataFrame([("yellow", columns)], "taxi_type string, columns map<string,string>")
    assert mapping.with_fingerprint(df).first().schema_version == mapping.fingerprint("yellow", columns)
    assert mapping.fingerprint("yellow", {**columns, "a": "float"}) != mapping.fingerprint("yellow", columns)


def test_zone_lookup(spark, tmp_path):
    path = tmp_path / "zones.csv"
    path.write_text('LocationID,Borough,Zone,service_zone\n1, EWR ,"Newark, Airport",EWR\n264,Unknown,NV,N/A\n', encoding="utf-8")
    rows = {r.location_id: r for r in zones.load_zones(spark, str(path)).collect()}
    assert rows[1].borough == "EWR" and rows[1].zone == "Newark, Airport" and rows[1].is_geographic
    assert not rows[264].is_geographic
    assert [r.location_id for r in zones.geographic_ids(zones.load_zones(spark, str(path))).collect()] == [1]
    for text, message in (
        ("Location,Borough,Zone,service_zone\n1,a,b,c\n", "header"),
        ("LocationID,Borough,Zone,service_zone\nx,a,b,c\n", "LocationID"),
        ("LocationID,Borough,Zone,service_zone\n1,a,b,c\n1,a,b,c\n", "LocationID"),
        ("LocationID,Borough,Zone,service_zone\n", "empty"),
    ):
        path.write_text(text)
        with pytest.raises(SourceError, match=message):
            zones.load_zones(spark, str(path))


SCHEMAS = [
    ("yellow", "2025-01", "k1", "csv", "v1", {"VendorID": "int64", "airport_fee": "double"}),
    ("yellow", "2025-02", "k2", "parquet", "v2", {"VendorID": "int32", "Airport_fee": "double", "cbd_congestion_fee": "double"}),
    ("yellow", "2025-03", "k3", "parquet", "v2", {"VendorID": "int32", "Airport_fee": "double", "cbd_congestion_fee": "double"}),
]


@pytest.fixture
def schemas(spark):
    return spark.createDataFrame(
        SCHEMAS,
        "taxi_type string, period string, source_key string, file_format string, schema_version string, columns map<string,string>",
    )


def test_schema_drift(schemas):
    first, second = registry.schema_drift(schemas).orderBy("to_period").collect()
    assert first.added == ["cbd_congestion_fee"] and first.removed == [] and first.changed
    assert [tuple(r) for r in first.renamed_case] == [("airport_fee", "Airport_fee")]
    assert [tuple(t) for t in first.type_changed] == [("VendorID", "int64", "int32")]
    assert not second.changed


def test_schema_versions_and_fields(schemas):
    versions = {r.schema_version: r for r in registry.schema_versions(schemas).collect()}
    assert versions["v2"].periods == ["2025-02", "2025-03"] and versions["v1"].column_count == 2
    fields = {r.field: r for r in registry.field_availability(schemas).collect()}
    assert (fields["cbd_congestion_fee"].available_in, fields["cbd_congestion_fee"].periods) == (2, 3)
    assert fields["airport_fee"].source_columns["2025-01"] == "airport_fee"
    catalogue = {r.field: r for r in registry.field_catalogue(registry.field_availability(schemas)).collect()}
    assert catalogue["airport_fee"].source_columns == ["Airport_fee", "airport_fee"] and catalogue["run_id"].origin == "derived"


def test_mapping_table_statuses(schemas):
    rows = {(r.period, r.field or r.source_column): r.status for r in mapping.schema_mapping(schemas, "period").collect()}
    assert rows[("2025-01", "vendor_id")] == "mapped" and rows[("2025-01", "pickup_datetime")] == "missing_required"
    assert rows[("2025-01", "extra")] == "unavailable"


def test_files_are_digested_in_pieces_whatever_they_hold(spark, tmp_path):
    """Line feeds, marks and packed names at either end, and a file of many splits. (Spark lists no empty files.)"""
    rng = random.Random(5)
    whole = {
        "feed": b"\n", "feeds": b"\n\n\n", "no-feed": b"a\r\nb\rc", "ends": b"a\n", "mark": b"\xef\xbb\xbf",
        "mark-feed": b"\xef\xbb\xbf\n", "mark-text": b"\xef\xbb\xbfab\nc", "mark-ends": b"\xef\xbb\xbfab\nc\n", "twice": b"\xef\xbb\xbf" * 2,
        "with space.parquet": rng.randbytes(300_000), "long": b"x" * 200_000, "packed.gz": gzip.compress(b"text\n"), "not-packed.zst": b"zz\n",
    }
    (tmp_path / "under").mkdir()
    for name, data in whole.items():
        (tmp_path / "under" / name).write_bytes(data)
    (tmp_path / "over").write_bytes(b"\n" * 300_001)
    with settings(spark, **{"spark.sql.files.maxPartitionBytes": "40000", "spark.sql.execution.arrow.maxRecordsPerBatch": "100"}):
        sums = files.sha256_sums(spark, str(tmp_path), 300_000, recursive=True)
        got = {r.file_name: r.sha256 for r in sums.collect()}
    assert got == {name: hashlib.sha256(data).hexdigest() for name, data in whole.items()}
    assert files.sha256_sums(spark, str(tmp_path), 300_000).count() == 0
