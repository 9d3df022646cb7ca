"""CSV records across split points against a single pass over the whole text."""

from __future__ import annotations

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from farebox.sources import files, records
from farebox.sources.mapping import SourceError


@pytest.fixture
def small_splits(spark):
    def at(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))

    yield at
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def single_pass(text):
    """Records by one walk over all characters."""
    out, record, state = [], "", "start"  # start of a field, plain, quoted
    k = 0
    while k < len(text):
        c = text[k]
        if state == "quoted":
            if c == '"' and text[k + 1 : k + 2] == '"':
                record += '""'
                k += 2
                continue
            if c == '"':
                state = "plain"
        elif c == "\n":
            out.append(record)
            record, state = "", "start"
            k += 1
            continue
        elif c == '"' and state == "start":
            state = "quoted"
        else:
            state = "start" if c == "," else "plain"
        record += c
        k += 1
    if record:  # never closed; the file's own last line feed is no part of it
        out.append(record.removesuffix("\n"))
    return [r.removesuffix("\r") for r in out if r.strip("".join(map(chr, range(33)))) or "\n" in r]


@pytest.mark.parametrize(("size", "kept"), [(7, 1 << 20), (31, 3), (400, 1 << 20)])
def test_records_at_any_split(spark, tmp_path, small_splits, monkeypatch, size, kept):
    monkeypatch.setattr(records, "MOST_KEPT", kept)
    rng = random.Random(size)
    expected = {}
    for n in range(6):
        text = "".join(rng.choices(['"', '""', ",", "\n", "\r\n", "a", "bc", ' "', 'é', ',"', '",', "\n\n"], k=rng.choice([0, 40, 300])))
        (tmp_path / f"{n}.csv").write_bytes(("head\n" + text).encode())
        expected[f"{n}.csv"] = ["head", *single_pass(text)]
    small_splits(size)
    rows = records.read_records(spark, str(tmp_path)).orderBy("file", "block", "place").collect()
    found = {name: [r.record for r in rows if r.file.endswith("/" + name)] for name in expected}
    assert found == expected


@pytest.mark.parametrize("most_keys", [0, 1_000_000])
def test_values_as_the_csv_module_reads_them(spark, tmp_path, small_splits, monkeypatch, most_keys):
    monkeypatch.setattr(records, "MOST_KEYS", most_keys)
    rng = random.Random(2)
    rows = [[str(i), "".join(rng.choices(["x", "\n", '"', ",", " ", "ü", "\r\n"], k=rng.randrange(1, 60))) + "z", "end"] for i in range(200)]
    text = io.StringIO(newline="")
    csv.writer(text, lineterminator="\n").writerows([["id", "text", "tail"], *rows])
    path = tmp_path / "rows.csv"
    path.write_bytes(text.getvalue().encode())
    small_splits(150)
    frame = files.read_csv(spark, str(path), ["id", "text", "tail"], multi_line=True)
    assert sorted(tuple(r)[:3] for r in frame.collect()) == sorted(map(tuple, rows))
    assert records.read_records(spark, str(path)).select("block").distinct().count() > 20
    assert files.require_valid_csv(spark, str(path), multi_line=True) == 200


@pytest.mark.parametrize("size", [40, 1000])
def test_bad_records_and_their_place(spark, tmp_path, small_splits, size):
    path = tmp_path / "bad.csv"
    good = "".join(f'{i},"two\nlines"\n' for i in range(30))
    path.write_text("a,b\n" + good + '30,"x\ny",too many\n' + good)
    small_splits(size)
    row = files.validate_csv(spark, str(path), multi_line=True).first()
    assert (row.ok, row.rows, row.bad_rows, row.rows_before_bad) == (False, 60, 1, 30)
    with pytest.raises(Exception, match="malformed CSV record"):
        files.read_csv(spark, str(path), ["a", "b"], multi_line=True).collect()
    with pytest.raises(SourceError):
        files.read_csv(spark, str(path), ["a", "c"], multi_line=True)


def test_no_records(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    assert records.read_records(spark, str(tmp_path)).count() == 0
    (tmp_path / "open.csv").write_text('a\n"never closed\nto the end')
    rows = records.read_records(spark, str(tmp_path)).orderBy("place").agg(F.collect_list("record")).first()[0]
    assert rows == ["a", '"never closed\nto the end']
