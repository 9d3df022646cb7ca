from __future__ import annotations

import gzip
import hashlib
import re

from pyspark.sql import functions as F

from farebox.llm import warc

PAGES = [
    (3, "http://a/é x", "x" * 200), (1, "u\n", "x" * 200), (2, None, None), (4, "u", ""), (None, "q", "x" * 200), (5, "u", "é" * 50),
    (6, "u", "é" * 50), (5, "u", "é" * 50), (7, "u", "y" * 99), (8, "u", "y" * 99), (9, "u", "<p>" + "z\r\n\r\n" * 40_000),
]


def test_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    got = sorted(map(repr, map(tuple, warc.round_trip(pages).collect())))
    expected = []
    for i, _, html in PAGES:
        payload = (html or "").encode()
        same = [p for p, _, h in PAGES if (h or "").encode() == payload and p is not None]
        again = len(payload) >= 100 and i != min(same)
        expected.append((i, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if again else "response", min(same) if again else None))
    assert got == sorted(map(repr, expected))
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_predicates_reach_the_scan_and_payloads_can_be_left_out(spark, tmp_path):
    path = f"file://{tmp_path}/archive"
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    warc.write_archives(pages, path)
    warc.write_archives(pages.where("page_id = 9"), path)  # archives are added to
    back = warc.read_archives(spark, path)
    wanted = back.where("record_type = 'response' AND page_id >= 7 AND url LIKE 'u%'")
    assert not re.search(r"\) Filter", wanted._jdf.queryExecution().executedPlan().toString())
    assert sorted(r.page_id for r in wanted.collect()) == [7, 8, 9, 9]
    assert {r.page_id for r in back.where("refers_to = 1").collect()} == {3, None}
    assert {bytes(r.payload).decode() for r in back.where("page_id = 9").collect()} == {PAGES[-1][2]}
    bare = warc.read_archives(spark, path, payloads="false").where("record_type = 'response'")
    assert {r.payload for r in bare.collect()} == {None}


def test_archives_of_other_writers(spark, tmp_path):
    made = [warc.record(i, "u", "response", None, "d", 3, b"abc" * i) for i in (1, 2, 900)] + [warc.record(7, "u", "revisit", 1, "d", 3, b"")]
    (tmp_path / "a.warc").write_bytes(b"".join(made))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(m) for m in made))
    rows = warc.read_archives(spark, str(tmp_path)).collect()
    assert sorted((r.page_id, r.record_type, len(r.payload or b"")) for r in rows) == sorted(
        [(1, "response", 3), (2, "response", 6), (900, "response", 2700), (7, "revisit", 0)] * 2
    )
    assert warc.read_archives(spark, str(tmp_path)).where("record_type = 'revisit'").count() == 2


def test_each_member_can_be_skipped(tmp_path):
    data = warc.record(1, "u", "response", None, "d", 5, b"hello")
    member = warc.member(data)
    assert gzip.decompress(member + member) == data * 2
    assert int.from_bytes(member[16:20], "little") == len(member)
