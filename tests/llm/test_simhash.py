from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from farebox.llm import components, simhash


def by_definition(text: str | None) -> int:
    ws = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({9: " ", 10: " ", 11: " ", 12: " ", 13: " "}).split(" ") if w]
    if not ws:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(ws[i : i + 4]), 42) for i in range(max(1, len(ws) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(odd_documents):
    texts = ["", "a", "A b", "a b c d e", "é É\x85x \x1c y", "to be or not to be or not to be"]
    assert [simhash.fingerprint(t.encode()) for t in texts] == [by_definition(t) for t in texts]
    got = sorted(repr((r.doc_id, r.fp % 2**64)) for r in simhash.fingerprints(odd_documents).collect())
    assert got == sorted(repr((r.doc_id, by_definition(r.text))) for r in odd_documents.select("doc_id", "text").collect())


def test_anchors_find_every_pair(spark):
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = set(base)
    for f in base:
        for _ in range(12):
            for bit in rng.sample(range(64), rng.randint(1, 6)):
                f ^= 1 << bit
            fps.add(f)
    fps = np.array(sorted(fps), np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    signed = fps.astype(np.int64).tolist()
    expected = {tuple(sorted((signed[i], signed[j]))) for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True)}
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    assert {(r.a, r.b) for r in simhash.linked_pairs(frame).collect()} == expected


def test_components_of_chains_stars_and_cycles(spark):
    pairs = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 30)] + [(50, 51), (51, 52), (52, 50), (52, 52), (None, 3)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "x long, y long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 1 for i in range(1, 30)} | {50: 50, 51: 50, 52: 50}
    assert components.components(spark.createDataFrame([], "x long, y long")).count() == 0


def test_near_duplicates_and_keeping_one(spark, odd_documents, no_documents):
    long = " ".join(f"w{i}" for i in range(300))
    rows = [(9, long), (4, long + " more"), (7, long), (1, "other text here now"), (2, None), (3, ""), (4, "a second row of this id"), (None, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(1)).withColumn("component_id", F.lit("x"))
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(docs).collect()}
    for i, text in rows:
        mine = [d for d, t in rows if bin(by_definition(t) ^ by_definition(text)).count("1") <= 4 and d is not None]
        assert got[i, f"{by_definition(text):016x}"] == min(mine)
    kept = simhash.keep_one(docs)
    assert kept.schema == docs.schema
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == [
        (1, "other text here now"), (2, ""), (4, "a second row of this id"), (4, long + " more")
    ]
    assert simhash.near_duplicates(odd_documents).count() == odd_documents.count()
    assert simhash.keep_one(odd_documents).count() > 0
    assert simhash.near_duplicates(no_documents).count() == 0 and simhash.keep_one(no_documents).count() == 0


@pytest.mark.parametrize("bits", [b for _, b in simhash.BLOCKS])
def test_every_value_is_near_an_anchor(bits):
    syndromes, offsets = simhash._syndromes(), simhash._offsets(bits, 2)
    rng = np.random.default_rng(2)
    for value in rng.integers(0, 1 << bits, 300):
        anchors = int(value) ^ offsets[syndromes[value & 0x7FFF]]
        assert (syndromes[anchors & 0x7FFF] == 0).all() and np.bitwise_count(anchors[0] ^ int(value)) <= simhash.RADIUS
        moved = int(value) ^ (1 << int(rng.integers(bits)))
        assert anchors[0] in moved ^ offsets[syndromes[moved & 0x7FFF]]


def test_tables_that_grow_with_the_documents_are_never_broadcast(spark, monkeypatch):
    """However small their files are: a file of fingerprints is some forty times smaller than their anchored rows."""
    plans, cut = [], simhash.cut

    def noted(df, label):
        plans.append(df._jdf.queryExecution().toString())
        return cut(df, label)

    monkeypatch.setattr(simhash, "cut", noted)
    monkeypatch.setattr(components, "cut", noted)
    docs = spark.createDataFrame([(i, f"some text of number {i // 2}") for i in range(20)], "doc_id long, text string")
    for made in (simhash.near_duplicates(docs), simhash.keep_one(docs)):
        assert made.count() in (10, 20)
        plans.append(made._jdf.queryExecution().toString())
    assert sum("SortMergeJoin" in p for p in plans) >= 6
    sent = [line for p in plans for line in p.splitlines() if "BroadcastHashJoin" in line or "BroadcastNestedLoopJoin" in line]
    assert not [line for line in sent if "[root#" not in line]  # roots are summed up by a shuffle, which tells their size
