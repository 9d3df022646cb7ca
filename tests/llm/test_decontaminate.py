from __future__ import annotations

import pickle
import random

import numpy as np
import pytest

from farebox.llm import decontaminate as dc
from farebox.llm.text import words


def brute(items, ws, window):
    hit, found = np.zeros(len(ws), bool), set()
    for item, own, _ in items:
        for j in range(max(1, len(own) - window + 1)) if own else ():
            part = own[j : j + window]
            for k in range(len(ws) - len(part) + 1):
                if ws[k : k + len(part)] == part:
                    hit[k : k + len(part)] = True
                    found.add(item)
    return hit, found


def test_matcher_against_brute_force():
    rng = random.Random(1)
    for n in range(1500):
        window = rng.choice([1, 2, 3, 10])
        letters = [b"a", b"b", b"c", b"d"][: rng.choice([2, 3, 4])]
        items = [
            (i, rng.choices(letters, k=rng.randint(0, 9) if rng.random() < 0.5 else rng.randint(window, 20)), True)
            for i in range(rng.randint(0, 6))
        ]
        ws = rng.choices(letters + [b"z"] * (n % 2), k=rng.randint(0, 40))
        if items and n % 3 == 0:
            ws[5:5] = items[0][1]
        matcher = dc.Matcher(items, window)
        hit, found = np.zeros(len(ws), bool), set()
        matcher.find(ws, hit, found)
        expected_hit, expected = brute(items, ws, window)
        assert (hit == expected_hit).all() and found == expected


@pytest.fixture(scope="module")
def benchmark(spark):
    long = " ".join(f"w{i}" for i in range(2500))
    rows = [(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "Short ITEM"), (3, None), (4, ""), (None, "no id"), (5, long)]
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize("block_words", [100_000, 300])  # one block; blocks over several passes
def test_scan(spark, benchmark, odd_documents, no_documents, block_words):
    texts = [
        (10, "x one two three four five six seven eight nine ten y"), (11, "one two three four five six seven eight nine"),
        (12, "a short item, short item"), (13, "short"), (14, " ".join(f"W{i}" for i in range(990, 1015))), (15, None),
    ]
    docs = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 AS n_hit", "'a' AS item_id")
    got = {r.doc_id: r for r in dc.scan(docs, benchmark, block_words=block_words).collect()}
    items = [(r.item_id, words((r.text or "").encode()), True) for r in benchmark.where("item_id is not null").collect()]
    for doc_id, text in texts:
        ws = words((text or "").encode())
        hit, found = brute(items, ws, 10)
        r = got[doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(ws), hit.sum(), len(found), bool(found))
    assert dc.scan(odd_documents, benchmark, block_words=block_words).count() == odd_documents.count()
    assert dc.scan(no_documents, benchmark).count() == 0
    assert not dc.scan(docs, benchmark.limit(0)).where("contaminated").count()


def test_clean_cuts_spans_and_drops_covered_documents(spark, benchmark, odd_documents):
    passage = "One, two three four five six seven eight nine ten!"
    filler = " ".join(f"f{i}" for i in range(60))
    rows = [(1, f"{filler} {passage} end"), (2, passage), (3, "clean"), (4, None)]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, n_chars long")
    kept = {r.doc_id: r for r in dc.clean(docs, benchmark).collect()}
    assert set(kept) == {1, 3, 4}
    assert kept[1].text == f"{filler} ! end" and kept[1].n_chars == len(kept[1].text) and kept[3].n_chars == 7
    spans = [tuple(r) for r in dc.spans(docs, benchmark).orderBy("doc_id").collect()]
    assert spans == [(1, 60, 10), (2, 0, 10)]
    same = dc.clean(odd_documents, benchmark)
    assert same.schema == odd_documents.schema and same.exceptAll(odd_documents).count() == 0
    assert same.count() == odd_documents.count()


def test_automata_are_built_in_tasks(spark, benchmark, monkeypatch):
    def on_driver(*_):
        raise AssertionError("built on the driver")

    monkeypatch.setattr(dc, "Matcher", on_driver)  # not in the workers
    n_blocks, fetch = dc._blocks(benchmark.where("item_id IS NOT NULL"), 10, 300)
    monkeypatch.undo()
    blocks = [pickle.loads(b) for b in map(fetch, range(n_blocks)) if b]
    assert n_blocks > 1 and len(blocks) > 1
    items = {i: words((text or "").encode()) for i, text in benchmark.select("item_id", "text").collect() if i is not None}
    found = {i for b in blocks for own in b.items.values() for i in own}
    assert found == {i for i, ws in items.items() if len(ws) >= 10}


def test_repeated_items_fill_no_block(spark):
    same = "one passage that very many items of the benchmark share word for word without any change"
    rows = [(i, same) for i in range(10_000)] + [(20_000 + i, f"item {i} " + " ".join(f"v{i * 31 % 977}x{k}" for k in range(40))) for i in range(200)]
    bench = spark.createDataFrame(rows, "item_id long, text string")
    n_blocks, fetch = dc._blocks(bench, 10, 1000)
    assert n_blocks == -(-(16 + 200 * 42) // 1000)
    sizes = [len(pickle.loads(fetch(b)).automaton.length) for b in range(n_blocks) if fetch(b)]
    assert len(sizes) == n_blocks and max(sizes) < 3 * min(sizes)
    docs = spark.createDataFrame([(1, "x " + same + " y"), (2, "nothing here")], "doc_id long, text string")
    got = {r.doc_id: r for r in dc.scan(docs, bench, block_words=1000).collect()}
    assert (got[1].n_items, got[1].n_hit, got[2].n_items) == (10_000, 16, 0)
