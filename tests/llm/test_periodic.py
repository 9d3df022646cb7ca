"""op11 against a search over all periods, and rows of every odd kind."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from farebox.llm import periodic


def brute(words):
    """For each period the stretches in which words that far apart agree, kept where no shorter period holds."""
    n, out = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            end = i
            while end + q < n and words[end] == words[end + q]:
                end += 1
            length = end - i + q
            stretch = words[i : i + length]
            if length >= max(24, 3 * q) and not any(all(stretch[k] == stretch[k + p] for k in range(length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = end
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain(words):
    return [str(w).encode() for w in words]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 1), max_size=90), max_size=4))
def test_few_words(documents):
    documents = [plain(d) for d in documents]
    assert periodic.find(documents) == [brute(d) for d in documents]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=14), st.integers(1, 12)), max_size=6), st.integers(0, 5))
def test_repeated_phrases(parts, tail):
    words = plain([w for phrase, n in parts for w in phrase * n + phrase[:tail]])
    assert periodic.find([words, words]) == [brute(words)] * 2


def test_planted_documents():
    rng = random.Random(8)
    for doc_id in range(400):
        words = plain(rng.choices(range(60), k=rng.randrange(200)))
        made = periodic.planted(doc_id, words)
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        expected = list(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + int((n - a) / (3 + g % 8))
            for i in range(a, n):
                expected[i] = words[a + (i - a) % p]
        assert made == expected
        assert periodic.find([made]) == [brute(made)]


def test_long_texts_take_little_time():
    rng = random.Random(3)
    phrase = plain(range(700))
    cases = [plain(["a"] * 200_000), phrase * 300, plain(rng.choices("ab", k=60_000)), plain([w for k in range(2, 200) for w in list(range(k)) * 4])]
    start = time.process_time()
    found = periodic.find(cases)
    assert time.process_time() - start < 60
    assert found[0] == [(0, 200_000, 1)] and found[1] == [(0, 210_000, 700)] and len(found[3]) >= 190


def test_rows(spark, odd_documents, no_documents):
    repeated = [(100 + k, " ".join(f"w{i % (k + 1)}" for i in range(60 + k))) for k in range(12)] + [(110, "\x0b".join(["x"] * 30) + " y")]
    frame = odd_documents.select("doc_id", "text").union(spark.createDataFrame(repeated, "doc_id long, text string"))
    got = periodic.digest(frame.selectExpr("*", "'clash' AS start", "0 AS n_runs"), periodic.planted)
    expected = []
    for doc_id, text in frame.collect():
        words = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        words = periodic.planted(doc_id, words)
        runs = [(0, len(words), 1)] if len(words) == 30_000 else brute(words)
        dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        expected.append((
            doc_id, len(runs), *(best or [None] * 3), best[1] * 1000 // best[2] if best else None,
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(),
        ))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, expected))
    assert periodic.digest(no_documents).count() == 0 and periodic.runs(no_documents).count() == 0
    runs = periodic.runs(frame).where("doc_id = 105").collect()
    assert [tuple(r) for r in runs] == [(105, 0, 65, 6)]
    texts = {r.doc_id: r.text for r in periodic.collapse(frame).where("doc_id >= 100").collect()}
    assert texts[105] == "w0 w1 w2 w3 w4 w5" and texts[110] is not None


@pytest.mark.parametrize("documents", [[], [[]], [[], plain([1]), []]])
def test_nothing_to_find(documents):
    assert periodic.find(documents) == [[] for _ in documents]
