"""op13 against a plain restatement byte by byte with the libraries, and rows of every odd kind."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from farebox.llm import alignment

BYTES = str(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def libraries(model_path):
    a = Tokenizer.from_file(BYTES)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=model_path)


@pytest.fixture(scope="module")
def aligner(model_path):
    with open(BYTES) as a, open(model_path, "rb") as b:
        return alignment.Aligner(a.read(), b.read())


def brute_links(ends_a, ends_b):
    """Every pair of tokens compared by their byte ranges."""
    spans = [list(zip([0, *e], e, strict=False)) for e in (ends_a, ends_b)]
    return [(i, j) for i, (s, e) in enumerate(spans[0]) for j, (t, f) in enumerate(spans[1]) if max(s, t) < min(e, f)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=40), st.lists(st.integers(1, 4), min_size=1, max_size=40), st.integers(1, 9))
def test_pieces_give_all_overlaps(a, b, piece):
    a, b = np.cumsum(a), np.cumsum(b)
    last = max(a[-1], b[-1])
    a, b = (np.append(x[x < last], last) for x in (a, b))
    x, y, groups, closed_a, closed_b = alignment.align(a, b, piece)
    assert list(zip(x.tolist(), y.tolist(), strict=True)) == brute_links(a.tolist(), b.tolist())
    shared = sorted(set(a.tolist()) & set(b.tolist()))
    assert (a[closed_a - 1].tolist(), b[closed_b - 1].tolist()) == (shared, shared)
    assert groups.tolist() == [sum(s < min(a[i], b[j]) for s in shared) for i, j in zip(x, y, strict=True)]


def test_crossings_split_the_merge():
    a, b = np.array([2, 4, 4, 9]), np.array([1, 4, 4, 4, 9])
    merged = sorted([(v, 0) for v in a] + [(v, 1) for v in b])
    expected = [sum(s == 0 for _, s in merged[:d]) for d in range(10)]
    assert alignment.crossings(a, b, np.arange(10)).tolist() == expected


@settings(max_examples=150, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" ▁aelthings.,!-=\n\t0é中'"), st.characters(codec="utf-8")), max_size=60))
def test_ids_as_the_libraries(aligner, libraries, text):
    a, b = libraries
    assert aligner.a.encode([" " + text]) == [a.encode(" " + text, add_special_tokens=False).ids]
    assert aligner.b.encode([text]) == [b.encode(text)]


def test_the_general_library_is_the_fallback(aligner):
    texts = [" It's 12  <|endoftext|>", "\n\t é中"]
    assert aligner.a._library()(texts) == aligner.a.encode(texts)


def brute(rows, libraries):
    a, b = libraries
    letters = {}
    n = 0
    for byte in range(256):
        if 0x21 <= byte <= 0x7E or 0xA1 <= byte <= 0xAC or 0xAE <= byte <= 0xFF:
            letters[chr(byte)] = byte
        else:
            letters[chr(256 + n)] = byte
            n += 1
    documents, counts = [], Counter()
    for doc_id, text in rows:
        ids = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
        of_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids[0]]
        of_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]]
        whole = b" " + (text or "").encode()
        if not text or b"".join(of_a) != whole or b"".join(of_b) != whole:
            documents.append((doc_id, ([], []), [], [], 0, ""))
            continue
        ends = [np.cumsum([len(x) for x in side]).tolist() for side in (of_a, of_b)]
        links, i, j = [], 0, 0
        while i < len(ends[0]):
            links.append((ids[0][i], ids[1][j]))
            x, y = ends[0][i], ends[1][j]
            i, j = i + (x <= y), j + (y <= x)
        shared = sorted(set(ends[0]) & set(ends[1]))
        shown, at = [], [0, 0]
        for s in shared:
            to = [e.index(s) + 1 for e in ends]
            shown.append("|".join(",".join(map(str, side[f:t])) for side, f, t in zip(ids, at, to, strict=True)))
            at = to
        documents.append((doc_id, ids, links, shared, len(shared), hashlib.sha256(";".join(shown).encode()).hexdigest()))
        counts.update(links)
    highest = Counter()
    for (_, y), c in counts.items():
        highest[y] = max(highest[y], c)
    return [
        (d, len(ids[0]), len(ids[1]), n, len(ls), sum(counts[p] == highest[p[1]] for p in ls), sum(counts[p] for p in ls), sha)
        for d, ids, ls, _, n, sha in documents
    ]


def test_as_the_plain_restatement(spark, libraries, model_path, odd_documents):
    some = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").where("length(text) < 20000")
    extra = spark.createDataFrame([(9001, "<|endoftext|> <s> </s>"), (9002, "a▁b"), (9003, "x  y\n\n  z"), (9004, "😀é" * 300)], "doc_id long, text string")
    frame = some.union(extra).union(odd_documents.where("length(text) < 40000 OR text IS NULL").select("doc_id", "text"))
    got = alignment.align_documents(frame.selectExpr("*", "'clash' AS chunk", "0 AS pair", "1 AS n"), BYTES, model_path)
    expected = brute([tuple(r) for r in frame.collect()], libraries)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, expected))


def test_long_texts_and_empty_tables(spark, model_path, odd_documents, no_documents):
    long = odd_documents.where("doc_id IN (5, 6)")
    rows = {r.doc_id: r for r in alignment.align_documents(long, BYTES, model_path).collect()}
    assert rows[5].n_links >= 30_000 and rows[5].n_groups >= 30_000 and rows[6].n_links > 1000
    empty = alignment.align_documents(no_documents, BYTES, model_path)
    assert empty.count() == 0 and len(empty.columns) == 8


def test_small_pieces_change_nothing(aligner):
    texts = [b"one two three " * 500, b"", "é中😀 ".encode() * 200, b"z" * 3000]
    whole, parts = aligner.chunk(texts), aligner.chunk(texts, piece=7)
    assert all(np.array_equal(whole[k], parts[k]) for k in whole)
