"""op9 and op6 against the libraries themselves."""

from __future__ import annotations

import hashlib
import random
import struct

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer
from tokenizers.models import Unigram

from farebox.llm import pieces, unigram
from farebox.llm.vocabulary import escaped, load


@pytest.fixture(scope="module")
def library(model_path):
    return sentencepiece.SentencePieceProcessor(model_file=model_path)


@pytest.fixture(scope="module")
def coder(model_path):
    return pieces.PieceCoder(load(model_path))


@pytest.fixture(scope="module")
def counter(model_path):
    return unigram.UnigramCounter(load(model_path))


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" ▁aelthings.,!-=\n\t0é中"), st.characters(codec="utf-8")), max_size=60))
def test_encode_and_decode_as_the_library(coder, library, text):
    ids = library.encode(text)
    assert coder.encode(text) == ids
    assert coder.decode(ids) == library.decode(ids)


def test_runs_of_spaces_and_pieces(coder, library):
    rng = random.Random(4)
    some = [p for p in coder.v.strings if p][:4000]
    texts = [" " * n + "the" for n in range(70)] + ["".join(rng.choices(some, k=25)) for _ in range(800)]
    assert [coder.encode(t) for t in texts] == library.encode(texts, num_threads=1)


def test_decoding_any_ids(coder, library):
    rng = random.Random(2)
    for _ in range(2000):
        ids = [rng.randrange(3, 259) if rng.random() < 0.6 else rng.randrange(32000) for _ in range(7)]
        assert coder.decode(ids) == library.decode(ids)


def test_unigram_counts_as_the_library(counter, library):
    low = min(library.get_score(i) for i in range(259, library.vocab_size()))
    vocabulary = [(library.id_to_piece(i), library.get_score(i) if i >= 259 else low) for i in range(library.vocab_size())]
    own = Tokenizer(Unigram(vocabulary, unk_id=0, byte_fallback=False))
    rng = random.Random(3)
    some = [p for p, _ in vocabulary[259:6000]]
    texts = ["", " ", "a  b", "\n\n", "😀 a\n"] + ["".join(rng.choices(some + [" ", "\n", "😀"], k=20)).replace("▁", " ") for _ in range(800)]
    for text in texts:
        full = escaped(text)
        found = own.encode(full, add_special_tokens=False)
        n = sum(1 if i else len(full[a:b].encode()) for i, (a, b) in zip(found.ids, found.offsets, strict=True))
        assert counter.count(text)[1] == n, text


def model_file(path, pieces, byte_pieces=False, strip=False):
    """A unigram model written by hand: protobuf fields of pieces, trainer and normaliser."""

    def block(number, body):
        size, n = b"", len(body)
        while n > 127:
            size, n = size + bytes([n & 127 | 128]), n >> 7
        return bytes([number << 3 | 2]) + size + bytes([n]) + body

    def piece(text, score, kind):
        return block(1, block(1, text.encode()) + b"\x15" + struct.pack("<f", score) + bytes([0x18, kind]))

    made = piece("<unk>", 0, 2) + piece("<s>", 0, 3) + piece("</s>", 0, 3)
    if byte_pieces:
        made += b"".join(piece(f"<0x{b:02X}>", 0, 6) for b in range(256))
    made += b"".join(piece(p, s, 1) for p, s in pieces.items())
    trainer = bytes([0x18, 1]) + (bytes([35 << 3 & 127 | 128, 2, 1]) if byte_pieces else b"")
    normaliser = block(1, b"identity") + bytes([0x18, 1, 0x20, strip, 0x28, 1])
    path.write_bytes(made + block(2, trainer) + block(3, normaliser))
    return str(path)


@pytest.mark.parametrize("planted", [True, False])  # scores with many equal sums, and any scores
@pytest.mark.parametrize("byte_pieces", [True, False])
def test_fractional_scores_as_the_library(tmp_path, planted, byte_pieces):
    rng = random.Random(11 + 2 * planted + byte_pieces)
    for k in range(12):
        letters = "ab▁é中"[: rng.randint(2, 5)]
        own = {"".join(rng.choices(letters, k=rng.randint(1, 5))) for _ in range(rng.randint(3, 60))}
        scores = {p: -rng.randint(1, 40) / 8 if planted else struct.unpack("f", struct.pack("f", -rng.random() * 9))[0] for p in sorted(own)}
        path = model_file(tmp_path / f"{k}.model", scores, byte_pieces, strip=k % 3 == 0)
        library, counter = sentencepiece.SentencePieceProcessor(model_file=path), unigram.UnigramCounter(load(path, plain=False))
        for n in [0, 1, 2, 5] + [rng.randint(3, 300) for _ in range(60)]:
            text = "".join(rng.choices("aab é中z\n", k=n))
            assert counter.count(text)[1] == len(library.encode(text)), (k, text)
        text = "".join(rng.choices("ab ", k=20_000))  # sums far beyond what single precision keeps apart
        assert counter.count(text)[1] == len(library.encode(text)), k


def test_fractional_scores_in_spark(spark, tmp_path, odd_documents):
    path = model_file(tmp_path / "f.model", {"▁a": -1.25, "a▁b": -1.5, "a": -2.125, "b": -2.0, "▁": -3.5, "e": -2.75}, True, True)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = unigram.token_counts(odd_documents, path).select("doc_id", "n_tokens").collect()
    expected = [(r.doc_id, len(library.encode(r.text or ""))) for r in odd_documents.select("doc_id", "text").collect()]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))
    with pytest.raises(ValueError):
        pieces.encode(odd_documents, path)


def test_digests_round_trip_and_odd_rows(spark, library, odd_documents, no_documents, model_path):
    rows = pieces.encode_digest(odd_documents, model_path).collect()
    expected = []
    for r in odd_documents.select("doc_id", "text").collect():
        ids = library.encode(r.text or "")
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), library.decode(ids))]
        expected.append((r.doc_id, len(ids), *sha))
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, expected))
    back = pieces.decode(pieces.encode(odd_documents, model_path), model_path)
    assert sorted(repr(r.text) for r in back.collect()) == sorted(repr(r.text or "") for r in odd_documents.select("text").collect())
    assert pieces.encode_digest(no_documents, model_path).count() == 0
    counts = unigram.token_counts(odd_documents, model_path)
    assert counts.columns == ["doc_id", "n_tokens", "n_unknown", "best_score"]
    assert {r.doc_id: r.n_tokens for r in counts.collect()}[3] == 0 and counts.count() == odd_documents.count()
    assert unigram.token_counts(no_documents, model_path).count() == 0
