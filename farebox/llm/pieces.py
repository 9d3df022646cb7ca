"""SentencePiece BPE encoding and decoding by a table of last tokens.

For every prefix of a text exactly one token can be the last one of the prefix's encoding: a piece that ends there,
and that stands unmerged behind the last token of what is left of it. An automaton lists the pieces that end at each
place; a pair is compatible if merging its joined text gives back the pair. Ids are then read off from the end.

A text is split into units first (space marks and the word behind them). No piece crosses the end of a unit, so units
are encoded apart, and equal units once while they stay in a bounded cache.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import ahocorasick
from pyspark.sql import DataFrame

from farebox.llm.text import per_row
from farebox.llm.vocabulary import SPACE, Recent, Vocabulary, escaped, load, unit_pattern

CACHED_UNITS = 400_000  # per worker
CACHED_PAIRS = 600_000


class PieceCoder:
    """Encodes and decodes inside a task."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.byte_of = {i: b for b, i in enumerate(vocabulary.byte_ids)}
        self.split = unit_pattern(vocabulary).findall
        self.automaton = ahocorasick.Automaton()
        self.pairs: list[dict[str, bool]] = []  # by piece, whether it stands apart behind another
        self.halves: dict[str, tuple[str, str]] = {}  # by piece, what its last merge joined
        self.direct: set[str] = set()  # pieces merged no later than their halves: equal scores, settled by place
        for piece in vocabulary.ids:
            parts, halves = self.merged(piece)
            if parts != [piece]:
                continue  # never comes out of merging
            self.pairs.append({})
            self.automaton.add_word(piece, (piece, len(piece), self.pairs[-1]))
            if halves:
                self.halves[piece] = halves
                if self.direct.intersection(halves) or max(map(self.time, halves)) >= self.time(piece):
                    self.direct.add(piece)
        self.automaton.make_automaton()
        self.lefts: dict[str, list[tuple[str, float]]] = {}
        self.rights: dict[str, list[tuple[str, float]]] = {}
        self.shown = [(p or "").replace(SPACE, " ") for p in vocabulary.strings]
        self.shown[vocabulary.unk_id] = " ⁇ "
        self.n_pairs = 0
        self.texts_by_unit = Recent(self.unit, CACHED_UNITS)
        self.ids_by_unit = Recent(self.unit_ids, CACHED_UNITS)

    def merged(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """The merge rule itself, for short texts: best score first, leftmost first among equals; the last merge."""
        score, parts, halves = self.v.scores.get, list(text), None
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            halves = parts[at], parts[at + 1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts, halves

    def time(self, token: str) -> float:
        """When a token is merged: single characters are there from the start."""
        return -self.v.scores[token] if token in self.halves else -math.inf

    def edge(self, token: str, side: int) -> list[tuple[str, float]]:
        """What stands at the left (0) or right (1) end of a token while it is merged, each until when."""
        out, until = [], math.inf
        while True:
            out.append((token, until))
            if token not in self.halves:
                return out[::-1]
            until = self.time(token)
            token = self.halves[token][side]

    def compatible(self, left: str, right: str) -> bool:
        """Whether two tokens stay apart when their joined text is merged.

        Both grow as they would alone until something merges across; at each moment that is possible only for what
        then stands at the two sides of the border.
        """
        if left in self.direct or right in self.direct:
            return self.merged(left + right)[0] == [left, right]
        a, b = self.rights.get(left), self.lefts.get(right)
        if a is None:
            a = self.rights[left] = self.edge(left, 1)
        if b is None:
            b = self.lefts[right] = self.edge(right, 0)
        score, i, j = self.v.scores.get, 0, 0
        while True:
            x, x_until = a[i]
            y, y_until = b[j]
            s = score(x + y)
            if s is not None and -s < x_until and -s <= y_until:  # among equals the leftmost goes first
                return False
            if x_until <= y_until:
                if x_until == math.inf:
                    return True
                i += 1
            else:
                j += 1

    def pair(self, left: str, right: str, known: dict[str, bool]) -> bool:
        if self.n_pairs >= CACHED_PAIRS:
            self.n_pairs = 0
            for pairs in self.pairs:
                pairs.clear()
        self.n_pairs += 1
        found = known[left] = self.compatible(left, right)
        return found

    def tokens(self, unit: str) -> list[str]:
        """Tokens of a unit; characters that are no piece stand for themselves."""
        last: list[str] = []
        done = 0  # prefixes of up to so many characters have their last token
        check = self.pair
        for end, (piece, length, known) in self.automaton.iter(unit):
            if end < done:
                continue
            while done < end:
                last.append(unit[done])
                done += 1
            if length <= end:
                before = last[end - length]
                ok = known.get(before)
                if ok is None:
                    ok = check(before, piece, known)
                if not ok:
                    continue
            last.append(piece)
            done += 1
        last.extend(unit[done:])
        out, end = [], len(unit)
        while end:
            token = last[end - 1]
            out.append(token)
            end -= len(token)
        return out[::-1]

    def ids_of(self, token: str) -> tuple[int, ...]:
        i = self.v.ids.get(token)
        if i is not None:
            return (i,)
        if self.v.byte_ids[0] < 0:
            return (self.v.unk_id,)
        return tuple(self.v.byte_ids[b] for b in token.encode())

    def unit_ids(self, unit: str) -> tuple[int, ...]:
        return tuple(i for t in self.tokens(unit) for i in self.ids_of(t))

    def unit(self, unit: str) -> tuple[str, str]:
        """The ids as text, and the text they decode to."""
        tokens = self.tokens(unit)
        try:
            ids = [self.v.ids[t] for t in tokens]
            return ",".join(map(str, ids)), "".join([self.shown[i] for i in ids])
        except KeyError:
            ids = [i for t in tokens for i in self.ids_of(t)]
            return ",".join(map(str, ids)), self.spelled(ids)

    def encode(self, text: str) -> list[int]:
        return [i for ids in self.ids_by_unit.all(self.split(escaped(text))) for i in ids]

    def spelled(self, ids: tuple[int, ...] | list[int]) -> str:
        """Text of ids with its leading space. Runs of byte pieces are read as UTF-8, each broken byte as U+FFFD."""
        out, raw = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(_utf8(bytes(raw)))
                raw.clear()
            out.append(self.shown[i])
        if raw:
            out.append(_utf8(bytes(raw)))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """Text of ids. The space of a first piece is the one that encoding has put there; a byte piece has none."""
        text = self.spelled(ids)
        return text.removeprefix(" ") if ids and ids[0] not in self.byte_of else text


def _utf8(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[at : at + n].decode())
                    at += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


_CODERS: dict[str, PieceCoder] = {}  # one per worker process and model, with its cache


def _coder(docs: DataFrame, model_path: str) -> Callable[[], PieceCoder]:
    shared = docs.sparkSession.sparkContext.broadcast(load(model_path))  # one entry per piece of the file

    def get() -> PieceCoder:
        if model_path not in _CODERS:
            _CODERS[model_path] = PieceCoder(shared.value)
        return _CODERS[model_path]

    return get


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """`doc_id, ids array<int>` of every whole text, as the library encodes it without begin or end ids.

    A null or empty text has no ids. Rows that repeat are encoded each; a null doc_id stays null.
    """
    coder = _coder(docs, model_path)

    def work():
        c = coder()
        return lambda doc_id, text: (doc_id, c.encode(text.decode(errors="replace")))

    return per_row(docs, ["doc_id", "text"], "doc_id long, ids array<int>", work)


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """`doc_id, text` of `doc_id, ids`; null ids decode to the empty text."""
    coder = _coder(encoded, model_path)

    def work():
        c = coder()
        return lambda doc_id, ids: (doc_id, c.decode(ids or []))

    return per_row(encoded, ["doc_id", "ids"], "doc_id long, text string", work)


def encode_digest(docs: DataFrame, model_path: str) -> DataFrame:
    """`doc_id, n_tokens, ids_sha256, decoded_sha256`: encoding and decoding in one pass, without the ids themselves.

    One row per document, repeated rows included; a null or empty text has no tokens and the digests of nothing.
    """
    coder = _coder(docs, model_path)

    def work():
        c = coder()

        def row(doc_id, text):
            parts = c.texts_by_unit.all(c.split(escaped(text.decode(errors="replace"))))
            ids = ",".join([p[0] for p in parts]).encode()
            back = "".join([p[1] for p in parts]).removeprefix(" ").encode()  # the first unit begins with a piece
            n = ids.count(b",") + 1 if ids else 0
            return doc_id, n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()

        return row

    return per_row(
        docs, ["doc_id", "text"], "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", work
    )
