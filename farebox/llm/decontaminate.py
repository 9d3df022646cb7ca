"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton holds every run of consecutive words of every item. A document's words are streamed through it; at each
word it gives the length of the longest run of item words that ends there. A window is `window` consecutive item words
(an item with fewer words, but not none, is one window). All words of a run that reaches a window are hit.

Items are cut into overlapping pieces and dealt to blocks of bounded size. Each block's automaton is built in a task of its
own and written to the shared folder; the driver only passes its bytes on as a broadcast. All documents are streamed
through every block. Before a document enters an automaton, its words are
looked up together: a run of words whose neighbours never stand side by side in an item can't reach a window.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farebox.llm.text import blobs, small_batches, word_spans, words
from farebox.session import cut

WINDOW = 10
BLOCK_WORDS = 100_000  # words of one automaton
PIECE_WORDS = 1_000  # longer items are cut into pieces that share window - 1 words
BLOCKS_AT_ONCE = 4  # automata in one pass; more take further passes, each over the written table of the one before
_PAIR_BITS = 22


@dataclass
class SuffixAutomaton:
    """All runs of words of several items; states by number, words by id."""

    ids: dict[bytes, int] = field(default_factory=dict)
    next: list[dict[int, int]] = field(default_factory=lambda: [{}])
    length: list[int] = field(default_factory=lambda: [0])
    link: list[int] = field(default_factory=lambda: [-1])

    def state(self, length: int, follow: dict[int, int], link: int) -> int:
        self.next.append(follow)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def fork(self, origin: int, word: int, target: int) -> int:
        """A copy of `target` for its runs of up to one word more than `origin`."""
        if self.length[target] == self.length[origin] + 1:
            return target
        copy = self.state(self.length[origin] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = copy
        while origin >= 0 and self.next[origin].get(word) == target:
            self.next[origin][word] = copy
            origin = self.link[origin]
        return copy

    def add(self, item: list[bytes]) -> None:
        last = 0
        for w in item:
            word = self.ids.setdefault(w, len(self.ids))
            known = self.next[last].get(word)
            if known is not None:
                last = self.fork(last, word, known)
                continue
            made, at = self.state(self.length[last] + 1, {}, 0), last
            while at >= 0 and word not in self.next[at]:
                self.next[at][word] = made
                at = self.link[at]
            if at >= 0:
                self.link[made] = self.fork(at, word, self.next[at][word])
            last = made

    def step(self, state: int, matched: int, word: int) -> tuple[int, int]:
        """State and length of the longest run that ends with `word`."""
        while state and word not in self.next[state]:
            state = self.link[state]
            matched = self.length[state]
        if word in self.next[state]:
            return self.next[state][word], matched + 1
        return 0, 0


class Matcher:
    """Windows of a block of items, found in documents."""

    def __init__(self, items: list[tuple[int | None, list[bytes], bool]], window: int) -> None:
        """items: id, words, and whether these are all words of the item. Equal words are taken in once, for all their ids."""
        self.window = window
        a = self.automaton = SuffixAutomaton()
        ids: dict[bytes, tuple[list[bytes], set]] = {}
        for item, ws, whole in items:
            if len(ws) >= window or ws and whole:
                ids.setdefault(b" ".join(ws), (ws, set()))[1].add(item)
        own_items = list(ids.values())
        for ws, _ in own_items:
            a.add(ws)
        n = len(a.length)
        # By state: the state of its last `window` words; items with a window there; short items that end there.
        self.tail = [-1] * n
        order = sorted(range(1, n), key=a.length.__getitem__)
        for s in order:
            up = a.link[s]
            if a.length[s] >= window:
                self.tail[s] = self.tail[up] if a.length[up] >= window else s
        self.items: dict[int, set] = {}
        self.short: dict[int, list[tuple[int, set]]] = {}
        for ws, its_ids in own_items:
            state = matched = 0
            for w in ws:
                state, matched = a.step(state, matched, a.ids[w])
                if matched >= window:
                    self.items.setdefault(self.tail[state], set()).update(its_ids)
            if len(ws) < window:
                own = self.short.setdefault(state, [])
                for n_words, found in own:
                    if n_words == len(ws):
                        found |= its_ids
                        break
                else:
                    own.append((len(ws), set(its_ids)))
        for s in order:  # what ends at a state also ends at all longer runs
            up = self.short.get(a.link[s])
            if up:
                self.short[s] = self.short.get(s, []) + up
        self.least = min((min(len(ws), window) for ws, _ in own_items), default=0)
        self.pairs = np.zeros(1 << _PAIR_BITS, bool)
        for ws, _ in own_items:
            k = np.array([a.ids[w] for w in ws], np.int64)
            self.pairs[self.code(k)] = True

    @staticmethod
    def code(ids: np.ndarray) -> np.ndarray:
        return (ids[:-1] * 0x9E3779B1 + ids[1:] * 0x85EBCA6B) & ((1 << _PAIR_BITS) - 1)

    def candidates(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Stretches long enough for a window, of known words whose neighbours may follow each other."""
        if self.least == 1:
            fits = np.concatenate(([0], (ids >= 0).view(np.int8), [0]))
            more = 0
        else:
            pairs = (ids[:-1] >= 0) & (ids[1:] >= 0)
            where = np.flatnonzero(pairs)
            pairs[where] = self.pairs[(ids[where] * 0x9E3779B1 + ids[where + 1] * 0x85EBCA6B) & ((1 << _PAIR_BITS) - 1)]
            fits = np.concatenate(([0], pairs.view(np.int8), [0]))
            more = 1
        edges = np.diff(fits)
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) + more
        keep = ends - starts >= self.least
        return list(zip(starts[keep].tolist(), ends[keep].tolist(), strict=True))

    def find(self, ws: list[bytes], hit: np.ndarray, found: set) -> None:
        """Mark the words hit, and add the items with windows there."""
        n = len(ws)
        if not self.least or n < self.least:
            return
        ids = np.fromiter(map(self.automaton.ids.get, ws, repeat(-1)), np.int64, n)
        a, window = self.automaton, self.window
        for start, end in self.candidates(ids):
            state = matched = 0
            for at, word in enumerate(ids[start:end].tolist(), start):
                state, matched = a.step(state, matched, word)
                if matched >= window:
                    hit[at + 1 - matched : at + 1] = True
                    found |= self.items[self.tail[state]]
                for n_words, items in self.short.get(state, ()):
                    if n_words <= matched:
                        hit[at + 1 - n_words : at + 1] = True
                        found |= items


def _built(t: pa.Table, window: int) -> pa.Table:
    pieces = zip(t.column("ids").to_pylist(), t.column("words").to_pylist(), t.column("whole").to_pylist(), strict=True)
    items = [(item, ws.split(), whole) for ids, ws, whole in pieces for item in ids]
    matcher = pickle.dumps(Matcher(items, window))
    return pa.table({"block": t.column("block").slice(0, 1), "matcher": pa.array([matcher], pa.binary())})


def _blocks(benchmark: DataFrame, window: int, block_words: int) -> tuple[int, Callable[[int], bytes]]:
    """How many blocks the items make, and what gives the pickled Matcher of one; no bytes if no piece was dealt to it."""
    out = T.DataType.fromDDL("item_id long, words binary, whole boolean, n long")
    step = PIECE_WORDS - window + 1

    def cut_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), blobs(batch.column(1)), strict=True):
                ws = words(text)
                for at in range(0, max(1, len(ws) - window + 1), step) if ws else ():
                    part = ws[at : at + PIECE_WORDS]
                    rows.append((item, b" ".join(part), len(part) == len(ws), len(part)))
            types = [pa.int64(), pa.binary(), pa.bool_(), pa.int64()]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=out.names)

    # equal pieces are one, with the ids of all their items, which any document that holds the piece is told anyway
    alike = benchmark.select("item_id", "text").mapInArrow(cut_up, out).groupBy("words", "whole", "n")
    parts = cut(alike.agg(F.collect_set("item_id").alias("ids")), "pieces")
    total = parts.agg(F.sum("n")).first()[0] or 0
    n_blocks = -(-total // block_words)

    if not n_blocks:
        return 0, lambda number: b""
    dealt = parts.withColumn("block", F.pmod(F.xxhash64("words"), F.lit(n_blocks)))
    built = cut(dealt.groupBy("block").applyInArrow(lambda t: _built(t, window), "block long, matcher binary"), "automata")

    def fetch(number: int) -> bytes:
        rows = built.where(F.col("block") == number).select("matcher").take(1)
        return bytes(rows[0].matcher) if rows else b""

    return n_blocks, fetch


_RUNS, _ITEMS = "__hit_runs__", "__hit_items__"  # what earlier passes have found


def _pass(
    df: DataFrame, benchmark: DataFrame, window: int, block_words: int, finish: Callable, schema: T.StructType
) -> DataFrame:
    """Stream the texts through all blocks. finish: makes the output batch of a batch and what was found in it."""
    n_blocks, fetch = _blocks(benchmark.where(F.col("item_id").isNotNull()), window, block_words)
    marked = T.StructType(
        [*df.schema.fields, T.StructField(_RUNS, T.ArrayType(T.LongType())), T.StructField(_ITEMS, T.ArrayType(T.LongType()))]
    )
    n_columns, at_text = len(df.columns), df.columns.index("text")
    for first in range(0, max(n_blocks, 1), BLOCKS_AT_ONCE):
        numbers = range(first, min(first + BLOCKS_AT_ONCE, n_blocks))
        matchers = [df.sparkSession.sparkContext.broadcast(fetch(b)) for b in numbers]
        last = first + BLOCKS_AT_ONCE >= n_blocks

        def run(batches: Iterable[pa.RecordBatch], matchers=matchers, last=last) -> Iterator[pa.RecordBatch]:
            blocks = [pickle.loads(m.value) for m in matchers if m.value]
            for batch in small_batches(batches):
                results = []
                earlier = [c.to_pylist() for c in batch.columns[n_columns:]]
                for i, text in enumerate(blobs(batch.column(at_text))):
                    ws = words(text)
                    hit, found = np.zeros(len(ws), bool), set()
                    if earlier:
                        for start, end in zip(earlier[0][i][::2], earlier[0][i][1::2], strict=True):
                            hit[start:end] = True
                        found.update(earlier[1][i])
                    for block in blocks:
                        block.find(ws, hit, found)
                    results.append((text, hit, found))
                own = pa.RecordBatch.from_arrays(batch.columns[:n_columns], schema=pa.schema(list(batch.schema)[:n_columns]))
                if last:
                    yield finish(own, results)
                else:
                    runs = [[x for run in _runs(hit) for x in run] for _, hit, _ in results]
                    items = [sorted(found) for _, _, found in results]
                    made = [*own.columns, pa.array(runs, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays(made, names=marked.names)

        df = df.mapInArrow(run, schema if last else marked)
        if not last:
            df = cut(df, "decontaminate")
    return df


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """`doc_id, n_words, n_hit, n_items, items_sha256, contaminated` per document.

    items_sha256 is of the ids of items with occurring windows, sorted as text and comma-joined. Null and empty texts
    have no words. Repeated documents each get a row. Items without words, or with a null id, never count as items;
    an empty benchmark contaminates nothing.
    """
    out = T.DataType.fromDDL(
        "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    )

    def finish(batch: pa.RecordBatch, results: list) -> pa.RecordBatch:
        hits = [int(hit.sum()) for _, hit, _ in results]
        digests = [hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest() for _, _, found in results]
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([len(hit) for _, hit, _ in results], pa.int64()),
                pa.array(hits, pa.int64()),
                pa.array([len(found) for _, _, found in results], pa.int64()),
                pa.array(digests, pa.string()),
                pa.array([h > 0 for h in hits], pa.bool_()),
            ],
            names=out.names,
        )

    return _pass(docs.select("doc_id", "text"), benchmark, window, block_words, finish, out)


def spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """`doc_id, first_word, n_words` of every run of hit words; none for documents without one."""
    out = T.DataType.fromDDL("doc_id long, first_word long, n_words long")

    def finish(batch: pa.RecordBatch, results: list) -> pa.RecordBatch:
        rows = [
            (doc_id, start, end - start)
            for doc_id, (_, hit, _) in zip(batch.column(0).to_pylist(), results, strict=True)
            for start, end in _runs(hit)
        ]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], names=out.names)

    return _pass(docs.select("doc_id", "text"), benchmark, window, block_words, finish, out)


def _runs(hit: np.ndarray) -> list[tuple[int, int]]:
    edges = np.diff(np.concatenate(([0], hit.view(np.int8), [0])))
    return list(zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True))


def without_spans(text: bytes, hit: np.ndarray) -> bytes:
    """The text without the runs of hit words; a run goes with what stands between its words."""
    first, last = word_spans(text)
    out, at = [], 0
    for start, end in _runs(hit):
        out.append(text[at : first[start]])
        at = int(last[end - 1])
    out.append(text[at:])
    return b"".join(out)


def clean(
    docs: DataFrame,
    benchmark: DataFrame,
    max_coverage: float = 0.2,
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """The documents without benchmark passages, with the columns of `docs`.

    Every run of hit words is cut out of the text (and `n_chars` set anew where that column exists). A document goes
    if more than `max_coverage` of its words are hit. Other rows stay as they are, nulls and repeated rows included.
    """

    def finish(batch: pa.RecordBatch, results: list) -> pa.RecordBatch:
        at = batch.schema.get_field_index("text")
        keep = [not hit.any() or hit.mean() <= max_coverage for _, hit, _ in results]
        if all(keep) and not any(hit.any() for _, hit, _ in results):
            return batch
        texts = batch.column(at).to_pylist()
        for i, (text, hit, _) in enumerate(results):
            if keep[i] and hit.any():
                texts[i] = without_spans(text, hit).decode(errors="replace")
        columns = list(batch.columns)
        columns[at] = pa.array(texts, batch.schema.field(at).type)
        n_chars = batch.schema.get_field_index("n_chars")
        if n_chars >= 0 and pa.types.is_integer(batch.schema.field(n_chars).type):
            counts = batch.column(n_chars).to_pylist()
            for i, (_, hit, _) in enumerate(results):
                if hit.any():
                    counts[i] = len(texts[i])
            columns[n_chars] = pa.array(counts, batch.schema.field(n_chars).type)
        return pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(keep, pa.bool_()))

    return _pass(docs, benchmark, window, block_words, finish, docs.schema)
