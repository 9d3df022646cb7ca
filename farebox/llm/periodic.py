"""Runs of repeated words: stretches that go on with one smallest period, and texts with the repeats taken out.

Suffixes of a document are ordered by doubling. Neighbours in this order are united by descending length of their
common prefix (LCP), as Kruskal's algorithm takes edges; every class keeps its positions in order. When two classes
unite at LCP l, each pair of positions that thereby become neighbours has exactly l words in common. If their distance
d is within l, the stretch from the first one over l + d words has period d. A pair that can't be moved to the left
begins its stretch, and no position lies between a run's start and the next period: so each run is seeded once, with
its smallest period and full length.

A run of `SHORTEST` words or `TIMES` periods has a start that shares at least `SHARED` words with the next period;
classes are united down to that LCP only, and documents without any such repeat are left after a few sorts.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from farebox.llm.text import arrow_type, blobs

SHORTEST = 24  # words of a run, at least
TIMES = 3  # periods of a run, at least
SHARED = 16  # min over q of max(SHORTEST - q, (TIMES - 1) * q): a power of two, as doubling needs it
STEP_BYTES = 1 << 20  # texts that are looked at together; changes no result

Run = tuple[int, int, int]  # start, length, period
Rewrite = Callable[[int | None, list[bytes]], list[bytes]]


def _doubled(rank: np.ndarray, width: int, room: np.ndarray) -> np.ndarray:
    """Ranks of stretches of 2 * width words from ranks of width words; `room`: words up to the document's end."""
    behind = np.zeros(len(rank), np.int64)
    inside = np.flatnonzero(room > width)
    behind[inside] = rank[inside + width] + 1
    return np.unique(rank * (len(rank) + 1) + behind, return_inverse=True)[1]


def _repeating(words: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Positions from which `SHARED` words stand at another position too; all documents at once.

    What is unique stays unique when it gets longer, so that only repeated stretches are looked at again.
    """
    places = np.arange(len(words))
    rank, width = words, 1
    while True:
        kind, n = np.unique(rank[places], return_inverse=True, return_counts=True)[1:]
        again = n[kind] > 1
        places, kind = places[again], kind[again]
        if width == SHARED or not len(places):
            return places
        full = np.full(len(words), -1, np.int64)
        full[places] = kind
        places = places[room[places] >= 2 * width]
        places = places[full[places + width] >= 0]
        rank = full.copy()
        rank[places] = full[places] * (len(words) + 1) + full[places + width]
        width *= 2


def _neighbours(words: np.ndarray, room: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`places` ordered by their suffixes, and the LCP of each with the one before it."""
    levels, width = [np.unique(words, return_inverse=True)[1]], 1
    while width < room.max() and len(np.unique(levels[-1][places])) < len(places):
        levels.append(_doubled(levels[-1], width, room))
        width *= 2
    levels = [x.astype(np.int32) for x in levels]
    order = places[np.argsort(levels[-1][places], kind="stable")]
    left, right = order[:-1], order[1:]
    shared = np.zeros(len(left), np.int64)
    least_room = np.minimum(room[left], room[right])
    for level in range(len(levels) - 1, -1, -1):
        fits = np.flatnonzero(shared + (1 << level) <= least_room)
        same = levels[level][left[fits] + shared[fits]] == levels[level][right[fits] + shared[fits]]
        shared[fits[same]] += 1 << level
    return order, np.concatenate(([0], shared))


def _united(large: list[int], small: list[int]) -> tuple[list[int], list[tuple[int, int]]]:
    """Both ordered position sets as one, and the pairs that are neighbours only now."""
    pairs: list[tuple[int, int]] = []
    before = -1
    for k, x in enumerate(small):
        at = bisect_left(large, x)
        if at and large[at - 1] > before:
            pairs.append((large[at - 1], x))
        if at < len(large) and (k + 1 == len(small) or large[at] < small[k + 1]):
            pairs.append((x, large[at]))
        before = x
    if len(small) * 8 > len(large):
        large = sorted(large + small)
    else:
        for x in small:
            insort(large, x)
    return large, pairs


def _runs(order: list[int], lcp: np.ndarray, words: list[int], first: dict[int, int]) -> Iterator[Run]:
    """Runs as positions in the whole row of words; `first` has the first position of each document that is in it."""
    parent = list(range(len(order)))
    members = [[p] for p in order]

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    edges = np.flatnonzero(lcp >= SHARED)
    edges = edges[np.argsort(-lcp[edges], kind="stable")]
    for at, shared in zip(edges.tolist(), lcp[edges].tolist(), strict=True):
        a, b = root(at - 1), root(at)
        if len(members[a]) < len(members[b]):
            a, b = b, a
        parent[b] = a
        members[a], pairs = _united(members[a], members[b])
        members[b] = []
        for i, j in pairs:
            d = j - i
            if d <= shared and shared >= (TIMES - 1) * d and shared + d >= SHORTEST and (i in first or words[i - 1] != words[j - 1]):
                yield i, shared + d, d


def find(documents: list[list[bytes]]) -> list[list[Run]]:
    """Runs of each document by start, then period."""
    found: list[list[Run]] = [[] for _ in documents]
    known: dict[bytes, int] = {}
    size = np.array([len(d) for d in documents], np.int64)
    total = int(size.sum())
    if total == 0:
        return found
    ids = np.fromiter((known.setdefault(w, len(known)) for d in documents for w in d), np.int64, total)
    document = np.repeat(np.arange(len(documents)), size)
    ends = np.cumsum(size)
    words = document * len(known) + ids  # words of different documents are never the same
    room = ends[document] - np.arange(total)
    places = _repeating(words, room)
    if not len(places):
        return found
    # from here on only the documents that hold such repeats
    chosen = np.unique(document[places])
    kept = np.flatnonzero(np.isin(document, chosen))
    new = np.full(total, -1, np.int64)
    new[kept] = np.arange(len(kept))
    words, room, places, document = words[kept], room[kept], new[places], document[kept]
    starts = np.flatnonzero(np.diff(document, prepend=-1))
    first = {int(s): int(document[s]) for s in starts}
    order, lcp = _neighbours(words, room, places)
    for start, length, period in _runs(order.tolist(), lcp, words.tolist(), first):
        own = int(starts[np.searchsorted(starts, start, "right") - 1])
        found[first[own]].append((start - own, length, period))
    for runs in found:
        runs.sort(key=lambda r: (r[0], r[2]))
    return found


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words that no run contains behind its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k])


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The registered query's input: the end of every tenth text, by crc32 of its id, repeats with one period.

    A null id has no crc32, so its text stays as it is.
    """
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def _steps(batches: Iterable[pa.RecordBatch], rewrite: Rewrite | None) -> Iterator[tuple[list, list[list[bytes]]]]:
    """Ids and words of some `STEP_BYTES` of whole texts at a time."""
    ids: list = []
    documents: list[list[bytes]] = []
    size = 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            for doc_id, text in zip(part.column(0).to_pylist(), blobs(part.column(1)), strict=True):
                words = text.split()  # at bytes 0x20 and 0x09 to 0x0D
                ids.append(doc_id)
                documents.append(rewrite(doc_id, words) if rewrite else words)
                size += len(text)
                if size >= STEP_BYTES:
                    yield ids, documents
                    ids, documents, size = [], [], 0
    if ids:
        yield ids, documents


def _per_step(docs: DataFrame, schema: str, rewrite: Rewrite | None, rows: Callable[..., Iterable[tuple]]) -> DataFrame:
    out = T.DataType.fromDDL(schema)
    types = [arrow_type(f.dataType) for f in out.fields]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, documents in _steps(batches, rewrite):
            made = [r for d in zip(ids, documents, find(documents), strict=True) for r in rows(*d)]
            columns = list(zip(*made, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=out.names)

    return docs.select("doc_id", "text").mapInArrow(run, out)


def runs(docs: DataFrame) -> DataFrame:
    """`doc_id, start, length, period`, one row per run. Texts without runs, null and empty ones have no row."""

    def rows(doc_id, words, found):
        return [(doc_id, *r) for r in found]

    return _per_step(docs, "doc_id long, start long, length long, period long", None, rows)


def collapse(docs: DataFrame) -> DataFrame:
    """`doc_id, text` with repeats taken out and words joined by single spaces; a null text becomes the empty one."""

    def rows(doc_id, words, found):
        return [(doc_id, collapsed(words, found).decode(errors="replace"))]

    return _per_step(docs, "doc_id long, text string", None, rows)


def digest(docs: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """One row per document: its number of runs, its run of greatest exponent, digests of all runs and of what is kept.

    `doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256`. The run is that with the
    greatest length / period, among equals the one that starts first, then the one with the smallest period; without a
    run these four are null. Null and empty texts have no words and no runs. Repeated rows are looked at each; a null
    doc_id stays null; other columns are left behind. `rewrite` may change a text's words beforehand.
    """

    def rows(doc_id, words, found):
        best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in found).encode()
        return [(
            doc_id, len(found), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256(listed).hexdigest(), hashlib.sha256(collapsed(words, found)).hexdigest(),
        )]

    schema = (
        "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
        "runs_sha256 string, collapsed_sha256 string"
    )
    return _per_step(docs, schema, rewrite, rows)
