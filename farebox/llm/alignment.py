"""Two tokenizations of the same text laid over each other: shared cuts, groups between them, and links.

Token ends of both sides are byte offsets in ascending order. Their merge is cut by diagonals into pieces of equal
work (a diagonal's crossing point is found by binary search, all of them at once), pieces are merged apart and emit the
links of overlapping tokens; where a piece begins inside a group that an earlier piece opened, the counts of closed
groups before it put the parts together. A piece costs the same whatever the lengths of documents, so a batch of
documents is merged as one line of bytes, and a long document is many pieces.

Corpus-wide counts of linked id pairs are added up per chunk of documents, shuffled, and brought back to each chunk
for exactly the pairs it holds: a pair that every document has costs one row per chunk.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farebox.llm.text import arrow_type, blobs
from farebox.session import cut

PIECE = 1 << 15  # merge steps of one piece
CHUNK_BYTES = 2 << 20  # texts whose links are kept in one row; a longer text is a chunk of its own
SPACE = "▁"  # the mark that a SentencePiece vocabulary writes for a space


def crossings(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """How many of `a` come before each diagonal of the merge of `a` and `b`; equal values of `a` come first."""
    low, high = np.maximum(0, diagonals - len(b)), np.minimum(diagonals, len(a))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        # a[middle] is taken before the diagonal if it is not behind the last of b that would be taken instead
        taken = open_ & (a[np.minimum(middle, len(a) - 1)] <= b[np.maximum(diagonals - middle - 1, 0)])
        low = np.where(taken, middle + 1, low)
        high = np.where(open_ & ~taken, middle, high)
    return low


def align(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links and groups of two ascending rows of token ends whose last ends are equal.

    Returns the linked token of `a` and of `b` for each link in order of place, the group of each link, and for each
    group how many tokens of `a` and of `b` end in it or before it.
    """
    if not len(a):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    steps = len(a) + len(b)
    cuts = np.append(np.arange(0, steps, piece), steps)
    in_a = crossings(a, b, cuts)
    in_b = cuts - in_a
    xs, ys, groups, closed_a, closed_b = [], [], [], [], []
    closed = 0  # groups that pieces before this one have closed: what an open group is stitched to
    for k in range(len(cuts) - 1):
        i, i_end, j, j_end = in_a[k], in_a[k + 1], in_b[k], in_b[k + 1]
        own_a, own_b = a[i:i_end], b[j:j_end]
        over_a = j + np.searchsorted(own_b, own_a)  # the token of b over the last byte of each token of a
        over_b = i + np.searchsorted(own_a, own_b)
        shared = b[np.minimum(over_a, len(b) - 1)] == own_a  # both end here: the group is closed
        # a token of b that ends where one of a ends is linked by the latter, which may lie at the end of the piece before
        alone = (a[np.minimum(over_b, len(a) - 1)] != own_b) & ((a[i - 1] if i else -1) != own_b)
        x = np.concatenate((np.arange(i, i_end), over_b[alone]))
        y = np.concatenate((over_a, np.arange(j, j_end)[alone]))
        ends = np.concatenate((own_a, own_b[alone]))
        order = np.argsort(ends, kind="stable")
        closes = np.concatenate((shared, np.zeros(int(alone.sum()), bool)))[order]
        xs.append(x[order])
        ys.append(y[order])
        groups.append(closed + np.cumsum(closes) - closes)
        closed_a.append(np.arange(i, i_end)[shared] + 1)
        closed_b.append(over_a[shared] + 1)
        closed += int(closes.sum())
    return tuple(np.concatenate(v) for v in (xs, ys, groups, closed_a, closed_b))


class ByteLevel:
    """A byte-level BPE vocabulary file; bytes of a token are read off its entry."""

    def __init__(self, source: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.source = source
        parsed = json.loads(source)
        vocabulary = parsed["model"]["vocab"] | {t["content"]: t["id"] for t in parsed["added_tokens"]}
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves
        others = [b for b in range(256) if b not in set(plain)]  # these stand at U+0100 and on
        letter = {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(others)}
        self.bytes_of = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            self.bytes_of[i] = bytes(letter[c] for c in entry) if all(c in letter for c in entry) else entry.encode()
        self.encode = self._ranked(parsed) or self._library()

    def _library(self):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(self.source)
        tokenizer.encode_special_tokens = True
        return lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ranked(self, parsed: dict):
        """A several times faster library, if ids are in order of merging and the split is the usual one."""
        import public_tokenizers
        import tiktoken

        model, split = parsed["model"], parsed["pre_tokenizer"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        first = len(model["vocab"]) - len(merges) - sum(t["content"] in model["vocab"] for t in parsed["added_tokens"])
        if (
            parsed["normalizer"] is None and split == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": split.get("trim_offsets"), "use_regex": True}
            and first == 256 and all(model["vocab"].get(x + y) == first + k for k, (x, y) in enumerate(merges))
            and not (model.get("ignore_merges") or model.get("dropout") or model.get("unk_token"))
        ):
            ranks = {self.bytes_of[i]: i for i in range(first + len(merges))}
            own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            return lambda texts: [own.encode_ordinary(t) for t in texts]
        return None


class Pieces:
    """A SentencePiece vocabulary file; bytes of a piece are its text, its mark a space, a byte piece its byte."""

    def __init__(self, source: bytes) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=source)
        self.bytes_of = [
            bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i)
            else model.id_to_piece(i).replace(SPACE, " ").encode()
            for i in range(model.vocab_size())
        ]
        self.encode = lambda texts: model.encode(texts, num_threads=1)


class Aligner:
    """Works inside a task; holds both vocabularies."""

    def __init__(self, a: str, b: bytes) -> None:
        self.a, self.b = ByteLevel(a), Pieces(b)
        # text of a token and of the mark behind it: by id, once inside and once at the end of a side of a group
        self.shown = [f"{i}{m}" for i in range(len(self.a.bytes_of)) for m in ",|"]
        self.from_b = len(self.shown)
        self.shown += [f"{i}{m}" for i in range(len(self.b.bytes_of)) for m in ",;"]

    @cached_property
    def lengths(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.array([len(x) for x in v.bytes_of], np.int64) for v in (self.a, self.b))

    def tokens(self, texts: list[bytes]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both sides; none for a text that is empty or that one side does not spell out byte by byte."""
        plain = [t.decode(errors="replace") for t in texts]
        ids_a, ids_b = self.a.encode([" " + t for t in plain]), self.b.encode(plain)
        of_a, of_b = self.a.bytes_of.__getitem__, self.b.bytes_of.__getitem__
        for k, text in enumerate(texts):
            whole = b" " + text
            if not text or b"".join(map(of_a, ids_a[k])) != whole or b"".join(map(of_b, ids_b[k])) != whole:
                ids_a[k], ids_b[k] = [], []
        return ids_a, ids_b

    def chunk(self, texts: list[bytes], piece: int = PIECE) -> dict[str, list | np.ndarray]:
        """Figures per document and the id pair of every link, of a chunk merged as one line of bytes."""
        tokens = self.tokens(texts)
        n = [np.array([len(x) for x in side], np.int64) for side in tokens]
        flat = [np.fromiter((i for x in side for i in x), np.int64, int(k.sum())) for side, k in zip(tokens, n, strict=True)]
        ends = [np.cumsum(size[ids]) for size, ids in zip(self.lengths, flat, strict=True)]
        x, y, _, closed_a, closed_b = align(*ends, piece)
        to_a, to_b = (np.concatenate(([0], np.cumsum(k))) for k in n)
        links = np.searchsorted(x, to_a)
        groups = np.searchsorted(closed_a, to_a, "right")
        return {
            "n_a": n[0], "n_b": n[1], "n_groups": np.diff(groups), "n_links": np.diff(links), "links": links,
            "pairs": flat[1][y] << 32 | flat[0][x],
            "digests": self.digests(flat, closed_a, closed_b, to_a + to_b),
        }

    def digests(self, flat: list[np.ndarray], closed_a: np.ndarray, closed_b: np.ndarray, bounds: np.ndarray) -> list[str]:
        """sha256 of the groups of each document, written as `a1,a2|b1;a3|b2,b3`; the empty string without tokens."""
        ids_a, ids_b = flat
        codes = np.zeros(len(ids_a) + len(ids_b), np.int64)
        at_a, at_b = np.arange(len(ids_a)), np.arange(len(ids_b))
        in_a, in_b = np.searchsorted(closed_a, at_a, "right"), np.searchsorted(closed_b, at_b, "right")
        before_b = np.concatenate(([0], closed_b))
        codes[at_a + before_b[in_a]] = 2 * ids_a + (closed_a[in_a] == at_a + 1)
        codes[at_b + closed_a[in_b]] = self.from_b + 2 * ids_b + (closed_b[in_b] == at_b + 1)
        shown = [self.shown[c] for c in codes.tolist()]
        out = []
        for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            out.append(hashlib.sha256("".join(shown[start:end])[:-1].encode()).hexdigest() if end > start else "")
        return out


DOCUMENT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
KEPT = f"chunk string, {DOCUMENT}, links array<int>, pair long, place int, n long"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_ALIGNERS: dict[tuple[int, int], Aligner] = {}


def _read(path: str) -> bytes:
    """A vocabulary file, read on the driver; its size is that of the file, whatever the input."""
    with open(path, "rb") as file:
        return file.read()


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    ids, texts, size = [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            for doc_id, text in zip(part.column(0).to_pylist(), blobs(part.column(1)), strict=True):
                if ids and (size + len(text) > CHUNK_BYTES or len(ids) >= CHUNK_BYTES >> 7):
                    yield ids, texts
                    ids, texts, size = [], [], 0
                ids.append(doc_id)
                texts.append(text)
                size += len(text)
    if ids:
        yield ids, texts


def overlaps(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Rows of two kinds per chunk of documents, told apart by `pair`.

    A document (`pair` is null) has its figures, and in `links` for each link the place of its id pair among those of
    its chunk. An id pair (b << 32 | a) of a chunk has its place and how many links of the chunk hold it.
    """
    shared = docs.sparkSession.sparkContext.broadcast((_read(a_path).decode(), _read(b_path)))
    out = T.DataType.fromDDL(KEPT)
    types = {f.name: arrow_type(f.dataType) for f in out.fields}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        key = (hash(a_path), hash(b_path))
        if key not in _ALIGNERS:
            _ALIGNERS[key] = Aligner(*shared.value)
        for number, (ids, texts) in enumerate(_chunks(batches)):
            made = _ALIGNERS[key].chunk(texts)
            pairs, place, n = np.unique(made["pairs"], return_inverse=True, return_counts=True)
            chunk = f"{TaskContext.get().partitionId()}-{number}"
            yield _rows(
                types, len(ids), chunk=[chunk] * len(ids), doc_id=ids, n_a=made["n_a"], n_b=made["n_b"],
                n_groups=made["n_groups"], n_links=made["n_links"], groups_sha256=made["digests"],
                links=pa.ListArray.from_arrays(made["links"].astype(np.int32), place.astype(np.int32)),
            )
            if len(pairs):
                yield _rows(types, len(pairs), chunk=[chunk] * len(pairs), pair=pairs, place=np.arange(len(pairs)), n=n)

    return docs.select("doc_id", "text").mapInArrow(run, out)


def _rows(types: dict[str, pa.DataType], size: int, **columns) -> pa.RecordBatch:
    arrays = [
        columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns[c], t) if c in columns else pa.nulls(size, t)
        for c, t in types.items()
    ]
    return pa.RecordBatch.from_arrays([x if x.type == t else x.cast(t) for x, t in zip(arrays, types.values(), strict=True)], names=list(types))


def _counted(_, documents: pa.Table, pairs: pa.Table) -> pa.Table:
    """Sums of the corpus-wide counts over each document's links; one chunk."""
    order = np.argsort(pairs["place"].to_numpy())
    total, best = pairs["total"].to_numpy()[order], pairs["best"].to_numpy().astype(np.int64)[order]
    links = documents["links"].combine_chunks()
    sizes = np.concatenate(([0], np.cumsum(documents["n_links"].to_numpy())))
    flat = links.flatten().to_numpy()

    def sums(values: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(values[flat]) if len(flat) else []))[sizes].astype(np.int64))

    made = {"n_best": sums(best), "count_sum": sums(total)}
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return pa.table({c: pa.array(made[c], pa.int64()) if c in made else documents[c] for c in names})


def align_documents(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per document how the tokens of two vocabularies lie over each other, and how common its links are.

    `doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`: tokens of both sides, groups between
    shared ends, overlapping pairs of tokens, links whose id pair is the commonest of its B id in the whole corpus
    (ties included), the sum of the corpus-wide counts of all links' id pairs, and the groups' digest. A text that is
    null or empty, or that one side does not spell out byte for byte, has zeros and an empty digest. Repeated rows are
    aligned and counted each; a null doc_id stays null; other columns are left behind.
    """
    kept = cut(overlaps(docs, a_path, b_path), "overlaps")
    found = kept.where("pair IS NOT NULL").select("chunk", "pair", "place", "n")
    totals = found.groupBy("pair").agg(F.sum("n").alias("total"))
    of_b = F.shiftright("pair", 32)
    highest = totals.groupBy(of_b.alias("b")).agg(F.max("total").alias("highest"))
    ranked = totals.withColumn("b", of_b).join(highest, "b").select("pair", "total", (F.col("total") == F.col("highest")).alias("best"))
    needed = found.join(ranked, "pair").select(F.col("chunk").alias("of_chunk"), "place", "total", "best")
    documents = kept.where("pair IS NULL").select("chunk", "links", *T.DataType.fromDDL(DOCUMENT).names)
    return documents.groupBy("chunk").cogroup(needed.groupBy("of_chunk")).applyInArrow(_counted, RESULT)
