"""SimHash near-dedup by anchor points.

Two fingerprints of 64 bits that differ in at most 4 bits differ in at most 1 bit in one of three blocks of 21, 21 and
22 bits. In a block, the anchors are the words of a covering code: the perfect Hamming code on its first 15 bits, any
value on the others. It has covering radius 1, so every fingerprint has a home anchor at distance 0 or 1; one within 1
bit of it in the block is then at distance 2 or less of that anchor. Each fingerprint is sent to all anchors within 2
in each block (14 or so), and meets there, by an exact count of differing bits over all 64, those at home.

Equal fingerprints are one node throughout, whatever number of documents has them.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farebox.llm.components import components
from farebox.llm.text import blobs, per_row, small_batches
from farebox.session import cut

WORDS = 4  # of a shingle
SEED = 42
BITS = 4  # fingerprints that differ in so many or fewer are linked
BLOCKS = ((0, 21), (21, 21), (42, 22))  # first bit and number of bits; one more than half of BITS, so that one differs in 1 or 0
CODED = 15  # bits under the Hamming code
RADIUS = 1  # its covering radius
STEP = 1 << 15  # shingles whose hashes are in memory at once

_HASH = xxhash.xxh64_intdigest


def fingerprint(text: bytes) -> int:
    """The fingerprint as an unsigned number; 0 for a text without words."""
    ws = text.lower().split()
    if not ws:
        return 0
    n = max(1, len(ws) - WORDS + 1)
    line = b" ".join(ws)
    lengths = np.fromiter(map(len, ws), np.int64, len(ws)) + 1
    ends = np.cumsum(lengths)
    starts = (ends - lengths)[:n].tolist()
    ends = (ends[min(WORDS, len(ws)) - 1 :] - 1).tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, n, STEP):
        part = zip(starts[at : at + STEP], ends[at : at + STEP], strict=True)
        hashes = np.fromiter((_HASH(line[a:b], SEED) for a, b in part), np.uint64)
        counts += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n).view(">u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """`doc_id, fp` with fp as a signed long. Null texts are empty."""

    def work():
        return lambda doc_id, text: (doc_id, int(np.uint64(fingerprint(text)).astype(np.int64)))

    return per_row(docs, ["doc_id", "text"], "doc_id long, fp long", work)


def _syndromes() -> np.ndarray:
    """By value of the coded bits: the exclusive or of the positions (1 to 15) of the bits set."""
    values = np.arange(1 << CODED)
    out = np.zeros(1 << CODED, np.int64)
    for bit in range(CODED):
        out ^= np.where(values >> bit & 1, bit + 1, 0)
    return out


def _offsets(bits: int, reach: int) -> list[np.ndarray]:
    """By syndrome: what to flip in a block of so many bits to get to each anchor within `reach`, the nearest first."""
    by_syndrome: list[list[int]] = [[] for _ in range(CODED + 1)]
    for flips in itertools.chain.from_iterable(itertools.combinations(range(bits), k) for k in range(reach + 1)):
        syndrome = 0
        for bit in flips:
            if bit < CODED:
                syndrome ^= bit + 1
        by_syndrome[syndrome].append(sum(1 << bit for bit in flips))
    return [np.array(x, np.int64) for x in by_syndrome]


def _anchored(fps: DataFrame, reach: int) -> DataFrame:
    """`anchor, fp`: each fingerprint at every anchor within `reach` in each block. RADIUS gives the home anchor only."""
    out = T.StructType().add("anchor", T.LongType()).add("fp", T.LongType())
    syndromes = _syndromes()
    home = reach == RADIUS
    offsets = [_offsets(bits, reach) for _, bits in BLOCKS]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for block, (first, bits) in enumerate(BLOCKS):
                value = (fp >> first) & ((1 << bits) - 1)
                syndrome = syndromes[value & ((1 << CODED) - 1)]
                for s, flips in enumerate(offsets[block]):
                    own = np.flatnonzero(syndrome == s)
                    flips = flips[:1] if home else flips
                    anchors = (value[own, None] ^ flips[None, :]) | (block << 40)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchors.ravel()), pa.array(np.repeat(fp[own], len(flips)))], names=out.names
                    )

    return fps.select("fp").mapInArrow(run, out)


def linked_pairs(fps: DataFrame) -> DataFrame:
    """`a, b` with a < b: all pairs of the distinct fingerprints `fp` that differ in BITS bits or fewer.

    Spark sizes anchored rows by the file of fingerprints, some forty times too low, and would broadcast them; so here,
    as in the other joins of tables that grow with the documents, the plan for large ones is asked for.
    """
    at_home = _anchored(fps, RADIUS).withColumnRenamed("fp", "a")
    around = _anchored(fps, RADIUS + BITS // len(BLOCKS)).withColumnRenamed("fp", "b")
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS)
    met = at_home.join(around.hint("merge"), (at_home.anchor == around.anchor) & near)
    return met.select("a", "b").distinct()


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents as `doc_id, fp`, and `fp, root, component_id` for every fingerprint; root names its component."""
    rows = cut(fingerprints(docs), "fingerprints")
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    found = components(linked_pairs(nodes))
    linked = nodes.join(found.hint("merge"), nodes.fp == found.node).select("fp", "least", "root")
    roots = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    # No plan is asked for here: Spark knows the size of what was shuffled, and a large group's rows needn't meet in a task.
    linked = linked.join(roots, "root").select(F.col("fp").alias("linked_fp"), "root", "component_id")
    whole = nodes.join(linked.hint("merge"), nodes.fp == linked.linked_fp, "left").select(
        "fp", F.coalesce("root", "fp").alias("root"),
        F.when(F.col("linked_fp").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"),
    )
    return rows, cut(whole, "groups")  # so that the join of the documents is dealt anew, and a large group split


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """`doc_id, fingerprint, component_id` per document; component_id is the least doc_id reachable over links.

    Null and empty texts have fingerprint zero and are linked like others. Repeated rows each get a row. A null doc_id
    is never the least; a component of such rows alone has a null component_id.
    """
    rows, groups = _grouped(docs)
    return rows.join(groups.hint("merge"), "fp").select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component: that with the least doc_id (of equal ids the least fingerprint, then text).

    The columns of `docs` are kept as they are.
    """
    rows, groups = _grouped(docs)
    kept = (
        rows.join(groups.hint("merge"), "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .groupBy("root", "component_id").agg(F.min("fp").alias("fp"))
    )
    wanted = kept.select(F.struct(F.col("component_id").alias("id"), "fp").alias("__key__"))
    at_text = docs.columns.index("text")
    at_id = docs.columns.index("doc_id")
    marked = T.StructType([*docs.schema.fields, T.StructField("__fp__", T.LongType())])

    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            fps = [int(np.uint64(fingerprint(b)).astype(np.int64)) for b in blobs(batch.column(at_text))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps, pa.int64())], names=marked.names)

    texts = docs.mapInArrow(mark, marked)
    key = F.struct(F.col(docs.columns[at_id]).alias("id"), F.col("__fp__").alias("fp"))
    met = texts.withColumn("__key__", key).join(wanted.hint("merge"), "__key__", "left_semi")
    first = F.row_number().over(Window.partitionBy("__key__").orderBy("text"))
    return met.withColumn("__n__", first).where("__n__ = 1").select(*[F.col(f"`{c}`") for c in docs.columns])
