"""Shared helpers: columns by name, raw bytes of text columns, word splitting, Arrow passes over whole tables."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH_BYTES = 16 << 20  # texts handed to one step of a pass; bounds memory, changes no result

# Bytes that are no part of a word become spaces, A-Z become a-z; bytes from 0x80 on are word bytes.
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)


def words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z only) words of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`."""
    return text.translate(_WORD_BYTES).split()


def word_spans(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which the words of `words` start and end."""
    inside = np.frombuffer(text.translate(_WORD_BYTES), np.uint8) != 0x20
    edges = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def blobs(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is the empty text."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def small_batches(batches: Iterable[pa.RecordBatch], limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of bounded size, so that long texts don't pile up in a worker."""
    for batch in batches:
        step = max(1, int(batch.num_rows * limit / max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def per_row(
    docs: DataFrame, columns: list[str], schema: str, work: Callable[[], Callable[..., tuple]]
) -> DataFrame:
    """One output row per input row. `work()` is called once per task and returns the row function.

    The columns of `docs` are taken by name; others, whatever their names, are left behind.
    """
    out = T.DataType.fromDDL(schema)
    types = [arrow_type(f.dataType) for f in out.fields]
    names = out.names

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = work()
        for batch in small_batches(batches):
            if batch.num_rows:
                ins = [
                    blobs(c) if pa.types.is_string(c.type) or pa.types.is_large_string(c.type) else c.to_pylist()
                    for c in batch.columns
                ]
                made = zip(*itertools.starmap(row, zip(*ins, strict=True)), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(v), t) for v, t in zip(made, types, strict=True)], names=names
                )

    return docs.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(run, out)
