"""CSV records that hold line breaks, read split by split.

A split of a text file may begin inside a quoted field, which can't be seen from the split itself. So each split is
first run through under both assumptions: it says where its quotes stand at its end, what it adds to a record that was
open before it, and the text of the record it leaves open. These small rows, put in order, tell every split's true
beginning; then all splits are read again, each from its own, and records across splits are put together from the
rows. No file is read by one task, whatever its size.

Quoting is that of RFC 4180: a quote inside a quoted field is doubled, one inside an unquoted field means nothing.
Records end with a line feed, or a carriage return and a line feed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from farebox.session import cut

OPTIONS = {"quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE"}
MOST_KEYS = 1_000_000  # splits up to which their keys (17 bytes each) are broadcast
AFTER_ALL = 1 << 40  # place of a record that goes on in the next split: behind all others of its own

MOST_KEPT = 1 << 20  # characters kept of a part before it is known whether it is needed; longer ones are read again
BLANK = "".join(map(chr, range(33)))  # a line of nothing else is no record

SPLITS = (
    "file string, block long, ends_inside boolean, ends_inside_if_open boolean, head string, left_open string, "
    "left_open_if_open string, dropped boolean, dropped_if_open boolean, any_whole boolean"
)
PARTS = "file string, block long, whole_head string, whole_left string"
RECORDS = "file string, block long, place long, record string"


def inside_at_end(line: str, inside: bool) -> bool:
    """Whether a line ends inside a quoted field, given whether it begins inside one."""
    at = 0
    if not inside:
        if not line.startswith('"'):
            at = line.find(',"') + 1
            if not at:
                return False
        at += 1
    while True:  # `at` stands inside a quoted field
        at = line.find('"', at)
        if at < 0:
            return True
        if line.startswith('"', at + 1):
            at += 2
            continue
        at = line.find(',"', at + 1)
        if at < 0:
            return False
        at += 2


def _lines(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[str]]]:
    """Lines of each split in order, in slices."""
    for batch in batches:
        files, blocks = batch.column("file").to_pylist(), batch.column("block").to_pylist()
        values = batch.column("value").to_pylist()
        start = 0
        for at in range(1, len(values) + 1):
            if at == len(values) or blocks[at] != blocks[start] or files[at] != files[start]:
                yield (files[start], blocks[start]), values[start:at]
                start = at


class _Open:
    """What a split holds of records that begin or end elsewhere, given whether it begins inside a field."""

    def __init__(self, inside: bool, most: float) -> None:
        self.inside = self.in_head = inside
        self.head: list[str] | None = [] if inside else None
        self.left: list[str] | None = None
        self.most, self.size, self.dropped, self.any_whole = most, 0, False, False

    def add(self, line: str, inside: bool) -> None:
        """Take in a line, at whose end the text is inside a field or not."""
        if not self.in_head and not inside:
            if self.left is not None or line.strip(BLANK):
                self.any_whole = True
            self.left, self.size = None, 0
        else:
            if not self.in_head and self.left is None:
                self.left, self.size = [], 0
            kept = self.head if self.in_head else self.left
            self.size += len(line)
            if self.size <= self.most:
                kept.append(line)
            elif kept:
                kept.clear()
            if self.in_head and not inside:
                self.dropped |= self.size > self.most
                self.in_head, self.size = False, 0
        self.inside = inside

    def texts(self) -> tuple[str | None, str | None, bool]:
        """Head, what is left open, and whether one of them was too long to be kept."""
        dropped = self.dropped or self.size > self.most
        head, left = ("\n".join(x) if x is not None else None for x in (self.head, self.left))
        return head, left, dropped


def _rows(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields]
    )


def _ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per split, under both assumptions."""
    split: tuple[str, int] | None = None
    for key, lines in _lines(batches):
        if key != split:
            if split is not None:
                yield _rows(SPLITS, [_end_row(split, outside, within)])
            split, outside, within = key, _Open(False, MOST_KEPT), _Open(True, MOST_KEPT)
        for line in lines:
            a, b = outside.inside, within.inside
            if '"' in line:
                a, b = inside_at_end(line, a), inside_at_end(line, b)
            outside.add(line, a)
            within.add(line, b)
    if split is not None:
        yield _rows(SPLITS, [_end_row(split, outside, within)])


def _end_row(split: tuple[str, int], outside: _Open, within: _Open) -> tuple:
    _, left, dropped = outside.texts()
    head, left_if_open, dropped_if_open = within.texts()
    return (
        *split, outside.inside, within.inside, head, left, left_if_open, dropped, dropped_if_open, outside.any_whole,
    )


def _parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Head and open end of splits whose beginning is known, however long."""
    split: tuple[str, int] | None = None
    for batch in batches:
        starts, at = batch.column("inside").to_pylist(), 0
        for key, lines in _lines([batch]):
            if key != split:
                if split is not None:
                    yield _rows(PARTS, [(*split, *found.texts()[:2])])
                split, found = key, _Open(starts[at], float("inf"))
            at += len(lines)
            for line in lines:
                found.add(line, inside_at_end(line, found.inside) if '"' in line else found.inside)
    if split is not None:
        yield _rows(PARTS, [(*split, *found.texts()[:2])])


def _whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records that begin and end in the same split, numbered in order."""
    split: tuple[str, int] | None = None
    for batch in batches:
        starts = batch.column("inside").to_pylist()
        at, rows = 0, []
        for key, lines in _lines([batch]):
            if key != split:
                split, inside, parts, place = key, starts[at], [], 0
                skipped = inside
            at += len(lines)
            for line in lines:
                if '"' in line:
                    inside = inside_at_end(line, inside)
                if skipped:
                    skipped = inside
                elif inside:
                    parts.append(line)
                elif parts or line.strip(BLANK):
                    if parts:
                        line = "\n".join([*parts, line])
                        parts = []
                    rows.append((*key, place, line))
                    place += 1
        yield _rows(RECORDS, rows)


def split_states(ends: DataFrame) -> DataFrame:
    """Each split's row with `inside`: whether it begins inside a field. One small row per split is looked at.

    A split ends the same way under both assumptions (then all before it is forgotten), or as it began, or the other
    way round; so the state follows from the last split of the first kind and the turns since.
    """
    order = Window.partitionBy("file").orderBy("block")
    fixed = F.when(F.col("ends_inside") == F.col("ends_inside_if_open"), F.col("ends_inside").cast("int"))
    turns = (F.col("ends_inside") & ~F.col("ends_inside_if_open")).cast("int")
    known = ends.withColumns({"fixed": fixed, "turned": F.sum(turns).over(order)})
    last = F.last("fixed", ignorenulls=True).over(order)
    turned_then = F.last(F.when(F.col("fixed").isNotNull(), F.col("turned")), ignorenulls=True).over(order)
    end = (F.coalesce(last, F.lit(0)) + F.col("turned") - F.coalesce(turned_then, F.lit(0))) % 2
    return known.withColumn("end", end).withColumn("inside", F.coalesce(F.lag("end").over(order) == 1, F.lit(False)))


def _across(states: DataFrame, again: DataFrame | None) -> DataFrame:
    """Records that begin in one split and end in another, or with the file: parts in order, joined by the line feed."""
    inside = F.col("inside")
    head, left = F.col("head"), F.when(inside, F.col("left_open_if_open")).otherwise(F.col("left_open"))
    if again is not None:
        states = states.join(again, ["file", "block"], "left")
        head, left = F.coalesce("whole_head", head), F.coalesce("whole_left", left)
    parts = states.select(
        "file", "block", F.when((F.col("block") == 0) & ~F.col("any_whole"), 0).otherwise(AFTER_ALL).alias("place"),
        F.explode(F.filter(F.array(
            F.when(inside, F.struct(F.lit(0).alias("part"), F.lit(0).alias("begins"), head.alias("text"))),
            F.when(left.isNotNull(), F.struct(F.lit(1).alias("part"), F.lit(1).alias("begins"), left.alias("text"))),
        ), lambda p: p.isNotNull())).alias("p"),
    ).select("file", "block", "place", "p.*")
    order = Window.partitionBy("file").orderBy("block", "part")
    joined = parts.withColumn("number", F.sum("begins").over(order)).groupBy("file", "number").agg(
        F.min("block").alias("block"), F.min("place").alias("place"),
        F.array_sort(F.collect_list(F.struct("block", "part", "text"))).alias("parts"),
    )
    text = F.array_join(F.transform("parts", lambda p: p["text"]), "\n")
    return joined.select("file", "block", "place", text.alias("record"))


def _begun(lines: DataFrame, splits: DataFrame, every: bool) -> DataFrame:
    """Lines with `inside`, their split's beginning. `splits` has the splits to read, or (`every`) those begun inside."""
    keys = splits.select(F.xxhash64("file").alias("file_key"), F.col("block").alias("at"), F.col("inside").alias("begun"))
    on = (F.xxhash64(lines["file"]) == F.col("file_key")) & (lines["block"] == F.col("at"))
    how = "left" if every else "inner"
    if keys.count() <= MOST_KEYS:
        known = lines.join(F.broadcast(keys), on, how)
    else:  # so many keys are joined by a shuffle, and lines put in order again
        numbered = lines.withColumn("line", F.monotonically_increasing_id())
        known = numbered.join(keys, on, how).repartition("file", "block").sortWithinPartitions("file", "block", "line")
    return known.select("value", "file", "block", F.coalesce("begun", F.lit(False)).alias("inside"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """`file, block, place, record`: every record of the files as text; block and place give its order in its file.

    Blank records are left out, as Spark's own reader does. A last record whose quote is never closed ends with its
    file. An empty file has no records.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.make_valid_utf8("value").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    )
    states = cut(split_states(cut(lines.mapInArrow(_ends, SPLITS), "split-ends")), "split-states")
    dropped = F.when(F.col("inside"), F.col("dropped_if_open")).otherwise(F.col("dropped"))
    long = states.where(dropped)
    again = None if long.isEmpty() else _begun(lines, long, False).mapInArrow(_parts, PARTS)
    whole = _begun(lines, states.where("inside"), True).mapInArrow(_whole, RECORDS)
    records = whole.unionByName(_across(states, again))
    return records.withColumn("record", F.regexp_replace("record", "\\r\\z", ""))


def parsed(records: DataFrame, columns: Sequence[str], bad: str) -> DataFrame:
    """`file, block, place`, every column as text, and in `bad` the record itself if it has another number of fields.

    The header is the first record that begins in the first split of its file; it is left out.
    """
    schema = ", ".join(f"`{c}` string" for c in [*columns, bad])
    value = F.from_csv("record", F.lit(schema), {**OPTIONS, "columnNameOfCorruptRecord": bad})
    body = records.where("NOT (block = 0 AND place = 0)")
    return body.select("file", "block", "place", value.alias("v")).select("file", "block", "place", "v.*")
