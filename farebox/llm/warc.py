"""WARC archives as a Spark data source, `spark.read.format("warc")` and `df.write.format("warc")`.

Writing makes one gzip member per record. Each member carries its own length in the gzip extra field `sl`, so that a
reader can go to the next record without inflating this one. A task rolls over to a new file at a size limit; files are
listed in a manifest when the job commits, and readers take listed files only, so a lost or repeated task leaves no rows.

Reading plans partitions over files, takes predicates on record type and header fields into the scan, inflates the
headers of a record first, and skips the rest of records that aren't wanted. Archives of other writers (plain, or gzip
without lengths) are read too; where a length is missing, a member is inflated to find its end, but not decoded.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual,
    In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringStartsWith, WriterCommitMessage,
)

from farebox.session import scratch_path

LEAST_PAYLOAD = 100  # bytes; smaller payloads are never revisits
FILE_BYTES = 64 << 20
PARTITION_BYTES = 64 << 20
BATCH_BYTES = 8 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"  # pages carry no time

SCHEMA = (
    "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"
)
_TYPES = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
    ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()),
])
_HEADER_COLUMNS = {"page_id", "url", "record_type", "refers_to", "payload_digest"}


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page_id(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def record(page_id: int | None, url: str | None, kind: str, refers_to: int | None, digest: str, size: int, payload: bytes) -> bytes:
    """One WARC record; a revisit holds the HTTP header of what it repeats, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
        lines.append(f"WARC-Target-URI: {safe}")
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if kind == "revisit":
        lines += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member with the extra field `sl`: lengths of the whole member and of its content."""
    deflate = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    total = 24 + len(body) + 8
    head = b"\x1f\x8b\x08\x04" + bytes(4) + b"\x04\xff" + struct.pack("<H2sHII", 12, b"sl", 8, total, len(data) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode(errors="replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if v}


class _Bytes:
    """Content of a record, inflated or read as far as asked for."""

    def __init__(self, more: Callable[[], bytes]) -> None:
        self.more, self.got, self.ended = more, bytearray(), False

    def upto(self, done: Callable[[bytearray], bool]) -> bytearray:
        while not self.ended and not done(self.got):
            part = self.more()
            self.ended = not part
            self.got += part
        return self.got


CHUNK = 1 << 13


def records(f: pa.NativeFile, size: int) -> Iterator[tuple[dict[str, str], Callable[[], bytes]]]:
    """Headers of each record, and a function that reads its block if it is called before the next record."""
    at = 0
    while at < size:
        f.seek(at)
        head = f.read(24)
        if not head.strip(b"\r\n\x00"):
            return
        if head[:2] == b"\x1f\x8b":
            sized = len(head) >= 24 and head[3] & 4 and head[12:14] == b"sl" and struct.unpack("<H", head[10:12])[0] == 12
            length = struct.unpack("<I", head[16:20])[0] if sized else None
            inflate = zlib.decompressobj(31)
            f.seek(at)
            state = {"read": at}

            def more(inflate=inflate, state=state) -> bytes:
                while not inflate.eof:
                    raw = inflate.unconsumed_tail or f.read(CHUNK)
                    if not raw:
                        raise ValueError("an archive ends within a record")
                    if not inflate.unconsumed_tail:
                        state["read"] += len(raw)
                    made = inflate.decompress(raw, 1 << 20)
                    if made:
                        return made
                return b""

            content = _Bytes(more)
            raw = content.upto(lambda got: b"\r\n\r\n" in got)
            headers = _headers(bytes(raw[: raw.index(b"\r\n\r\n")]))
            start = raw.index(b"\r\n\r\n") + 4
            n = int(headers.get("content-length", 0))

            def block(content=content, start=start, n=n) -> bytes:
                return bytes(content.upto(lambda got: len(got) >= start + n)[start : start + n])

            yield headers, block
            if length is None:
                while content.more():
                    pass
                length = state["read"] - len(inflate.unused_data) - at
            at += length
        else:
            f.seek(at)
            content = _Bytes(lambda: f.read(CHUNK))
            raw = content.upto(lambda got: b"\r\n\r\n" in got)
            skip = len(raw) - len(raw.lstrip(b"\r\n"))
            end = raw.find(b"\r\n\r\n", skip)
            if end < 0:
                raise ValueError("an archive ends within a header")
            headers = _headers(bytes(raw[skip:end]))
            start, n = at + end + 4, int(headers.get("content-length", 0))

            def block(start=start, n=n) -> bytes:
                f.seek(start)
                return f.read(n)

            yield headers, block
            at = start + n + 4


def _row(headers: dict[str, str]) -> dict:
    return {
        "page_id": _page_id(headers.get("warc-record-id")),
        "url": headers.get("warc-target-uri"),
        "record_type": headers.get("warc-type"),
        "refers_to": _page_id(headers.get("warc-refers-to")),
        "payload_digest": (headers.get("warc-payload-digest") or "").removeprefix("sha256:") or None,
    }


def _holds(f: Filter, row: dict) -> bool:
    if isinstance(f, Not):
        child = f.child
        value = row[child.attribute[0]]
        return (value is not None or isinstance(child, IsNull | IsNotNull | EqualNullSafe)) and not _holds(child, row)
    value = row[f.attribute[0]]
    if isinstance(f, IsNull):
        return value is None
    if isinstance(f, IsNotNull):
        return value is not None
    if isinstance(f, EqualNullSafe):
        return value == f.value
    if value is None:
        return False
    if isinstance(f, EqualTo):
        return value == f.value
    if isinstance(f, In):
        return value in f.value
    if isinstance(f, StringStartsWith):
        return value.startswith(f.value)
    if isinstance(f, GreaterThan):
        return value > f.value
    if isinstance(f, GreaterThanOrEqual):
        return value >= f.value
    return value < f.value if isinstance(f, LessThan) else value <= f.value


_SUPPORTED = (
    EqualTo, EqualNullSafe, In, IsNull, IsNotNull, StringStartsWith, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual,
)


def _pushable(f: Filter) -> bool:
    if isinstance(f, Not):
        f = f.child
    return isinstance(f, _SUPPORTED) and len(f.attribute) == 1 and f.attribute[0] in _HEADER_COLUMNS


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The store a path is in, and the path there. Paths without a scheme are taken as they are."""
    if "://" not in path and path.startswith("file:"):
        path = "file://" + path[5:]
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


@dataclass
class Files(InputPartition):
    files: list[tuple[str, int]]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"].rstrip("/")
        self.limit = int(options.get("partitionbytes", PARTITION_BYTES))
        self.payloads = options.get("payloads", "true").lower() == "true"
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if _pushable(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Files]:
        store, path = _filesystem(self.path)
        found = store.get_file_info(pafs.FileSelector(path, recursive=True))
        manifests = [x.path for x in found if x.base_name.startswith("_manifest-")]
        if manifests:
            files = []
            for name in manifests:
                with store.open_input_stream(name) as f:
                    files += [(f"{path}/{n}", size) for n, size in json.loads(f.read())]
        else:
            files = [(x.path, x.size) for x in found if x.is_file and x.base_name.endswith((".warc", ".warc.gz"))]
        out: list[Files] = []
        room = 0
        for name, size in sorted(files):
            if not out or size > room:
                out.append(Files([]))
                room = self.limit
            out[-1].files.append((name, size))
            room -= size
        return out

    def read(self, partition: Files | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's way of reading a folder without files
            return
        store, _ = _filesystem(self.path)
        rows, held = [], 0
        for name, size in partition.files:
            with store.open_input_file(name) as f:
                for headers, block in records(f, size):
                    row = _row(headers)
                    if not all(_holds(x, row) for x in self.filters):
                        continue
                    row |= self.content(row["record_type"], block)
                    rows.append(row)
                    held += 500 + len(row["payload"] or b"")
                    if held > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, _TYPES)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _TYPES)

    def content(self, kind: str | None, block: Callable[[], bytes]) -> dict:
        """Payload and its length; a revisit's length is in its HTTP header. Other kinds have none."""
        if kind not in ("response", "revisit") or kind == "response" and not self.payloads:
            return {"payload": None, "payload_bytes": None}
        http, _, payload = block().partition(b"\r\n\r\n")
        if kind == "response":
            return {"payload": payload, "payload_bytes": len(payload)}
        n = _headers(http).get("content-length", "")
        return {"payload": None, "payload_bytes": int(n) if n.isdigit() else None}


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int]]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        if overwrite:
            raise ValueError("archives are only ever added to; write to a new folder")
        self.path = options["path"].rstrip("/")
        self.limit = int(options.get("filebytes", FILE_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, path = _filesystem(self.path)
        store.create_dir(path, recursive=True)
        files, out, size = [], None, 0
        try:
            for batch in iterator:
                for r in batch.to_pylist():
                    made = member(record(*(r[k] for k in (
                        "page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"
                    ))))
                    if out is None:
                        name, size = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{path}/{name}", compression=None)
                    out.write(made)
                    size += len(made)
                    if size >= self.limit:
                        out.close()
                        files.append((name, size))
                        out = None
        finally:
            if out is not None:
                out.close()
                files.append((name, size))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, path = _filesystem(self.path)
        store.create_dir(path, recursive=True)
        listed = [f for m in messages if m is not None for f in m.files]
        with store.open_output_stream(f"{path}/_manifest-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps(listed).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Files of a failed job stay unlisted, so no reader sees them."""


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def use(spark: SparkSession) -> SparkSession:
    """Make the source known to a session; its predicates need Spark's push-down for Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark


def planned(pages: DataFrame) -> DataFrame:
    """One record per page: `page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload`.

    The payload is html in UTF-8, null as empty. Of pages with equal payloads of LEAST_PAYLOAD bytes or more, that with
    the smallest page_id is the response and others revisit it. Rows that repeat the smallest page_id are responses
    too. A null page_id is never the smallest; a group of such pages alone is all responses.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).select(
        "*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest")
    )
    first = (
        rows.where(F.col("payload_bytes") >= LEAST_PAYLOAD).groupBy("payload_digest")
        .agg(F.min("page_id").alias("first_id")).withColumnRenamed("payload_digest", "first_digest")
    )
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return rows.join(first, F.col("payload_digest") == F.col("first_digest"), "left").select(
        F.col("page_id").cast("long").alias("page_id"), "url",
        F.when(again, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.when(again, F.col("first_id")).cast("long").alias("refers_to"),
        "payload_digest", "payload_bytes", F.when(~again, F.col("payload")).alias("payload"),
    )


def write_archives(pages: DataFrame, path: str) -> None:
    use(pages.sparkSession)
    planned(pages).write.format("warc").mode("append").save(path)


def read_archives(spark: SparkSession, path: str, **options: str) -> DataFrame:
    return use(spark).read.format("warc").options(**options).load(path)


def round_trip(pages: DataFrame) -> DataFrame:
    """`page_id, payload_bytes, payload_digest, record_type, refers_to` of archives written and read back.

    Length and digest of a response are those of the payload that was read; a revisit states them in its headers.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path)
    back = read_archives(spark, path)
    digest = F.when(F.col("record_type") == "response", F.sha2("payload", 256)).otherwise(F.col("payload_digest"))
    return back.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")
