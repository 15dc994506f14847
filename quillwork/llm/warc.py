"""WARC archives in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames.  After them a bundle holds, in skippable frames, an index that
maps record identifiers to (frame, offset within the frame, length), and last the public seek table (compressed and
plain size of each frame).  Any record is read by its frame alone, and a plain ``zstd -d`` still reads the archive.

Equal payloads (SHA-1 and length) are stored once: the row with the smallest page id is a ``response``, the others are
``revisit`` records that refer to it.  The smallest row of each payload is found by a pre-aggregated minimum and joined
back by digest; a hot digest is a skewed join that adaptive execution splits.

Defined cases: null html is an empty payload; null page ids come last among equal payloads; of repeated rows (same id,
same payload) the first in scan order is the response and the rest revisit it; an empty table gives no bundle; other
columns are ignored.  Payloads under ``min_bytes`` are always responses.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwork.llm import common

#: Fixed values of the seekable format and of skippable frames.
SEEK_FRAME, INDEX_FRAME, SEEK_FOOT = 0x184D2A5E, 0x184D2A5D, 0x8F92EAB1
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 64 << 20
DATE = "2026-01-01T00:00:00Z"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: int | None, row: int) -> str:
    return f"<urn:x-page:{'' if page is None else page}:{row}>"


def page_of(identifier: str) -> int | None:
    held = identifier.strip("<>").split(":")[2]
    return int(held) if held else None


def to_record(kind: str, own: str, uri: str, payload: bytes, refers: str | None, digest: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    uri = "".join(c for c in uri if c not in "\r\n")
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {own}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {refers}"]
    head.append(f"Content-Length: {len(block)}")
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], int, bytes | None]:
    """Headers, length of the full payload, and the payload (null for a revisit)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(http.rpartition(b"Content-Length: ")[2])
    return fields, length, payload if fields["WARC-Type"] == "response" else None


class Bundle:
    """Collects records; ``close`` gives the bytes of the archive."""

    def __init__(self, level: int = 3) -> None:
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.open: list[bytes] = []
        self.open_bytes = self.bytes = 0
        self.index: list[tuple[str, int, int, int]] = []

    def add(self, own: str, record: bytes) -> None:
        self.index.append((own, len(self.frames), self.open_bytes, len(record)))
        self.open.append(record)
        self.open_bytes += len(record)
        if self.open_bytes >= FRAME_BYTES:
            self._end_frame()

    def _end_frame(self) -> None:
        raw = b"".join(self.open)
        packed = self.packer.compress(raw)
        self.frames.append(packed)
        self.sizes.append((len(packed), len(raw)))
        self.bytes += len(packed)
        self.open, self.open_bytes = [], 0

    def close(self) -> bytes:
        if self.open:
            self._end_frame()
        index = b"".join(struct.pack("<H", len(k := own.encode())) + k + struct.pack("<III", frame, at, n) for own, frame, at, n in self.index)
        index = zstandard.ZstdCompressor().compress(index)
        table = b"".join(struct.pack("<II", *x) for x in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEK_FOOT)
        tail = struct.pack("<II", INDEX_FRAME, len(index)) + index + struct.pack("<II", SEEK_FRAME, len(table)) + table
        return b"".join(self.frames) + tail


class BundleReader:
    """Reads an open archive by its footer: seek table, record index, single frames."""

    def __init__(self, file) -> None:
        self.file = file
        end = file.size()
        count, _, magic = struct.unpack("<IBI", file.read_at(9, end - 9))
        if magic != SEEK_FOOT:
            raise ValueError("no seek table")
        table = file.read_at(8 * count, end - 9 - 8 * count)
        self.sizes = list(struct.iter_unpack("<II", table))
        self.starts, at = [], 0
        for packed, _ in self.sizes:
            self.starts.append(at)
            at += packed
        magic, n = struct.unpack("<II", file.read_at(8, at))
        if magic != INDEX_FRAME:
            raise ValueError("no record index")
        raw, at = zstandard.ZstdDecompressor().decompress(file.read_at(n, at + 8)), 0
        self.index: list[tuple[str, int, int, int]] = []
        while at < len(raw):
            (k,) = struct.unpack_from("<H", raw, at)
            self.index.append((raw[at + 2 : at + 2 + k].decode(), *struct.unpack_from("<III", raw, at + 2 + k)))
            at += 14 + k
        self.held: tuple[int, bytes] = (-1, b"")

    def frame(self, i: int) -> bytes:
        if self.held[0] != i:
            packed, plain = self.sizes[i]
            self.held = (i, zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, self.starts[i]), max_output_size=plain))
        return self.held[1]

    def record(self, frame: int, offset: int, length: int) -> bytes:
        return self.frame(frame)[offset : offset + length]


def with_first(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0) -> DataFrame:
    """``page, row, url, payload, first`` where ``first`` is the (page, row) that holds the row's payload, or null."""
    rows = pages.select(
        F.col(key).cast("long").alias("page"), F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("payload")
    ).withColumn("mark", F.concat(F.sha1(F.col("payload").cast("binary")), F.lit("-"), F.octet_length("payload")))
    place = F.struct(F.col("page").isNull().alias("none"), F.col("page"), F.col("row"))
    first = rows.filter(F.octet_length("payload") >= min_bytes).groupBy(F.col("mark").alias("first_mark")).agg(F.min(place).alias("first"))
    return rows.join(first, F.col("mark") == F.col("first_mark"), "left").select("page", "row", "url", "payload", "first")


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0) -> DataFrame:
    """Writes the bundles; the stored record index: ``page, row, file, frame, offset, length``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part, attempt, made, bundle = task.partitionId(), task.taskAttemptId(), 0, Bundle()

        def flush() -> pa.RecordBatch:
            name = f"bundle-{part:06d}-{attempt}-{made:04d}.warc.zst"
            common.publish(f"{folder}/{name}", bundle.close())
            own, frame, at, n = zip(*bundle.index)
            row = [int(x.strip("<>").split(":")[3]) for x in own]
            return pa.RecordBatch.from_arrays([pa.array([page_of(x) for x in own], pa.int64()), pa.array(row, pa.int64()), pa.array([name] * len(own), pa.string()), *(pa.array(x, pa.int32()) for x in (frame, at, n))], ["page", "row", "file", "frame", "offset", "length"])

        for b in common.blocks(batches, "payload"):
            for page, row, uri, text, first in zip(*(b.column(c).to_pylist() for c in ("page", "row", "url", "payload", "first"))):
                data = text.encode()
                mine = first is None or (first["page"], first["row"]) == (page, row)
                own = record_id(page, row)
                bundle.add(own, to_record("response" if mine else "revisit", own, uri, data, None if mine else record_id(first["page"], first["row"]), digest32(data)))
                if bundle.bytes >= BUNDLE_BYTES:
                    yield flush()
                    made, bundle = made + 1, Bundle()
        if bundle.index:
            yield flush()

    rows = with_first(pages, key, url, payload, min_bytes)
    return common.stored(rows.mapInArrow(run, "page long, row long, file string, frame int, offset int, length int"), "warc-index")


def read(index: DataFrame, folder: str) -> DataFrame:
    """Every record of the indexed bundles, from the archives: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    Stored payloads are digested anew and must match their header."""
    n = max(1, index.sparkSession.sparkContext.defaultParallelism)
    files = index.select("file").distinct().repartition(8 * n, "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column("file").to_pylist():
                fs, at = common.open_fs(f"{folder}/{name}")
                out = []
                with fs.open_input_file(at) as f:
                    reader = BundleReader(f)
                    for own, frame, offset, length in reader.index:
                        fields, size, payload = parse_record(reader.record(frame, offset, length))
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        if fields["WARC-Record-ID"] != own or payload is not None and (len(payload) != size or digest32(payload) != digest):
                            raise ValueError(f"{name}: record {own} does not match its index or digest")
                        out.append((page_of(own), size, digest, fields["WARC-Type"], page_of(fields["WARC-Refers-To"]) if payload is None else None))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return files.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def fetch(index: DataFrame, folder: str, wanted: DataFrame, key: str = "page_id") -> DataFrame:
    """``page_id, payload`` of the stored responses of these pages; reads their frames alone."""
    near = index.join(wanted.select(F.col(key).cast("long").alias("page")).distinct(), "page", "left_semi").repartition("file").sortWithinPartitions("file", "frame")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, reader = None, None
        for b in batches:
            out = []
            for page, file, frame, offset, length in zip(*(b.column(c).to_pylist() for c in ("page", "file", "frame", "offset", "length"))):
                if file != name:
                    fs, at = common.open_fs(f"{folder}/{file}")
                    name, reader = file, BundleReader(fs.open_input_file(at))
                payload = parse_record(reader.record(frame, offset, length))[2]
                if payload is not None:
                    out.append((page, payload.decode()))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string())], ["page_id", "payload"])

    return near.mapInArrow(run, "page_id long, payload string")
