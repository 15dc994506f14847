"""Token ids in directly addressable files.

Every id is cut into chunks of ``CHUNK`` bits.  Level 0 of a file holds the lowest chunk of every id; a continuation
bitmap says which ids go on; level 1 holds the next chunk of those alone, and so on.  A rank directory beside each
bitmap counts the set bits before every ``DIRECTORY`` bytes, so the place of an id on each level is found from its
position, and any token is read without decoding its neighbours.  A file ends in an index of its rows.

Rows are dealt by key range, so file order is key order; a file holds at most ``segment`` ids (more only for one
longer row), and a task that runs again replaces its own files.  Global starts are sums over the manifest.

Defined cases: null text is empty text and holds only the end id; a null key sorts first; rows with equal keys are
ordered by their text and each has its own entry; an empty table gives an empty manifest; other columns are ignored.
Keys are integers.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillwork.llm import bpe, common

MAGIC, CHUNK, DIRECTORY = b"QWDAC001", 8, 64
#: Ids of one file.
SEGMENT = 1 << 20
_ONES = np.array([bin(i).count("1") for i in range(256)], np.int64)


def pack(ids: np.ndarray) -> bytes:
    """Levels of one file: for each the number of chunks, the chunks, the bitmap and its rank directory."""
    out, rest = [], np.asarray(ids, np.uint64)
    levels = 0
    while True:
        more = rest >> np.uint64(CHUNK)
        goes_on = more > 0
        bitmap = np.packbits(goes_on, bitorder="little")
        bitmap = np.concatenate([bitmap, np.zeros(-len(bitmap) % DIRECTORY, np.uint8)])
        ones = _ONES[bitmap].reshape(-1, DIRECTORY).sum(1)
        directory = (np.cumsum(ones) - ones).astype("<u8")
        out += [struct.pack("<QQ", len(rest), len(bitmap)), (rest & np.uint64(255)).astype(np.uint8).tobytes(), bitmap.tobytes(), directory.tobytes()]
        levels += 1
        rest = more[goes_on]
        if not len(rest):
            return struct.pack("<I", levels) + b"".join(out)


class Reader:
    """Random access to the ids of a packed file."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        body, self.rows = struct.unpack_from("<QQ", data, 8)
        at = 24
        (levels,) = struct.unpack_from("<I", data, at)
        at += 4
        self.levels = []
        for _ in range(levels):
            n, width = struct.unpack_from("<QQ", data, at)
            at += 16
            chunks = np.frombuffer(data, np.uint8, n, at)
            bitmap = np.frombuffer(data, np.uint8, width, at + n)
            directory = np.frombuffer(data, "<u8", width // DIRECTORY, at + n + width).astype(np.int64)
            at += n + width + 8 * (width // DIRECTORY)
            self.levels.append((chunks, bitmap, directory))
        at = 24 + body
        self.key = np.frombuffer(data, "<i8", self.rows, at)
        self.null = np.frombuffer(data, np.uint8, self.rows, at + 8 * self.rows).astype(bool)
        self.start = np.frombuffer(data, "<u8", self.rows + 1, at + 9 * self.rows).astype(np.int64)

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def get(self, positions: np.ndarray) -> np.ndarray:
        """The ids at these positions, whatever their order."""
        at = np.asarray(positions, np.int64)
        out = np.zeros(len(at), np.uint64)
        live = np.arange(len(at))
        for k, (chunks, bitmap, directory) in enumerate(self.levels):
            out[live] |= chunks[at].astype(np.uint64) << np.uint64(CHUNK * k)
            byte, bit = at >> 3, (at & 7).astype(np.uint8)
            on = (bitmap[byte] >> bit) & 1 == 1
            live, at, byte, bit = live[on], at[on], byte[on], bit[on]
            if not len(live):
                break
            before = np.concatenate([[0], np.cumsum(_ONES[bitmap])])
            block = byte // DIRECTORY
            within = before[byte] - before[block * DIRECTORY] + _ONES[bitmap[byte] & ((np.uint8(1) << bit) - np.uint8(1))]
            at = directory[block] + within
        return out.astype(np.uint32)

    def one(self, position: int) -> int:
        """One id, reading a chunk, a directory entry and at most ``DIRECTORY`` bitmap bytes of each level."""
        at, value = position, 0
        for k, (chunks, bitmap, directory) in enumerate(self.levels):
            value |= int(chunks[at]) << (CHUNK * k)
            if not bitmap[at >> 3] >> (at & 7) & 1:
                return value
            block = (at >> 3) // DIRECTORY
            head = bitmap[block * DIRECTORY : at >> 3]
            at = int(directory[block]) + int(_ONES[head].sum()) + bin(int(bitmap[at >> 3]) & ((1 << (at & 7)) - 1)).count("1")
        return value


def to_file(ids: np.ndarray, key: list, start: np.ndarray) -> bytes:
    body = pack(ids)
    keys = np.array([0 if k is None else k for k in key], "<i8")
    null = np.array([k is None for k in key], np.uint8)
    return MAGIC + struct.pack("<QQ", len(body), len(key)) + body + keys.tobytes() + null.tobytes() + np.asarray(start, "<u8").tobytes()


def library_encoder(path: str, together: int = 2000):
    """Encodes distinct chunks with the tokenizers library.

    Chunks that begin with a space and end without one keep their borders when they stand in a row, so the library
    gets ``together`` of them as one text; the byte lengths of its tokens tell them apart again."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    size = bpe.decoder(path).length

    def ids_of(text: str) -> np.ndarray:
        return np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def encode(chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        start, length, flat, total = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64), [], 0
        whole = pc.match_substring_regex(chunks, f"(?s)^ [^{bpe.WHITE}](?:.*[^{bpe.WHITE}])?$").to_numpy(zero_copy_only=False)
        joined = np.flatnonzero(whole)
        own = chunks.take(pa.array(joined))
        ends = np.cumsum(pc.binary_length(own).to_numpy(zero_copy_only=False).astype(np.int64))
        for at in range(0, len(joined), together):
            part, upto = joined[at : at + together], ends[at : at + together] - (ends[at - 1] if at else 0)
            got = ids_of("".join(own.slice(at, together).to_pylist()))
            cut = np.searchsorted(np.cumsum(size[got]), upto) + 1
            length[part] = np.diff(cut, prepend=0)
            start[part] = total + cut - length[part]
            flat.append(got)
            total += len(got)
        for i in np.flatnonzero(~whole).tolist():
            got = ids_of(chunks[i].as_py())
            start[i], length[i] = total, len(got)
            flat.append(got)
            total += len(got)
        ids = np.concatenate(flat) if flat else np.zeros(0, np.uint32)
        return ids[common.ragged(start, length)], length

    return encode


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> bpe.Chunks:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return bpe.Chunks(library_encoder(path))


def write(df: DataFrame, path: str, folder: str, end_id: int = 0, segment: int = SEGMENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes token files in ``folder`` in ascending key order; the manifest: ``part, segment, file, n_rows, n_ids, base``."""
    rows = common.plain_text(df, key, text).withColumn("key", F.col("key").cast("long"))
    rows = rows.repartitionByRange("key").sortWithinPartitions("key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get(), []
        part, attempt = task.partitionId(), task.taskAttemptId()
        held, keys, lengths, size = [], [], [], 0

        def flush() -> None:
            ids = np.concatenate(held)
            start = np.concatenate([[0], np.cumsum(lengths)])
            name = f"tokens-{part:06d}-{attempt}-{len(made):05d}.qwdac"
            common.publish(f"{folder}/{name}", to_file(ids, keys, start))
            made.append((part, len(made), name, len(keys), len(ids)))
            held.clear(), keys.clear(), lengths.clear()

        for b in common.blocks(batches):
            ids, begin = encoder(path)(b.column("text"))
            for i, k in enumerate(b.column("key").to_pylist()):
                own = np.append(ids[begin[i] : begin[i + 1]], np.uint32(end_id))
                if held and size + len(own) > segment:
                    flush()
                    size = 0
                held.append(own), keys.append(k), lengths.append(len(own))
                size += len(own)
        if held:
            flush()
        names = ["part", "segment", "file", "n_rows", "n_ids"]
        if made:
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), kinds)], names)

    found = common.stored(rows.mapInArrow(run, "part int, segment int, file string, n_rows long, n_ids long"), "token-manifest")
    # Starts: a running total of the parts, one row for each task that wrote, and one within each part.
    ahead = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = found.groupBy("part").agg(F.sum("n_ids").alias("all")).select("part", F.coalesce(F.sum("all").over(ahead(Window.orderBy("part"))), F.lit(0).cast("long")).alias("before"))
    within = F.coalesce(F.sum("n_ids").over(ahead(Window.partitionBy("part").orderBy("segment"))), F.lit(0).cast("long"))
    return found.join(parts, "part").select(*found.columns, (F.col("before") + within).alias("base"))


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """Per row of the files: ``doc_id, start, n_tokens, ids_crc32``, each read by its position."""
    n = max(1, manifest.sparkSession.sparkContext.defaultParallelism)
    files = manifest.select("file", "base").repartition(8 * n, "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, base in zip(b.column("file").to_pylist(), b.column("base").to_pylist()):
                fs, at = common.open_fs(f"{folder}/{name}")
                with fs.open_input_file(at) as f:
                    reader = Reader(f.read())
                raw = memoryview(reader.get(np.arange(len(reader))).astype("<u4").tobytes())
                s = reader.start
                crc = [zlib.crc32(raw[4 * s[i] : 4 * s[i + 1]]) for i in range(reader.rows)]
                yield pa.RecordBatch.from_arrays([pa.array(reader.key.astype(np.int64), mask=reader.null), pa.array(base + s[:-1], pa.int64()), pa.array(np.diff(s), pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokens_at(manifest: DataFrame, folder: str, positions: DataFrame) -> DataFrame:
    """``position, id`` of global positions (column ``position``): each is sent to the file that holds it."""
    edge = manifest.filter("n_ids > 0").select("file", "base", (F.col("base") + F.col("n_ids")).alias("upto"))
    both = edge.join(positions.select("position"), (F.col("position") >= F.col("base")) & (F.col("position") < F.col("upto")))
    near = both.select("file", "position", (F.col("position") - F.col("base")).alias("local")).repartition("file").sortWithinPartitions("file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, reader = None, None
        for b in batches:
            out = []
            for file, local in zip(b.column("file").to_pylist(), b.column("local").to_pylist()):
                if file != name:
                    fs, at = common.open_fs(f"{folder}/{file}")
                    with fs.open_input_file(at) as f:
                        name, reader = file, Reader(f.read())
                out.append(reader.one(local))
            yield pa.RecordBatch.from_arrays([b.column("position"), pa.array(out, pa.int64())], ["position", "id"])

    return near.mapInArrow(run, "position long, id long")
