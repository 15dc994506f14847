"""Shared pieces of the training-text operators: table access, the shared folder, Arrow word blocks."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
#: Text bytes handled at once by a Python worker, and sent to it at once; a single longer text is a block of its own.
BLOCK_BYTES, BATCH_BYTES = 4 << 20, 4 << 20
SHINGLE_WORDS = 5
MIX = np.uint64(0x9E3779B97F4A7C15)
NOT_WORD = r"[^\p{L}\p{N}]+"


def prepare(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package even where the driver's path is not theirs, and bounds their batches."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, have) if x)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``); a temporary one where none is set and all is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext.getCheckpointDir()
        if not held and not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = held or "file://" + tempfile.mkdtemp(prefix="quillwork-")
        if not held:
            spark.sparkContext.setCheckpointDir(found)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quillwork/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, wanted: DataFrame, key: str, name: str) -> DataFrame:
    """The rows of ``df`` whose ``key`` is in ``wanted``, stored in buckets of ``key``, as many as shuffles have
    partitions: ``df`` moves once, and later joins on ``key`` move their other side alone."""
    spark = df.sparkSession
    table = f"quillwork_{uuid.uuid4().hex}"
    buckets = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 100_000)
    kept = df.repartition(buckets, key).join(wanted, key, "left_semi")
    kept.write.format("parquet").bucketBy(buckets, key).option("path", scratch(spark, name)).saveAsTable(table)
    return spark.table(table)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


def publish(uri: str, data: bytes) -> None:
    """Writes a whole file under a temporary name, then moves it: a task that runs again replaces its own file."""
    fs, path = open_fs(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    held = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(held) as f:
        f.write(data)
    fs.move(held, path)


def plain_text(df: DataFrame, key: str, text: str) -> DataFrame:
    """Two columns, named alike whatever else ``df`` holds; null texts are empty texts."""
    return df.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``limit`` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.cumsum(size)
        at = 0
        while at < len(size):
            upto = int(np.searchsorted(total, (total[at - 1] if at else 0) + limit, side="right"))
            upto = max(upto, at + 1)
            yield batch.slice(at, upto - at)
            at = upto


def large(text: pa.Array) -> pa.Array:
    return text.cast(pa.large_string()) if not pa.types.is_large_string(text.type) else text


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices start[i], start[i]+1, ... for ``length[i]`` each, one after another."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(length) - length
    return np.repeat(start - first, length) + np.arange(total, dtype=np.int64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shift, multiply), elementwise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


@dataclass
class Words:
    """Words of several texts: ``code[begin[i]:begin[i+1]]`` index ``vocabulary`` for text i."""

    begin: np.ndarray
    code: np.ndarray
    vocabulary: list[str]

    def hashes(self) -> np.ndarray:
        one = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in self.vocabulary), np.uint64, len(self.vocabulary))
        return one[self.code] if len(self.code) else np.zeros(0, np.uint64)


def split_words(text: pa.Array) -> Words:
    """Words are maximal runs of letters and digits, lower-cased; everything else separates them."""
    text = large(text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text)
    flat = pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(text), NOT_WORD, " "), " ")
    parts = pc.split_pattern(flat, " ")
    lengths = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    lengths[pc.equal(flat, "").to_numpy(zero_copy_only=False)] = 0
    values = parts.flatten()
    keep = pc.not_equal(values, "")
    encoded = values.filter(keep).dictionary_encode()
    return Words(np.concatenate([[0], np.cumsum(lengths)]), encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary.to_pylist())


@dataclass
class Shingles:
    """Hashes of ``SHINGLE_WORDS`` words in a row: ``value[begin[i]:begin[i+1]]`` for text i, in text order."""

    begin: np.ndarray
    value: np.ndarray


def shingles(words: Words, width: int = SHINGLE_WORDS) -> Shingles:
    """A text of fewer words has one shingle, all its words; a text without words has none."""
    n = np.diff(words.begin)
    h = words.hashes()
    count = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(count)])
    at = ragged(words.begin[:-1], count)
    have = np.repeat(np.minimum(n, width), count)
    acc = np.zeros(len(at), np.uint64)
    for k in range(width):
        use = have > k
        nxt = acc * MIX + h[np.minimum(at + k, max(len(h) - 1, 0))] if len(h) else acc
        acc = np.where(use, nxt, acc)
    acc = mixed(acc + have.astype(np.uint64))
    return Shingles(begin, acc)


def documents_like(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """``changed`` with the columns of ``docs``, in their order."""
    return changed.select(*docs.columns)
