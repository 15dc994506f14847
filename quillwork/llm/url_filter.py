"""URL verdicts by a blocked Bloom filter and an exact hash join.

Rules and listed addresses are canonical prefixes, ``host`` + ``path``.  An address has as possible prefixes every
suffix of its host (at dots) with every beginning of its path that is as long as some entry's path.  Those are probed in
a blocked Bloom filter (one block of 512 bits for an entry, eight bits set in it); only what may be listed goes on to a
hash join with the entries themselves, which removes false positives.  The longest rule wins; where no rule fits, a
listed address is blocked and any other is allowed.

The filter holds at most ``FILTER_BYTES``; a longer list only makes more false positives, never other verdicts.  The
entries are broadcast up to ``BROADCAST_ROWS`` rows and joined by a shuffle beyond.

Defined cases: a null address, or one without ``://``, has an empty host and path and fits nothing; repeated rows each
have their verdict; an empty table gives no rows; an empty path fits only an entry with an empty path; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.llm import common

BITS_AN_ENTRY, BLOCK_BITS, PROBES = 16, 512, 8
FILTER_BYTES, BROADCAST_ROWS = 64 << 20, 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.substr(url, F.instr(url, "://") + F.lit(3))
    return F.when(F.instr(url, "://") > 0, F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substr(url, F.instr(url, "://") + F.lit(3))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


class BlockedBloom:
    """Eight bits in one 512-bit block for each key."""

    def __init__(self, entries: int, limit: int = FILTER_BYTES) -> None:
        blocks = min(max(1, -(-entries * BITS_AN_ENTRY // BLOCK_BITS)), limit * 8 // BLOCK_BITS)
        self.words = np.zeros((blocks, BLOCK_BITS // 64), np.uint64)

    def _places(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))
        block = ((h >> np.uint64(32)) % np.uint64(len(self.words))).astype(np.int64)
        g = common.mixed(h)
        bit = np.stack([(g >> np.uint64(7 * i)) & np.uint64(BLOCK_BITS - 1) for i in range(PROBES)], 1)
        return block, (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63))

    def add(self, keys: list[str]) -> None:
        block, word, mask = self._places(keys)
        np.bitwise_or.at(self.words, (block[:, None], word), mask)

    def may_hold(self, keys: list[str]) -> np.ndarray:
        if not keys:
            return np.zeros(0, bool)
        block, word, mask = self._places(keys)
        return ((self.words[block[:, None], word] & mask) == mask).all(1)


def prefixes(host: str, path: str, lengths: list[int]) -> list[str]:
    if not host:
        return []
    parts = host.split(".")
    heads = [path[:n] for n in lengths if n <= len(path)]
    return [".".join(parts[i:]) + h for i in range(len(parts)) for h in heads]


def entries(spark: SparkSession, rules: list[tuple[str, str, str]], listed: DataFrame | None) -> DataFrame:
    """``entry, host, path, verdict, by_rule``; of rules and listed addresses with the same prefix the rule stays."""
    own = spark.createDataFrame([(h + p, h, p, v, True) for v, h, p in rules], "entry string, host string, path string, verdict string, by_rule boolean")
    if listed is None:
        return own
    more = listed.select(F.concat("host", "path").alias("entry"), "host", "path", F.lit("block").alias("verdict"), F.lit(False).alias("by_rule")).distinct()
    return own.unionByName(more.join(own.select("entry"), "entry", "left_anti").select(*own.columns))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], listed: DataFrame | None = None, key: str = "page_id", url: str = "url") -> DataFrame:
    """``key, host, path, rule, verdict, listed`` of every row.  ``rules``: (allow or block, host, path), ``listed``: host, path."""
    spark = pages.sparkSession
    known = entries(spark, rules, listed)
    size = known.agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set(F.length("path"))).alias("lengths")).first()
    bloom = BlockedBloom(size["n"])
    held: list[str] = []
    for row in known.select("entry").toLocalIterator():
        held.append(row["entry"])
        if len(held) == 100_000:
            bloom.add(held)
            held = []
    if held:
        bloom.add(held)
    sent, lengths = spark.sparkContext.broadcast(bloom), list(size["lengths"])
    at = F.col(url).cast("string")
    rows = pages.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("row"), F.coalesce(host_of(at), F.lit("")).alias("host"), F.coalesce(path_of(at), F.lit("")).alias("path"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [prefixes(h, p, lengths) for h, p in zip(b.column("host").to_pylist(), b.column("path").to_pylist())]
            flat = [x for o in own for x in o]
            may = iter(sent.value.may_hold(flat).tolist())
            hits = [[x for x in o if next(may)] for o in own]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hits, pa.list_(pa.string()))], [*b.schema.names, "hits"])

    probed = rows.mapInArrow(run, f"key {kind}, row long, host string, path string, hits array<string>")
    entry = known.select("entry", "verdict", "by_rule")
    if size["n"] <= BROADCAST_ROWS:
        entry = F.broadcast(entry)
    joined = probed.withColumn("entry", F.explode_outer("hits")).join(entry, "entry", "left")
    rank = F.struct(F.length("entry").alias("n"), F.col("entry"), F.col("verdict"))
    best = joined.groupBy("row").agg(
        F.first("key").alias("key"), F.first("host").alias("host"), F.first("path").alias("path"), F.max(F.when(F.col("by_rule"), rank)).alias("best"), F.coalesce(F.max(~F.col("by_rule")), F.lit(False)).alias("listed")
    )
    verdict = F.when(F.col("best").isNotNull(), F.col("best.verdict")).when(F.col("listed"), F.lit("block")).otherwise("allow")
    return best.select(F.col("key").alias(key), "host", "path", F.col("best.entry").alias("rule"), verdict.alias("verdict"), "listed")
