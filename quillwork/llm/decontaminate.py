"""Benchmark decontamination by size-partitioned MinHash containment search.

An item's shingles are its distinct runs of five words.  A document that holds at least ``threshold`` of the n
shingles of an item must hold one of any n - ceil(threshold n) + 1 of them.  So items are partitioned by size (powers of
two), and the bottom-k MinHash sketch of an item, with k for the largest size of its partition, is looked up among the
shingles of every document, however long: the search misses nothing.  What it finds is verified by exact containment of
the shingles, as words and not as hashes.

Items are taken in blocks of at most ``BLOCK_SHINGLES`` shingles; only a block is ever broadcast, and more items mean
more passes.  Documents are read where they lie, with no shuffle.

Defined cases: null text is empty text; an item without words is found nowhere; an item of fewer than five words has
one shingle, all its words, and is found where these stand in a row; repeated rows of either table give repeated
results; a null item id or doc id is carried as it is; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwork.llm import common

THRESHOLD, BLOCK_SHINGLES = 0.8, 1_000_000
WIDTH = common.SHINGLE_WORDS


def least_shared(n: int, threshold: float) -> int:
    return max(1, math.ceil(threshold * n - 1e-9))


@dataclass
class Items:
    """A block of items and the sorted sketch values with the items that have each."""

    key: list
    words: list[list[str]]
    shingle: list[np.ndarray]
    value: np.ndarray
    begin: np.ndarray
    item: np.ndarray
    widths: list[int]

    def find(self, text: pa.Array, threshold: float) -> list[tuple[int, int, int, int]]:
        """(text, item, shingles of the item, shingles of the item in the text), verified."""
        words = common.split_words(text)
        pairs = set()
        own: dict[int, common.Shingles] = {w: common.shingles(words, w) for w in self.widths}
        for s in own.values():
            at = np.minimum(np.searchsorted(self.value, s.value), len(self.value) - 1)
            hit = np.flatnonzero(self.value[at] == s.value)
            doc = np.searchsorted(s.begin, hit, side="right") - 1
            for d, v in set(zip(doc.tolist(), at[hit].tolist())):
                pairs.update((d, i) for i in self.item[self.begin[v] : self.begin[v + 1]].tolist())
        out, held, grams = [], -1, {}
        for d, i in sorted(pairs):
            if d != held:
                held, grams, unique = d, {}, {}
            w = min(WIDTH, len(self.words[i]))
            if w not in unique:
                unique[w] = np.unique(own[w].value[own[w].begin[d] : own[w].begin[d + 1]])
            need = least_shared(len(self.shingle[i]), threshold)
            if np.isin(self.shingle[i], unique[w], assume_unique=True).sum() < need:
                continue
            if w not in grams:
                text_words = [words.vocabulary[c] for c in words.code[words.begin[d] : words.begin[d + 1]]]
                grams[w] = set(zip(*(text_words[k:] for k in range(w))))
            mine = set(zip(*(self.words[i][k:] for k in range(w))))
            shared = len(mine & grams[w])
            if shared >= need:
                out.append((d, i, len(mine), shared))
        return out


def _block(key: list, text: list[str], threshold: float) -> Items | None:
    words = common.split_words(pa.array(text, pa.string()))
    s = common.shingles(words)
    own = [[words.vocabulary[c] for c in words.code[a:b]] for a, b in zip(words.begin, words.begin[1:])]
    distinct = [np.unique(s.value[a:b]) for a, b in zip(s.begin, s.begin[1:])]
    largest: dict[int, int] = defaultdict(int)
    for x in distinct:
        largest[len(x).bit_length()] = max(largest[len(x).bit_length()], len(x))
    value, item = [], []
    for i, x in enumerate(distinct):
        if len(x):
            n = largest[len(x).bit_length()]
            sketch = x[np.argsort(common.mixed(x))[: n - least_shared(n, threshold) + 1]]
            value.append(sketch)
            item.append(np.full(len(sketch), i))
    if not value:
        return None
    value, item = np.concatenate(value), np.concatenate(item)
    order = np.argsort(value, kind="stable")
    distinct_value, begin = np.unique(value[order], return_index=True)
    return Items(key, own, distinct, distinct_value, np.append(begin, len(value)), item[order], sorted({min(WIDTH, len(w)) for w in own if w}))


def item_blocks(items: DataFrame, threshold: float, key: str = "item_id", text: str = "text", limit: int = BLOCK_SHINGLES) -> Iterator[Items]:
    """The items, a bounded block at a time."""
    keys, texts, size = [], [], 0
    for row in common.plain_text(items, key, text).toLocalIterator():
        n = 1 + row["text"].count(" ")
        if keys and size + n > limit:
            if block := _block(keys, texts, threshold):
                yield block
            keys, texts, size = [], [], 0
        keys.append(row["key"]), texts.append(row["text"])
        size += n
    if keys and (block := _block(keys, texts, threshold)):
        yield block


def search(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, limit: int = BLOCK_SHINGLES) -> DataFrame:
    """``doc_id, item_id, n_shingles, n_shared, containment`` of every document and item with at least ``threshold``."""
    spark, rows = docs.sparkSession, common.plain_text(docs, "doc_id", "text")
    kind, item_kind = rows.schema["key"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, n_shingles long, n_shared long, containment double"
    out = spark.createDataFrame([], schema)
    for block in item_blocks(items, threshold, limit=limit):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = sent.value
            arrow = pa.schema(batch_schema)
            for b in common.blocks(batches):
                found = own.find(b.column("text"), threshold)
                if found:
                    d, i, n, shared = zip(*found)
                    part = [s / k for s, k in zip(shared, n)]
                    yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(d)), pa.array([own.key[x] for x in i], arrow.field(1).type), pa.array(n, pa.int64()), pa.array(shared, pa.int64()), pa.array(part, pa.float64())], schema=arrow)

        from pyspark.sql.pandas.types import to_arrow_schema

        batch_schema = to_arrow_schema(out.schema)
        out = out.unionByName(rows.mapInArrow(run, schema))
    return out


def keep_clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """``docs`` without the documents that hold an item."""
    names = docs.columns
    t = names.index(text)
    rows = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)))
    for block in item_blocks(items, threshold):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in common.blocks(batches, f"c{t}"):
                keep = np.ones(b.num_rows, bool)
                keep[[d for d, *_ in sent.value.find(b.column(t).fill_null(""), threshold)]] = False
                yield b.filter(pa.array(keep))

        rows = rows.mapInArrow(run, rows.schema)
    return rows.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)))
