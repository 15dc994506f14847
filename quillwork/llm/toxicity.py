"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the hashes of its distinct words, pairs of neighbouring words and pairs with one word skipped.
Training reads a bounded sample of labelled rows (``per_class`` rows of either label, those with the smallest hash of
their key), keeps features that at least ``least_docs`` of them hold, and runs FTRL-proximal with per-coordinate rates;
its L1 term leaves few weights, which are broadcast.  Scoring reads every whole text once, with no shuffle.

Defined cases: null text scores as empty text, empty text by the bias alone; a label that is null, or whose document is
missing, is not used; repeated labels of a key count as often as they come; with no labels of one kind every score is
the share of ones (0.5 with no labels); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwork.llm import common

#: Documented bound of the training sample: rows of either label.
PER_CLASS = 3000
LEAST_DOCS, BITS = 3, 24
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 20.0, 0.1, 15


def features(text: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features of each text, one text after another, and where each text's begin."""
    words = common.split_words(text)
    h, begin = words.hashes(), words.begin
    n, owner = len(words.code), np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    own, made = [owner], [common.mixed(h)]
    for gap in (1, 2):
        if n > gap:
            same = owner[:-gap] == owner[gap:]
            own.append(owner[:-gap][same])
            made.append(common.mixed(h[:-gap][same] * common.MIX + h[gap:][same] + np.uint64(gap)))
    key = np.unique(np.concatenate(own).astype(np.uint64) << np.uint64(bits) | np.concatenate(made) >> np.uint64(64 - bits))
    return (key & np.uint64((1 << bits) - 1)).astype(np.int64), np.searchsorted(key, np.arange(len(begin)).astype(np.uint64) << np.uint64(bits))


@dataclass
class Model:
    """Non-zero weights by sorted feature, and the bias."""

    feature: np.ndarray
    weight: np.ndarray
    bias: float

    def scores(self, found: np.ndarray, begin: np.ndarray) -> np.ndarray:
        if len(self.feature):
            at = np.minimum(np.searchsorted(self.feature, found), len(self.feature) - 1)
            w = np.where(self.feature[at] == found, self.weight[at], 0.0)
        else:
            w = np.zeros(len(found))
        total = np.concatenate([[0.0], np.cumsum(w)])
        return 1 / (1 + np.exp(-np.clip(total[begin[1:]] - total[begin[:-1]] + self.bias, -35, 35)))


def fit(rows: list[np.ndarray], label: np.ndarray, least_docs: int = LEAST_DOCS, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """FTRL-proximal over the rows' features, in a seeded order each epoch."""
    if not len(rows) or label.min() == label.max():
        share = np.clip(label.mean() if len(label) else 0.5, 1e-6, 1 - 1e-6)
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(share / (1 - share))))
    known, count = np.unique(np.concatenate(rows), return_counts=True)
    known = known[count >= least_docs]
    at = []
    for r in rows:
        i = np.searchsorted(known, r)
        ok = i < len(known)
        ok[ok] = known[i[ok]] == r[ok]
        at.append(np.append(i[ok], len(known)).astype(np.int32))  # the last coordinate is the bias
    z, n = np.zeros(len(known) + 1), np.zeros(len(known) + 1)
    l1 = np.full(len(z), L1)
    l1[-1] = 0.0

    def weights(i):
        return np.where(np.abs(z[i]) <= l1[i], 0.0, -(z[i] - np.sign(z[i]) * l1[i]) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(at)):
            i = at[k]
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label[k]
            grown = n[i] + g * g
            z[i] += g - (np.sqrt(grown) - np.sqrt(n[i])) / ALPHA * w
            n[i] = grown
    w = weights(np.arange(len(z)))
    held = np.flatnonzero(w[:-1])
    return Model(known[held].astype(np.int64), w[:-1][held], float(w[-1]))


def held_out(key: Column) -> Column:
    """Whether crc32 of the key as text is divisible by 5 (a null key is not held out)."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """The model of a bounded sample of the labelled rows that are not held out."""
    marked = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & F.col("key").isNotNull() & ~held_out(F.col("key")))
    order = [F.xxhash64("key"), F.col("key")]
    sample = None
    for kind in (0, 1):
        some = marked.filter(F.col("label") == kind).orderBy(*order).limit(per_class)
        sample = some if sample is None else sample.unionByName(some)
    rows = common.plain_text(docs, key, text).join(F.broadcast(sample), "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.blocks(batches):
            found, begin = features(b.column("text"))
            flat = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(found.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column("key").cast(pa.string()), b.column("label"), flat], ["key", "label", "features"])

    got = rows.mapInArrow(run, "key string, label int, features array<int>").toArrow().combine_chunks()
    got = got.sort_by([("key", "ascending"), ("label", "ascending")])
    flat = [np.asarray(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else np.zeros(0, np.int32) for x in got.column("features")]
    return fit(flat, got.column("label").to_numpy().astype(float))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, score`` of every whole text."""
    sent, rows = docs.sparkSession.sparkContext.broadcast(model), common.plain_text(docs, key, text)
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.blocks(batches):
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(sent.value.scores(*features(b.column("text"))))], ["key", "score"])

    return rows.mapInArrow(run, f"key {kind}, score double").withColumnRenamed("key", key)


def keep_below(docs: DataFrame, model: Model, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """``docs`` without the documents that score ``threshold`` or more."""
    sent, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns
    t = names.index(text)
    rows = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.blocks(batches, f"c{t}"):
            yield b.filter(pa.array(sent.value.scores(*features(b.column(t).fill_null(""))) < threshold))

    return rows.mapInArrow(run, rows.schema).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)))


def judge(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    out = score(docs, train(docs, labels, per_class))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
