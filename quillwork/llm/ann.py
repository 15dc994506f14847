"""Approximate nearest neighbours by learned partitions.

On a bounded sample (``SAMPLE`` vectors, those with the least hash) the nearest-neighbour graph is cut into balanced
parts by recursive bisection with pair swaps.  A small network then learns to tell the parts of a vector's neighbours;
every row of the table is put into its most probable part, and each query is sent to the most probable ones.  How many
is set on sample vectors that were kept out of training.  What is found there is ranked by exact cosine.

Rows with equal vectors are told apart by id alone, so of these only the ``k`` + 1 with the smallest ids can be in an
answer; the others are left out before anything is dealt.  Parts are split into blocks of ``BLOCK_ROWS`` rows; a block
is held in memory while the queries of its part stream past.

Defined cases: vectors that are null, empty, zero, of another length than most of the sample, or that hold null or
non-finite components take no part, neither as queries nor as candidates; of equal scores the smaller id comes first
(nulls last); repeated rows are candidates of each other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillwork.llm import common

#: Documented bound of the sample; rows of a part to aim at; most parts.
SAMPLE, PART_ROWS, MOST_PARTS = 8192, 1000, 256
BLOCK_ROWS, GRAPH, HIDDEN = 4096, 10, 128
#: Share of their neighbours that kept-out sample vectors must find in the parts they are sent to.
AIM = 0.96


def _neighbours(x: np.ndarray, k: int, among: np.ndarray | None = None) -> np.ndarray:
    base = x if among is None else among
    out = []
    for i in range(0, len(x), 1024):
        s = x[i : i + 1024] @ base.T
        if among is None:
            s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        out.append(np.argpartition(-s, k - 1, axis=1)[:, :k])
    return np.concatenate(out)


def _bisect(x: np.ndarray, graph: np.ndarray, nodes: np.ndarray, passes: int = 12) -> np.ndarray:
    """Two halves of equal size: cut at the median of the main direction, then swaps that cut fewer edges."""
    part = x[nodes] - x[nodes].mean(0)
    v = part[np.argmax((part * part).sum(1))]
    for _ in range(20):
        v = part.T @ (part @ v)
        v /= np.linalg.norm(v) + 1e-30
    side = np.zeros(len(nodes), bool)
    side[np.argsort(part @ v, kind="stable")[len(nodes) // 2 :]] = True
    local = np.full(len(x), -1)
    local[nodes] = np.arange(len(nodes))
    to = local[graph[nodes]].ravel()
    ok = to >= 0
    a, b = np.repeat(np.arange(len(nodes)), graph.shape[1])[ok], to[ok]
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    for _ in range(passes):
        gain = np.bincount(a, np.where(side[a] != side[b], 1, -1), minlength=len(nodes))
        low, high = np.flatnonzero(~side), np.flatnonzero(side)
        low, high = low[np.argsort(-gain[low], kind="stable")], high[np.argsort(-gain[high], kind="stable")]
        n = min(len(low), len(high))
        good = int((gain[low[:n]] + gain[high[:n]] > 0).sum())
        if not good:
            break
        good = max(1, good // 2)
        side[low[:good]], side[high[:good]] = True, False
    return side


def balanced_parts(x: np.ndarray, graph: np.ndarray, depth: int) -> np.ndarray:
    label, groups = np.zeros(len(x), np.int64), [np.arange(len(x))]
    for _ in range(depth):
        nxt = []
        for g in groups:
            side = _bisect(x, graph, g)
            nxt += [g[~side], g[side]]
        groups = nxt
    for i, g in enumerate(groups):
        label[g] = i
    return label


@dataclass
class Router:
    """The network (one hidden layer) that tells the most probable parts of unit vectors."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    parts: int
    probes: int = 1

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def part(self, x: np.ndarray) -> np.ndarray:
        return self.logits(x).argmax(1) if self.parts > 1 else np.zeros(len(x), np.int64)


def _train(x: np.ndarray, target: np.ndarray, epochs: int = 30, seed: int = 5) -> Router:
    rng = np.random.default_rng(seed)
    d, parts = x.shape[1], target.shape[1]
    w = [rng.normal(0, np.sqrt(2 / d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, parts)), np.zeros(parts)]
    m, s, step = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
    for epoch in range(epochs):
        rate = 0.004 * (1 - epoch / epochs) + 1e-4
        for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
            a, y = x[rows], target[rows]
            pre = a @ w[0] + w[1]
            h = np.maximum(pre, 0)
            z = h @ w[2] + w[3]
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = (p - y) / len(rows)
            back = (g @ w[2].T) * (pre > 0)
            step += 1
            for i, d_i in enumerate((a.T @ back, back.sum(0), h.T @ g, g.sum(0))):
                m[i] += 0.1 * (d_i - m[i])
                s[i] += 0.001 * (d_i * d_i - s[i])
                w[i] -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(s[i] / (1 - 0.999**step)) + 1e-8)
    return Router(*w, parts)


def learn(sample: np.ndarray, rows: int, part_rows: int = PART_ROWS) -> Router:
    """The router of a table with ``rows`` rows, from unit vectors."""
    depth = 0
    while (2 << depth) * part_rows <= rows and (2 << depth) <= MOST_PARTS and len(sample) // (2 << depth) >= 16:
        depth += 1
    d = sample.shape[1]
    if not depth:
        return Router(np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    kept_out = len(sample) // 8
    probe, x = sample[:kept_out], sample[kept_out:]
    graph = _neighbours(x, GRAPH)
    label = balanced_parts(x, graph, depth)
    target = np.zeros((len(x), 1 << depth))
    np.add.at(target, (np.repeat(np.arange(len(x)), GRAPH), label[graph].ravel()), 0.5 / GRAPH)
    target[np.arange(len(x)), label] += 0.5
    router = _train(x, target)
    own = router.part(x)[_neighbours(probe, GRAPH // 2, x)]
    order = np.argsort(-router.logits(probe), axis=1, kind="stable")
    place = np.argsort(order, axis=1)
    need = np.take_along_axis(place, own, axis=1)
    router.probes = next(m for m in range(1, router.parts + 1) if (need < m).mean() >= AIM or m == router.parts)
    return router


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda v: v != 0)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(1, keepdims=True)
    x = x / scale
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cosine(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosine of ``q`` with each row of ``x`` in double precision; a row's value doesn't depend on its neighbours."""
    return (x * q).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((q * q).sum()))


def search(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", part_rows: int = PART_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of every query row among all other rows."""
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType.simpleString()
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(key).alias("key"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).withColumn("row", F.monotonically_increasing_id()).filter(usable(F.col("v"))).withColumn("h", F.xxhash64("v"))
    sample = rows.select("h", "v").orderBy("h").limit(SAMPLE).collect()
    schema = f"query_id {kind}, rank int, vec_id {kind}, score double"
    if not sample:
        return spark.createDataFrame([], schema)
    lengths = [len(r["v"]) for r in sample]
    dim = max(set(lengths), key=lambda n: (lengths.count(n), n))
    rows = rows.filter(F.size("v") == dim)
    x = np.unique(_unit(np.array([r["v"] for r in sample if len(r["v"]) == dim])), axis=0)
    x = x[np.random.default_rng(3).permutation(len(x))]
    router = learn(x, rows.count(), part_rows)
    sent = spark.sparkContext.broadcast(router)
    # Of equal vectors only the k + 1 smallest ids are candidates; the window's limit is taken before the shuffle.
    copy = F.row_number().over(Window.partitionBy("h", "v").orderBy(F.col("key").asc_nulls_last(), "row"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = sent.value.part(_unit(_matrix(b.column("v"), dim)))
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), b.column("key"), b.column("row"), b.column("v")], ["part", "key", "row", "v"])

    base = rows.withColumn("copy", copy).filter(F.col("copy") <= k + 1).select("key", "row", "v").mapInArrow(place, f"part int, key {kind}, row long, v array<double>")
    base = common.stored(base, "ann-parts")
    count = np.zeros(router.parts, np.int64)
    for r in base.groupBy("part").count().collect():  # at most MOST_PARTS rows
        count[r["part"]] = r["count"]
    blocks = np.maximum(1, -(-count // BLOCK_ROWS))
    need = spark.sparkContext.broadcast((count, blocks))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, cut = need.value
        for b in batches:
            if not b.num_rows:
                continue
            order = np.argsort(-sent.value.logits(_unit(_matrix(b.column("v"), dim))), axis=1, kind="stable") if sent.value.parts > 1 else np.zeros((b.num_rows, 1), np.int64)
            enough = np.cumsum(size[order], axis=1) >= k + 1
            upto = np.maximum(sent.value.probes, np.where(enough.any(1), enough.argmax(1) + 1, order.shape[1]))
            who = [(i, int(p), c) for i in range(b.num_rows) for p in order[i, : upto[i]] for c in range(cut[p])]
            i, p, c = zip(*who)
            at = pa.array(i, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(c, pa.int32()), b.column("key").take(at), b.column("row").take(at), b.column("v").take(at)], ["part", "block", "key", "row", "v"])

    asked = rows.filter("asks").select("key", "row", "v").mapInArrow(route, f"part int, block int, key {kind}, row long, v array<double>")
    cut = F.element_at(F.array(*(F.lit(int(c)) for c in blocks)), F.col("part") + 1)
    held = base.withColumn("block", F.pmod(F.xxhash64("row"), cut).cast("int"))
    both = held.select("part", "block", F.lit(0).alias("kind"), "key", "row", "v").unionByName(asked.select("part", "block", F.lit(1).alias("kind"), "key", "row", "v"))
    both = both.repartition("part", "block").sortWithinPartitions("part", "block", "kind")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, base_key, base_row, base_v, norm = None, None, None, None, None
        for b in batches:
            part, block, side = (b.column(c).to_numpy() for c in ("part", "block", "kind"))
            edge = np.flatnonzero((part[1:] != part[:-1]) | (block[1:] != block[:-1]) | (side[1:] != side[:-1])) + 1
            for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), b.num_rows]):
                if lo == hi:
                    continue
                x, group = _matrix(b.column("v").slice(lo, hi - lo), dim), (part[lo], block[lo])
                keys, own = b.column("key").slice(lo, hi - lo), b.column("row").slice(lo, hi - lo).to_numpy()
                if side[lo] == 0:
                    if group == at:
                        base_key, base_row, base_v = pa.concat_arrays([base_key, keys]), np.concatenate([base_row, own]), np.concatenate([base_v, x])
                    else:
                        at, base_key, base_row, base_v = group, keys, own, x
                    norm = None
                    continue
                if group != at:
                    continue
                norm = _unit(base_v) if norm is None else norm
                for j in range(0, len(x), 512):
                    s = _unit(x[j : j + 512]) @ norm.T
                    s[own[j : j + 512][:, None] == base_row[None, :]] = -np.inf
                    least = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -2.0)
                    q, c = np.nonzero((s >= least[:, None] - 1e-9) & (s > -np.inf))
                    if len(q):
                        score = np.concatenate([cosine(x[j + i], base_v[c[q == i]]) for i in np.unique(q)])
                        yield pa.RecordBatch.from_arrays([keys.take(pa.array(j + q)), pa.array(own[j + q]), base_key.take(pa.array(c)), pa.array(base_row[c]), pa.array(score)], ["query_id", "query_row", "vec_id", "row", "score"])

    found = both.mapInArrow(compare, f"query_id {kind}, query_row long, vec_id {kind}, row long, score double")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
