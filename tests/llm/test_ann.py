"""Nearest neighbours against brute force."""

import numpy as np
import pytest
from helpers import DATA
from pyspark.sql import functions as F

from quillwork.llm import ann, common, queries


def brute(rows, k=5):
    """{query row: [(id, cosine)]} over (id, vector) with the defined order."""
    ok = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i in ok:
        if rows[i][0] is None or rows[i][0] % 50:
            continue
        q = np.array(rows[i][1], float)
        near = []
        for j in ok:
            if j != i:
                x = np.array(rows[j][1], float)
                near.append((-float((x * q).sum() / (np.sqrt((x * x).sum()) * np.sqrt((q * q).sum()))), rows[j][0] is None, rows[j][0] or 0, j))
        out[i] = [(rows[j][0], -s) for s, _, _, j in sorted(near)[:k]]
    return out


def test_small_table_is_exact(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in common.table(spark, DATA, "embeddings").collect()]
    got = {}
    for r in queries.op7_nearest(spark, DATA).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    for i, near in brute(rows).items():
        assert [a for a, _ in got[rows[i][0]]] == [a for a, _ in near]
        assert [s for _, s in got[rows[i][0]]] == pytest.approx([s for _, s in near], abs=1e-14)


def test_odd_vectors(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(0, v), (1, v), (2, v), (3, [2.0, 4.0, 6.5]), (4, None), (5, []), (6, [0.0, 0.0, 0.0]), (7, [1.0, None, 1.0]), (8, [float("nan"), 1.0, 1.0]), (9, [float("inf"), 1.0, 1.0]), (50, v), (50, v), (100, None), (None, v), (None, [3.0, 1.0, 0.0]), (150, [1e-160, 0.0, 0.0])]
    rows += [(1000 + i, v) for i in range(1, 20)]
    df = spark.createDataFrame([(k, x, 1, "p") for k, x in rows], "vec_id long, embedding array<double>, row int, part string").coalesce(1)
    got = {}
    for r in ann.search(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    near = brute([(k, x) for k, x in rows if k != 150])
    assert got[0] == [(i + 1, a) for i, (a, _) in enumerate(near[0])]
    assert sorted(got[50]) == sorted((i + 1, a) for q in (10, 11) for i, (a, _) in enumerate(near[q]))
    assert 100 not in got and None not in got
    assert ann.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert ann.search(df.filter("vec_id = 6"), F.lit(True)).count() == 0


def test_recall_of_the_parts(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 16))
    x = centres[rng.integers(0, 40, 4000)] + 0.4 * rng.normal(size=(4000, 16))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, F.col("vec_id") % 50 == 0, part_rows=250).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = brute(rows)
    assert np.mean([len(got[i] & {a for a, _ in near}) / 5 for i, near in want.items()]) >= 0.9


def test_parts_are_balanced_and_learned():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(16, 8))
    x = ann._unit(centres[rng.integers(0, 16, 2000)] + 0.1 * rng.normal(size=(2000, 8)))
    label = ann.balanced_parts(x, ann._neighbours(x, 10), 3)
    assert np.ptp(np.bincount(label)) <= 1
    router = ann.learn(x, 8000, 1000)
    assert router.parts == 8 and router.probes < 4
