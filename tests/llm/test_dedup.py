"""Near-duplicates and repeated byte strings against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import DATA
from pyspark.sql import DataFrame

from quillwork.llm import common, components, near_dup, queries, suffix_dedup


def shingles(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def similarity(a, b):
    both = sum((a & b).values())
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


def brute_classes(rows):
    """Class (least id) of each row by all pairs."""
    s = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = (rows[i][1] or "") == (rows[j][1] or "")
            if same or (s[i] and similarity(s[i], s[j]) >= 0.8):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    members = {}
    for i in range(len(rows)):
        members.setdefault(root(i), []).append(rows[i][0])
    return [min(members[root(i)], key=lambda k: (k is None, k or 0)) for i in range(len(rows))]


def test_classes_of_all_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = {r["doc_id"]: r["class_id"] for r in queries.op5_near_dup(spark, DATA).collect()}
    assert got == {k: c for (k, _), c in zip(rows, brute_classes(rows))}


def test_odd_rows(spark, odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    got = sorted((str(r["doc_id"]), str(r["class_id"])) for r in near_dup.classes(odd).collect())
    assert got == sorted((str(k), str(c)) for (k, _), c in zip(rows, brute_classes(rows)))
    kept = near_dup.keep_one(odd)
    assert kept.columns == odd.columns
    assert kept.count() == len({(c, k is None and c is None) for (k, _), c in zip(rows, brute_classes(rows))})
    assert near_dup.classes(empty).count() == 0 and near_dup.keep_one(empty).count() == 0


def test_a_large_group_of_near_copies(spark, tmp_path):
    """Chains and large buckets: every text differs from a base in a few words."""
    rng = random.Random(2)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for k in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(200)] = f"x{k}"
        rows.append((k, " ".join(words)))
    rows += [(200 + k, " ".join(base[:80] + [f"y{k}_{i}" for i in range(80)])) for k in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    got = {r["doc_id"]: r["class_id"] for r in near_dup.classes(spark.read.parquet(str(tmp_path / "d"))).collect()}
    assert got == {k: c for (k, _), c in zip(rows, brute_classes(rows))}


@pytest.mark.parametrize("seed", range(3))
def test_links_of_one_bucket_are_complete(spark, seed):
    """Families with edits of all kinds, repeated words and chains in a single bucket: the components are those of all pairs."""
    rng = random.Random(seed)
    bases = [[f"w{rng.randint(0, 60)}" for _ in range(rng.choice([40, 90, 120]))] for _ in range(2)]
    bases.append(bases[0][:60] + [f"t{i}" for i in range(12)] + bases[0][60:])
    texts = []
    for k in range(140):
        words = list(rng.choice(bases)) if k % 3 or not texts else texts[rng.randrange(len(texts))].split()
        for _ in range(rng.choice([0, 1, 2, 2, 3, 5, 8])):
            at = rng.randrange(len(words))
            words[at : at + rng.choice([0, 1, 1, 2])] = [rng.choice([f"x{k}", f"y{rng.randint(0, 3)}", "w1"]) for _ in range(rng.choice([0, 1, 1, 2]))]
        texts.append(" ".join(words))
    texts = list(dict.fromkeys(texts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    place = {r["text"]: r["row"] for r in common.plain_text(docs, "doc_id", "text").selectExpr("text", "monotonically_increasing_id() AS row").collect()}
    sketches = spark.createDataFrame([(i, place[t], hashlib.md5(t.encode()).digest(), sum(shingles(t).values()), [1]) for i, t in enumerate(texts)], "key long, row long, content binary, n long, bands array<long>")
    root = {r["node"]: r["root"] for r in components.components(near_dup.links_of(sketches, docs)[1]).collect()}
    got = [root.get(place[t], place[t]) for t in texts]
    want = brute_classes(list(enumerate(texts)))
    assert len(set(want)) > 5 and max(Counter(want).values()) > 5
    assert {frozenset(i for i, c in enumerate(got) if c == k) for k in set(got)} == {frozenset(i for i, c in enumerate(want) if c == k) for k in set(want)}


def test_an_odd_pivot_makes_no_pairs_of_all(spark, monkeypatch):
    """All texts of a bucket have in common what its pivot lacks: they are not compared with each other for that."""
    rng = random.Random(5)
    base, texts = [f"w{i}" for i in range(400)], []
    for k in range(160):
        words = list(base)
        for at in rng.sample(range(400), 6 if k == 159 else 11):
            words[at] = f"x{k}_{at}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    sketches = spark.createDataFrame([(i, i, hashlib.md5(t.encode()).digest(), 396, [1]) for i, t in enumerate(texts)], "key long, row long, content binary, n long, bands array<long>")
    met, stored = [], common.stored

    def watched(df, name):
        out = stored(df, name)
        if name == "live-posts":
            met.append(out.groupBy("g").count().selectExpr("sum(count * count)").first()[0] or 0)
        return out

    monkeypatch.setattr(common, "stored", watched)
    links = {(r["a"], r["b"]) for r in near_dup.links_of(sketches, docs)[1].collect()}
    s = [shingles(t) for t in texts]
    assert links <= {(i, j) for i in range(160) for j in range(i + 1, 160) if similarity(s[i], s[j]) >= 0.8}
    assert len(met) == 1 and met[0] < 60_000


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(3)
    n, k = 60, 2000
    x = rng.integers(0, 5, n).astype(float)
    y = np.where(rng.random(n) < 0.7, x, rng.integers(0, 9, n)).astype(float)
    value = common.mixed(np.arange(1, n + 1, dtype=np.uint64))
    owner = np.repeat([0, 1], [(x > 0).sum(), (y > 0).sum()])
    s = near_dup.dart_minhash(owner, np.concatenate([value[x > 0], value[y > 0]]), np.concatenate([x[x > 0], y[y > 0]]), 2, k)
    assert (s != 0).all()
    assert abs((s[0] == s[1]).mean() - np.minimum(x, y).sum() / np.maximum(x, y).sum()) < 0.05


def test_exact_similarity():
    a = ["a b c d e f", "a b c d e f a b c d e f", "", "x y"]
    b = ["a b c d e g", "a b c d e f", "", "X, y!"]
    want = [similarity(shingles(p), shingles(q)) for p, q in zip(a, b)]
    assert near_dup.weighted_jaccard(pa.array(a), pa.array(b)).tolist() == pytest.approx(want)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (5, 5), (1, 0)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_bytes(texts, length):
    parts = [(t or "").encode() for t in texts]
    seen = Counter(p[i : i + length] for p in parts for i in range(len(p) - length + 1))
    for p in parts:
        gone = bytearray(len(p))
        for i in range(len(p) - length + 1):
            if seen[p[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(p, gone) if not g)
        yield len(p), sum(gone), sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("seed", range(40))
def test_repeated_windows_of_a_buffer(seed):
    rng = random.Random(seed)
    length, parts = rng.choice([3, 5, 8, 12, 40]), []
    for _ in range(rng.randint(1, 12)):
        p = bytes(rng.choice(b"ab\x00c") for _ in range(rng.randint(0, 60)))
        if parts and rng.random() < 0.6:
            q = rng.choice(parts)
            at = rng.randint(0, len(q))
            p = p[:10] + q[at : at + rng.randint(0, 60)] + p[10:]
        parts.append(b"ab" * rng.randint(0, 40) if rng.random() < 0.2 else p)
    seen = Counter(p[i : i + length] for p in parts for i in range(len(p) - length + 1))
    want = [[i for i in range(len(p) - length + 1) if seen[p[i : i + length]] > 1] for p in parts]
    assert [x.tolist() for x in suffix_dedup.repeated(parts, length)] == want


def test_equal_windows_name_equal_anchors():
    rng = np.random.default_rng(0)
    shared = rng.integers(0, 255, 900, np.uint8)
    a, b = np.concatenate([rng.integers(0, 255, 333, np.uint8), shared]), np.concatenate([rng.integers(0, 255, 50, np.uint8), shared, rng.integers(0, 255, 77, np.uint8)])
    cover = []
    for t in (a, b):
        _, first, last, anchor = suffix_dedup.segments(t, np.array([0, len(t)]))
        assert first[0] == 0 and last[-1] == len(t) - 400 and (first[1:] == last[:-1] + 1).all()
        cover.append({t[i : i + 400].tobytes(): h for f, z, h in zip(first, last, anchor) for i in range(f, z + 1)})
    both = cover[0].keys() & cover[1].keys()
    assert len(both) == 501 and all(cover[0][w] == cover[1][w] for w in both)


def test_repeated_bytes_of_all_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op10_repeated_bytes(spark, DATA).collect()}
    assert got == {k: v for (k, _), v in zip(rows, brute_bytes([t for _, t in rows], 400))}


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 0])
def test_odd_rows_by_either_way(spark, odd, empty, hot):
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    got = sorted(map(str, (tuple(r) for r in suffix_dedup.dedup(odd, hot=hot).collect())))
    assert got == sorted(str((k, *v)) for (k, _), v in zip(rows, brute_bytes([t for _, t in rows], 400)))
    assert suffix_dedup.dedup(empty).count() == 0


def test_pairs_that_share_one_large_bucket(spark):
    """Two near copies whose only band in common is that of a crowd of unlike texts, which has another leader."""
    rng = random.Random(5)
    texts = [" ".join(f"u{i}x{rng.randint(0, 999)}" for _ in range(60)) for i in range(40)]
    texts[21] = texts[20] + " end"
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    place = {r["text"]: r["row"] for r in common.plain_text(docs, "doc_id", "text").selectExpr("text", "monotonically_increasing_id() AS row").collect()}
    sketches = spark.createDataFrame([(i, place[t], hashlib.md5(t.encode()).digest(), len(t.split()) - 4, [1, *(1000 * (i + 1) + b for b in range(24))]) for i, t in enumerate(texts)], "key long, row long, content binary, n long, bands array<long>")
    links = near_dup.links_of(sketches, docs)[1]
    assert {(r["a"], r["b"]) for r in links.collect()} == {(place[texts[20]], place[texts[21]])}


@pytest.mark.parametrize("seed", range(2))
def test_a_post_is_in_two_cells_at_most(spark, seed):
    """Posts of families of all sizes, intervals turned round among them: the pairs are those of all pairs of a group."""
    rng, c, rows = random.Random(seed), 0.2 / 1.8, []
    for g in range(6):
        largest = rng.choice([3, 40, 200, 800])
        for node in range(60):
            n = largest - rng.randint(0, largest // 4)
            d = rng.randint(1, n)
            rows.append((1, 100 * g + node, rng.randint(0, 3), rng.random() < 0.2, n, d, g, rng.randint(0, min(d - 1, int(2.25 * c * n) + 1)), rng.random() < 0.5))
    most = {g: max(r[4] for r in rows if r[6] == g) for g in range(6)}
    live = spark.createDataFrame([(*r, most[r[6]]) for r in rows], "p long, node long, root long, linked boolean, n long, d long, g long, pos int, short boolean, most long")
    want = set()
    for _, a, ra, la, na, da, ga, pa_, short, *_ in rows:
        for _, b, rb, lb, nb, db, gb, pb, *_ in rows:
            need = max(1, math.ceil((da + db - c * (na + nb)) / 2 - 1e-6))
            if ga == gb and short and ra != rb and not (la and lb) and (da, a) < (db, b) and min(na, nb) >= 0.8 * max(na, nb) - 1e-9 and need <= min(da - pa_, db - pb):
                want.add((1, min(a, b), max(a, b)))
    assert sum(d + c * n < 2 * pos + d - c * n for *_, n, d, _, pos, _ in rows) > 20 and len(want) > 100
    assert {tuple(r) for r in near_dup._left_over(live, 0.8).collect()} == want
    cells = near_dup._left_over(live, 0.8)._jdf.queryExecution().optimizedPlan()
    made = [x for x in _nodes(cells) if x.nodeName() == "Generate"]
    assert made and all(len(_rows(spark, x)) <= 2 * len(rows) for x in made)


def _nodes(plan):
    below = plan.children()
    return [plan, *(x for i in range(below.size()) for x in _nodes(below.apply(i)))]


def _rows(spark, plan):
    """What a node of a plan returns."""
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan), spark).collect()
