"""Near-duplicate classes by DartMinHash signatures, banded joining and exact verification.

A document's elements are its distinct five-word shingles, weighted by how often each occurs.  DartMinHash throws the
darts of a hashed Poisson process at each element's weight, cut into dyadic regions, and keeps the earliest dart of
every coordinate; two documents share a coordinate with the probability of their weighted Jaccard similarity.  Bands of
coordinates are bucket keys.

1.  Texts with the same words in a row are one node (exact copies never meet each other again).
2.  In each bucket every node is paired with the least node alone: as many pairs as rows, however large the bucket.
    Pairs whose sizes allow it are verified by exact weighted Jaccard; connected components of the links follow.
3.  Each bucket that still holds several components gets a pivot p, the root of its largest one.  Every node x of it is
    compared with p, once for each pivot, and the signed difference D(x) = x - p of the shingle counts is kept.
    |x - y| = |D(x)| + |D(y)| - 2 common(D(x), D(y)), so if x and y are alike and not both alike to p, their differences
    have at least (|D(x)| + |D(y)| - c (|x| + |y|)) / 2 > 0 elements in common, with c = (1 - s) / (1 + s) at similarity s.
    Each node posts a prefix of its differences, those of the fewest nodes first, that must hold one of these; what no
    other node has too counts in the prefix but is not posted.
4.  In each group of equal posts all are paired with the least node first, and components are joined.  Pairs that are
    across components even then are compared if sizes, places in the prefixes (by which they are joined) and bitmaps of the
    differences allow the elements that they must have in common.

So every two nodes that share a band end in one component or are shown to be unlike, in buckets of every size, and pairs
follow the number of nodes as long as unlike texts differ from a pivot in different ways.

With 25 bands of 5 a pair at similarity 0.8 shares no band, and is missed if nothing else links it, with probability 5e-5.
Leaders and pivots are joined back by key, their texts by row: plain joins, whose hot keys adaptive execution splits.
All texts move once, into buckets by row; after that only pairs move to them.

Defined cases: null text is empty text; a text of one to four words has one shingle, all its words; texts without words
are copies only if they are the same text; repeated rows are copies of each other; rows with a null key take part; an
empty table gives no rows; other columns are ignored.  The class id of a row is the least key of its class (nulls last).
Row order of the input must be stable (a scan or a stored table).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwork.llm import common
from quillwork.llm.components import components

BANDS, ROWS, SIMILARITY = 25, 5, 0.8
#: 64-bit words of the bitmaps of what is new in a text, and of what it lacks.
MAP_WORDS = 8
#: Text bytes whose darts are thrown at once.
SKETCH_BYTES = 1 << 20
_ONE = np.uint64(1)


def elements(s: common.Shingles) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, shingle and weight of the distinct shingles of each text."""
    owner = np.repeat(np.arange(len(s.begin) - 1), np.diff(s.begin))
    order = np.lexsort((s.value, owner))
    o, v = owner[order], s.value[order]
    if not len(o):
        return o, v, np.zeros(0)
    new = np.concatenate([[True], (o[1:] != o[:-1]) | (v[1:] != v[:-1])])
    at = np.flatnonzero(new)
    return o[at], v[at], np.diff(np.append(at, len(o))).astype(float)


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def dart_minhash(owner: np.ndarray, value: np.ndarray, weight: np.ndarray, n: int, k: int = BANDS * ROWS) -> np.ndarray:
    """Signatures (n x k) of weighted sets; the rows of empty sets are zero.

    The rank axis of a text ends where it is expected to have k ln k + 2k darts, and is doubled for those texts that
    have a coordinate without a dart."""
    signature, full = np.zeros((n, k), np.uint64), np.zeros(n, bool)
    norm = np.bincount(owner, weight, minlength=n)
    full[norm <= 0] = True
    reach = (k * np.log(k) + 2 * k) / np.maximum(norm, 1e-300)
    # Regions of an element: [0, 1), [1, 2), [2, 4), ... up to its weight.
    regions = np.where(weight <= 1, 1, np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1)
    of = np.repeat(np.arange(len(weight)), regions)
    level = common.ragged(np.zeros(len(weight), np.int64), regions)
    low = np.where(level == 0, 0.0, 2.0 ** np.maximum(level - 1, 0))
    width = np.where(level == 0, 1.0, low)
    seed = common.mixed(value[of] + common.MIX * (level + 1).astype(np.uint64))
    own, cap = owner[of], weight[of]
    while not full.all():
        live = np.flatnonzero(~full[own])
        rank = np.zeros(len(live))
        ranks, places, marks, step = [], [], [], 0
        while len(live):
            h = common.mixed(seed[live] + np.uint64(int(common.MIX) * (2 * step + 1) & (1 << 64) - 1))
            g = common.mixed(h ^ common.MIX)
            rank = rank - np.log(_uniform(h)) / width[live]
            near = rank < reach[own[live]]
            live, rank, h, g = live[near], rank[near], h[near], g[near]
            inside = low[live] + width[live] * _uniform(common.mixed(g + _ONE)) < cap[live]
            ranks.append(rank[inside])
            places.append(own[live[inside]] * k + (g[inside] % np.uint64(k)).astype(np.int64))
            marks.append(h[inside])
            step += 1
        rank, place, mark = np.concatenate(ranks), np.concatenate(places), np.concatenate(marks)
        order = np.argsort(-rank, kind="stable")
        flat, got = signature.reshape(-1), np.zeros(n * k, bool)
        flat[place[order]] = mark[order]  # the earliest dart is written last
        got[place] = True
        full |= got.reshape(n, k).all(1)
        reach = np.where(full, reach, 2 * reach)
    return signature


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    part = signature.reshape(len(signature), bands, rows)
    key = np.arange(bands, dtype=np.uint64)[None, :] + _ONE
    for r in range(rows):
        key = common.mixed(key * common.MIX + part[:, :, r])
    return key


def sketched(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Stored ``key, row, content, n, bands``: the digest of the words, their number of shingles, the band keys."""
    rows = common.plain_text(docs, key, text).withColumn("row", F.monotonically_increasing_id())
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.blocks(batches, "text", SKETCH_BYTES):
            text = b.column("text")
            words = common.split_words(text)
            s = common.shingles(words)
            n = np.diff(s.begin)
            h = words.hashes()
            raw, digest = h.tobytes(), []
            for i, (a, z) in enumerate(zip(words.begin[:-1].tolist(), words.begin[1:].tolist())):
                digest.append(xxhash.xxh3_128_digest(raw[8 * a : 8 * z]) if z > a else b"-" + xxhash.xxh3_128_digest(text[i].as_py()))
            keys = band_keys(dart_minhash(*elements(s), len(n)))
            keys = keys[n > 0].astype(np.int64)
            begin = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(begin), pa.array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("row"), pa.array(digest, pa.binary()), pa.array(n, pa.int64()), bands], ["key", "row", "content", "n", "bands"])

    return common.stored(rows.mapInArrow(run, f"key {kind}, row long, content binary, n long, bands array<long>"), "sketches")


def weighted_jaccard(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Exact weighted Jaccard similarity of the shingles of a[i] and b[i]; 0 where neither has any."""
    n = len(a)
    oa, va, wa = elements(common.shingles(common.split_words(a)))
    ob, vb, wb = elements(common.shingles(common.split_words(b)))
    owner, value, weight = np.concatenate([oa, ob]), np.concatenate([va, vb]), np.concatenate([wa, wb])
    order = np.lexsort((value, owner))
    o, v, w = owner[order], value[order], weight[order]
    same = np.flatnonzero((o[1:] == o[:-1]) & (v[1:] == v[:-1]))
    low = np.bincount(o[same], np.minimum(w[same], w[same + 1]), minlength=n)
    total = np.bincount(o, w, minlength=n) - low
    return low / np.maximum(total, 1e-300)


def _with_texts(pairs: DataFrame, texts: DataFrame, hot: str, other: str) -> DataFrame:
    """``pairs`` with ``ta``, the text of ``hot``, and ``tb``, that of ``other``.

    The texts lie in buckets by row and stay where they are; pairs move to the text of ``other``, of which none has many
    pairs, and meet there.  Of ``hot`` the distinct texts move, in a shuffled join whose hot keys can be split.  The pairs
    are used twice, so they are stored."""
    pairs = common.stored(pairs, "pairs")
    wanted = texts.join(pairs.select(F.col(hot).alias("row")).distinct(), "row", "left_semi").select(F.col("row").alias(hot), F.col("text").alias("ta"))
    right = pairs.join(texts.select(F.col("row").alias(other), F.col("text").alias("tb")), other)
    return right.join(wanted, hot).select(hot, other, "ta", "tb")


def verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose texts (``row, text``) are as similar, with ``similarity``."""
    both = _with_texts(pairs, texts, "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.blocks(batches, "ta", SKETCH_BYTES):
            s = weighted_jaccard(b.column("ta"), b.column("tb"))
            ok = pa.array(s >= similarity)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(ok), b.column("b").filter(ok), pa.array(s).filter(ok)], ["a", "b", "similarity"])

    return both.mapInArrow(run, "a long, b long, similarity double")


def _alike(similarity: float):
    """Whether sizes allow the similarity (it is at most the smaller over the larger)."""
    return F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(similarity) - 1e-9


def _reach(linked: np.ndarray, n: np.ndarray, pivot: np.ndarray, d: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the prefixes that meet a partner whose difference from the pivot is no smaller, and no larger."""
    c, most = (1 - similarity) / (1 + similarity), n / similarity
    ahead = np.ceil(d - c * (n + most) / 2 - 1e-6)
    ahead = np.maximum(ahead, np.floor((d + c * (pivot - np.where(linked, n, most))) / 2 - 1e-6) + 1)
    behind = np.ceil(d - c * (n + most) - 1e-6)
    behind = np.where(linked, np.maximum(behind, np.floor((d + c * (pivot - n)) / 2 - 1e-6) + 1), behind)
    return tuple(np.maximum(0, d - np.maximum(1, x).astype(np.int64) + 1) for x in (ahead, behind))


def differences(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """``p, node, similarity, linked, n, d, new, map, ahead, behind, parts`` of pairs (p, node): sizes of the text and of its
    difference from the pivot, of which ``new`` is what the pivot lacks; the two bitmaps; lengths of the prefixes to be
    posted; the elements of the difference."""
    both = _with_texts(pairs, texts, "p", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.blocks(batches, "tb", SKETCH_BYTES):
            k = b.num_rows
            oa, va, wa = elements(common.shingles(common.split_words(b.column("ta"))))
            ob, vb, wb = elements(common.shingles(common.split_words(b.column("tb"))))
            pivot, n = np.bincount(oa, wa, minlength=k).astype(np.int64), np.bincount(ob, wb, minlength=k).astype(np.int64)
            owner, value, weight = np.concatenate([oa, ob]), np.concatenate([va, vb]), np.concatenate([-wa, wb]).astype(np.int64)
            order = np.lexsort((value, owner))
            owner, value, weight = owner[order], value[order], weight[order]
            at = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])])) if len(owner) else np.zeros(0, np.int64)
            weight = np.add.reduceat(weight, at) if len(at) else weight
            owner, value = owner[at], value[at]
            owner, value, weight = (x[weight != 0] for x in (owner, value, weight))
            times = np.abs(weight)
            lost = np.repeat(weight < 0, times)
            which = common.ragged(np.zeros(len(times), np.int64), times)
            owner = np.repeat(owner, times)
            seed = common.mixed(b.column("p").to_numpy().astype(np.uint64) + common.MIX)
            g = common.mixed(np.repeat(value, times) + common.MIX * (2 * which + lost).astype(np.uint64) + seed[owner])
            d = np.bincount(owner, minlength=k)
            new = np.bincount(owner[~lost], minlength=k)
            alike = (n + pivot - d) / np.maximum(n + pivot + d, 1)
            linked = alike >= similarity
            bits = np.zeros((k, 2 * MAP_WORDS), np.uint64)
            place = (g >> np.uint64(40)).astype(np.int64) % (64 * MAP_WORDS)
            np.bitwise_or.at(bits, (owner, lost * MAP_WORDS + (place >> 6)), _ONE << (place & 63).astype(np.uint64))
            ahead, behind = _reach(linked, n, pivot, d, similarity)
            parts = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(d)]).astype(np.int32)), pa.array(g.astype(np.int64)))
            maps = pa.ListArray.from_arrays(pa.array(np.arange(k + 1, dtype=np.int32) * 2 * MAP_WORDS), pa.array(bits.astype(np.int64).ravel()))
            columns = [b.column("p"), b.column("node"), pa.array(alike), pa.array(linked), pa.array(n), pa.array(d), pa.array(new), maps, pa.array(ahead), pa.array(behind), parts]
            yield pa.RecordBatch.from_arrays(columns, ["p", "node", "similarity", "linked", "n", "d", "new", "map", "ahead", "behind", "parts"])

    return both.mapInArrow(run, "p long, node long, similarity double, linked boolean, n long, d long, new long, map array<long>, ahead long, behind long, parts array<long>")


def posted(near: DataFrame) -> DataFrame:
    """``p, node, linked, n, d, new, g, pos, short``: the prefixes of ``differences``, by the number of nodes that differ from
    the pivot in the same way.  Any one order of a pivot's elements loses nothing; in this one what all nodes have in
    common (where the pivot is the odd one) comes last."""
    each = near.select("p", "node", F.explode("parts").alias("g"))
    often = each.groupBy(F.col("g").alias("k")).agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    shared = each.join(often, F.col("g") == F.col("k")).groupBy("p", "node").agg(F.array_sort(F.collect_list(F.struct("times", "g"))).alias("parts"))
    sizes = near.select("p", "node", "linked", "n", "d", "new", "ahead", "behind")
    rows = sizes.join(shared, ["p", "node"]).select("*", (F.col("d") - F.size("parts")).alias("alone"), F.posexplode("parts").alias("i", "part"))
    rows = rows.withColumn("pos", (F.col("alone") + F.col("i")).cast("int")).filter(F.col("pos") < F.greatest("ahead", "behind"))
    return rows.select("p", "node", "linked", "n", "d", "new", F.col("part.g").alias("g"), "pos", (F.col("pos") < F.col("ahead")).alias("short"))


def _rooted(df: DataFrame, root: DataFrame) -> DataFrame:
    return df.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _live(posts: DataFrame) -> DataFrame:
    """Posts of groups that can hold a link across components, with the group's least node that posts ahead and its largest size."""
    ahead = F.min(F.when(F.col("short"), F.struct("node", "n", "root")))
    live = posts.groupBy(F.col("g").alias("k")).agg(ahead.alias("lead"), F.max("n").alias("most"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.bool_and("linked").alias("near"))
    return posts.join(live.filter("lead IS NOT NULL AND lo <> hi AND NOT near").select("k", "lead", "most"), F.col("g") == F.col("k")).drop("k")


def _cells(live: DataFrame, similarity: float) -> DataFrame:
    """``live`` with ``from``, the cell where a post's interval begins, once for each ``cell`` that it has to be in: two at most.

    Cells are as wide as the longest interval, c times the largest size, which makes both rows and comparisons fewest.  An
    interval that is turned round lies wholly within that of any partner, so where it begins is enough."""
    c = (1 - similarity) / (1 + similarity)
    one, other = (F.col("d") - c * F.col("n")) / 2 - 1e-6, (F.col("d") + c * F.col("n")) / 2 - F.col("pos") + 1e-6
    width = F.greatest(F.lit(1.0), c * F.col("most") + 1e-5)
    cell = lambda x: F.floor(x / width).cast("int")
    rows = live.withColumn("from", cell(F.least(one, other))).withColumn("upto", F.greatest("from", cell(other)))
    return rows.select("*", F.explode(F.sequence("from", "upto")).alias("cell")).drop("upto")


def _left_over(live: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``p, a, b`` of posts across components that can have as many differences in common as they must, by their places.

    The first that x and y have in common has at least as many of either's differences from it on as they must have in
    common.  That is, the intervals of x and y from (d - c n) / 2 to (d + c n) / 2 - pos overlap (one of them may be
    turned round), so they meet in the cell where the later one begins."""
    c = (1 - similarity) / (1 + similarity)
    names = ["node", "root", "linked", "n", "d", "pos", "short", "from"]
    own = _cells(live, similarity)
    x, y = (own.select("g", "cell", *(["p"] if side == "x" else []), *(F.col(n).alias(f"{side}_{n}") for n in names)) for side in "xy")
    need = F.greatest(F.lit(1.0), F.ceil((F.col("x_d") + F.col("y_d") - c * (F.col("x_n") + F.col("y_n"))) / 2 - 1e-6))
    fits = F.col("x_short") & (F.col("x_root") != F.col("y_root")) & ~(F.col("x_linked") & F.col("y_linked")) & (F.col("cell") == F.greatest("x_from", "y_from"))
    fits = fits & (F.struct("x_d", "x_node") < F.struct("y_d", "y_node")) & (F.least("x_n", "y_n") >= F.greatest("x_n", "y_n") * F.lit(similarity) - 1e-9)
    fits = fits & (need <= F.least(F.col("x_d") - F.col("x_pos"), F.col("y_d") - F.col("y_pos")))
    return x.join(y, ["g", "cell"]).filter(fits).select("p", F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()


def _possible(pairs: DataFrame, near: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (p, a, b) that sizes and bitmaps of the differences allow as many in common as they must have."""
    c = (1 - similarity) / (1 + similarity)
    for node in "ab":
        pairs = pairs.join(near.select("p", F.col("node").alias(node), *(F.col(x).alias(f"{node}_{x}") for x in ("n", "d", "new", "map"))), ["p", node])
    need = F.greatest(F.lit(1.0), F.ceil((F.col("a_d") + F.col("b_d") - c * (F.col("a_n") + F.col("b_n"))) / 2 - 1e-6))

    def only(side: str, other: str, first: int):
        maps = [F.bit_count(F.col(f"{side}_map")[i].bitwiseAND(F.bitwise_not(F.col(f"{other}_map")[i]))) for i in range(first, first + MAP_WORDS)]
        return sum(maps[1:], maps[0])

    size = lambda side, lost: F.col(f"{side}_d") - F.col(f"{side}_new") if lost else F.col(f"{side}_new")
    common_at_most = sum((F.least(size("a", k) - only("a", "b", k * MAP_WORDS), size("b", k) - only("b", "a", k * MAP_WORDS)) for k in (0, 1)), F.lit(0))
    alike = F.least("a_n", "b_n") >= F.greatest("a_n", "b_n") * F.lit(similarity) - 1e-9
    return pairs.filter(alike & (need <= common_at_most)).select("a", "b").distinct()


def links_of(sketches: DataFrame, docs: DataFrame, similarity: float = SIMILARITY, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Nodes (``content, node``) and stored links (``a, b, similarity``) between them."""
    place = F.struct(F.col("key").isNull().alias("none"), F.col("key"), F.col("row"))
    nodes = common.stored(sketches.groupBy("content").agg(F.min(place).alias("first")).select("content", F.col("first.row").alias("node")), "nodes")
    own = sketches.join(nodes.select(F.col("node").alias("row")), "row", "left_semi")
    banded = own.select(F.col("row").alias("node"), "n", F.explode("bands").alias("bucket"))
    lead = banded.groupBy(F.col("bucket").alias("k")).agg(F.min(F.struct("node", "n")).alias("lead"), F.count(F.lit(1)).alias("size")).filter("size > 1").select("k", "lead")
    shared = common.stored(banded.join(lead, F.col("bucket") == F.col("k")).select("bucket", "node", "n", "lead"), "buckets")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    wanted = shared.select(F.col("node").alias("row")).distinct()
    texts = common.stored_by(rows, wanted, "row", "texts")
    stars = shared.select(F.col("lead.node").alias("a"), F.col("node").alias("b"), F.col("lead.n").alias("na"), F.col("n").alias("nb"))
    stars = stars.filter((F.col("a") != F.col("b")) & _alike(similarity)).select("a", "b").distinct()
    first = common.stored(verified(stars, texts, similarity), "links")
    root = common.stored(components(first), "roots")
    size = root.groupBy(F.col("root").alias("r")).agg(F.count(F.lit(1)).alias("size"))
    members = _rooted(shared.select("bucket", "node"), root.join(size, F.col("root") == F.col("r")).drop("r")).withColumn("size", F.coalesce("size", F.lit(1).cast("long")))
    still = members.groupBy(F.col("bucket").alias("k")).agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max(F.struct("size", "root")).alias("most")).filter("lo <> hi").select("k", F.col("most.root").alias("p"))
    pairs = members.join(still, F.col("bucket") == F.col("k")).filter("node <> p").select("p", "node").distinct()
    near = common.stored(differences(pairs, texts, similarity), "differences")
    second = near.filter("linked").select(F.least("p", "node").alias("a"), F.greatest("p", "node").alias("b"), "similarity")
    posts = _rooted(posted(near), root)
    live = common.stored(_live(posts), "posts")
    leads = live.filter("root <> lead.root").select("p", F.col("lead.node").alias("a"), F.col("node").alias("b"), F.col("n").alias("na"), F.col("lead.n").alias("nb"))
    leads = leads.filter(_alike(similarity)).select("p", "a", "b").distinct()
    third = common.stored(verified(_possible(leads, near, similarity), texts, similarity), "links")
    links = first.unionByName(second).unionByName(third)
    root = components(root.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(third.select("a", "b")))
    left = common.stored(_live(_rooted(live.drop("root", "lead", "most"), root)).drop("lead"), "live-posts")
    rest = _possible(_left_over(left, similarity), near, similarity)
    return nodes, links.unionByName(common.stored(verified(rest, texts, similarity), "links"))


def classes(docs: DataFrame, similarity: float = SIMILARITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row ``key, row, class_id, lead_row, n_copies``: ``lead_row`` is the row that stands for its class."""
    sketches = sketched(docs, key, text)
    nodes, links = links_of(sketches, docs, similarity, text)
    node = nodes.join(components(links), "node", "left").select("content", F.coalesce("root", "node").alias("root"))
    copies = sketches.groupBy("content").agg(F.count(F.lit(1)).alias("n_copies"), F.min(F.struct(F.col("key").isNull().alias("none"), F.col("key"), F.col("row"))).alias("first"))
    node = node.join(copies, "content")
    least = node.groupBy("root").agg(F.min("first").alias("lead"))
    node = common.stored(node.join(least, "root").select("content", "n_copies", F.col("lead.key").alias("class_id"), F.col("lead.row").alias("lead_row")), "classes")
    return sketches.select("key", "row", "content").join(node, "content").select(F.col("key").alias(key), "row", "class_id", "lead_row", "n_copies")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each class: the one with the least key (and of those the first)."""
    found = classes(docs, similarity, key, text)
    kept = found.filter("row = lead_row").select(F.col("row").alias("_kept_row"))
    names = docs.columns
    rows = docs.select(F.monotonically_increasing_id().alias("_kept_row"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)))
    return rows.join(kept, "_kept_row", "left_semi").select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)))
