"""Exact removal of repeated byte strings of a minimum length.

What is removed is each byte that a string of ``LENGTH`` bytes covers which also starts anywhere else.  Plan:

1.  Every window of ``LENGTH`` bytes names an anchor, the least hash among its ``GRAM``-byte strings (leftmost of
    equals); equal windows name equal anchors at equal offsets.  A text is so cut into segments, runs of windows with
    the same anchor.  Anchors that neither two different texts nor two segments of one text share are dropped by a
    pre-aggregated minimum and maximum.
2.  Segments of the other anchors are made distinct, dealt by anchor and laid end to end in buffers.  A buffer is
    suffix-sorted and its Burrows-Wheeler transform extended backward breadth first, from the empty string by one byte a
    level: intervals of equal prefixes split, and each border met at level l has a common prefix of l bytes.  The search
    stops at ``LENGTH``; borders not met by then lie between suffixes that share at least so many bytes.
3.  Repeated windows go back to the texts, and their union is removed.

Equal texts are handled once: all their windows are repeated.  An anchor with more than ``HOT`` distinct segments
would not fit a buffer; there steps of windows, and windows of the steps that are left, are counted by 128-bit digests,
pre-aggregated, with the same result.

Defined cases: null text is empty text; texts shorter than ``LENGTH`` keep all; bytes are those of UTF-8 and kept bytes
need not be UTF-8; repeated rows are repeated texts; null keys are carried; an empty table gives no rows; other columns
are ignored.  Row order of the input must be stable (a scan or a stored table).
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwork.llm import common

LENGTH, GRAM = 400, 128
#: Bytes of a buffer and of a block of texts; distinct segments of an anchor that still go to one.
BUFFER, BLOCK, HOT = 3 << 19, 1 << 20, 2000
#: Windows that the way for larger anchors takes together.
STEP = 8
#: Intervals up to this size, or all if they hold no more suffixes, are extended suffix by suffix, others byte by byte.
SMALL, EXPANDED = 24, 100_000


@functools.lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, int, int]:
    rng = np.random.default_rng(41)
    base = 0x9E3779B97F4A7C55
    return rng.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1), base, pow(base, -1, 1 << 64)


@functools.lru_cache(maxsize=2)
def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes from every position that has as many."""
    table, base, inverse = _tables()
    n = len(data)
    size = 1 << max(12, n.bit_length())
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(table[data] * _powers(size, base)[:n], out=total[1:])
    return common.mixed((total[gram:] - total[:-gram]) * _powers(size, inverse)[: n - gram + 1])


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each ``w`` values in a row."""
    n = len(x)
    pad = np.concatenate([x, np.full(-n % w, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(pad, axis=1).ravel()
    back = np.minimum.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def segments(data: np.ndarray, begin: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, first and last window and anchor hash of every segment of texts that lie end to end."""
    return placed_segments(data, begin, length, gram)[:4]


def placed_segments(data: np.ndarray, begin: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same, and the place of each anchor."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, np.zeros(0, np.uint64), none
    h = gram_hashes(data, gram)
    bits = np.uint64(max(1, len(data).bit_length()))
    place = np.arange(len(h), dtype=np.uint64)
    least = sliding_least((h >> bits) << bits | place, length - gram + 1)
    anchor = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    size = np.diff(begin)
    count = np.maximum(0, size - length + 1)
    start = common.ragged(begin[:-1], count)
    if not len(start):
        return none, none, none, np.zeros(0, np.uint64), none
    text, own = np.repeat(np.arange(len(size)), count), anchor[start]
    new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (text[1:] != text[:-1])]))
    last = np.append(new[1:], len(start)) - 1
    return text[new], start[new], start[last], h[own[new]], own[new]


def suffix_order(t: np.ndarray, length: int) -> np.ndarray:
    """Order of the cyclic suffixes by their first ``length`` symbols at least (symbols below 512)."""
    n, h = len(t), 7
    key = np.zeros(n, np.int64)
    for j in range(h):
        key = key << 9 | np.roll(t, -j)
    while True:
        order = np.argsort(key)
        s = key[order]
        step = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])])
        if h >= length or step[-1] == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = step
        key = rank << 32 | np.roll(rank, -h)
        h *= 2


def long_borders(bwt: np.ndarray, length: int) -> np.ndarray:
    """Whether neighbours i - 1 and i in suffix order share at least ``length`` symbols, for i from 0 to n.

    Breadth-first backward extension: level l holds intervals of strings of l symbols; extending one by a symbol gives an
    interval of l + 1 symbols whose upper border, if it was not met before, has a common prefix of exactly l."""
    n = len(bwt)
    psi = np.argsort(bwt, kind="stable")
    lf = np.empty(n, np.int64)
    lf[psi] = np.arange(n)
    first = bwt[psi]
    at = np.unique(first, return_index=True)[1]
    upto = np.append(at[1:], n)
    met = np.zeros(n + 1, bool)
    met[[0, n]] = True
    same = np.zeros(n + 1, bool)
    same[1:n] = first[1:] == first[:-1]
    after = np.append(psi, -1)
    lo, hi = np.array([0]), np.array([n])
    for _ in range(length):
        lows, highs = [], []
        big = hi - lo > SMALL
        if (hi - lo)[big].sum() < EXPANDED:
            big[:] = False
        a, b = lo[big], hi[big]
        if len(a):
            for start, end in zip(at.tolist(), upto.tolist()):
                own = psi[start:end]
                x, y = start + np.searchsorted(own, a), start + np.searchsorted(own, b)
                ok = (y > x) & ~met[y]
                lows.append(x[ok]), highs.append(y[ok])
        a, b = lo[~big], hi[~big]
        if len(a):
            # The new intervals of a level are disjoint runs of the suffixes' new places: sorted borders pair up.
            size = b - a
            q = lf[common.ragged(a, size)]
            starts = q[~(same[q] & (psi[q - 1] >= np.repeat(a, size)))]
            ends = q[~(same[q + 1] & (after[q + 1] < np.repeat(b, size)))] + 1
            starts.sort(), ends.sort()
            ok = ~met[ends]
            lows.append(starts[ok]), highs.append(ends[ok])
        if not lows:
            break
        lo, hi = np.concatenate(lows), np.concatenate(highs)
        hi, one = np.unique(hi, return_index=True)
        lo = lo[one]
        if not len(hi):
            break
        met[hi] = True
    return ~met


def repeated(parts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """Positions in each part where a string of ``length`` bytes starts that starts elsewhere in the parts, too."""
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    begin = np.cumsum(size + 1) - size - 1
    t = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8).astype(np.int64) + 1
    t[begin + size] = 0
    order = suffix_order(t, length)
    border = long_borders(t[order - 1], length)
    again = border[:-1] | border[1:]
    hit = np.zeros(len(t), bool)
    hit[order[again]] = True
    owner = np.repeat(np.arange(len(parts)), size + 1)
    offset = np.arange(len(t)) - begin[owner]
    hit &= offset <= size[owner] - length
    where = np.flatnonzero(hit)
    return np.split(offset[where], np.searchsorted(owner[where], np.arange(1, len(parts))))


def runs(positions: np.ndarray) -> np.ndarray:
    """First and last of the runs of sorted positions, as an n x 2 array."""
    if not len(positions):
        return np.zeros((0, 2), np.int64)
    cut = np.flatnonzero(np.diff(positions) > 1) + 1
    return np.stack([positions[np.concatenate([[0], cut])], positions[np.append(cut, len(positions)) - 1]], 1)


def _flat(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    text = common.large(text)
    begin = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, 8 * text.offset)
    body = text.buffers()[2]
    data = np.frombuffer(body, np.uint8)[begin[0] : begin[-1]] if body and begin[-1] > begin[0] else np.zeros(0, np.uint8)
    return data, begin - begin[0]


def _pack(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a, "<i8").tobytes()


def anchored(docs: DataFrame, key: str, text: str, length: int, gram: int) -> DataFrame:
    """Stored ``key, row, mark, n_bytes, sha, anchors``."""
    rows = common.plain_text(docs, key, text).withColumn("row", F.monotonically_increasing_id())
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.blocks(batches, "text", BLOCK):
            data, begin = _flat(b.column("text"))
            own, _, _, anchor = segments(data, begin, length, gram)
            part = [data[x:y].tobytes() for x, y in zip(begin, begin[1:])]
            cut = np.searchsorted(own, np.arange(len(begin))).astype(np.int32)
            arrays = [pa.array([xxhash.xxh3_128_digest(p) for p in part], pa.binary()), pa.array(np.diff(begin)), pa.array([hashlib.sha256(p).hexdigest() for p in part]), pa.ListArray.from_arrays(pa.array(cut), pa.array(anchor.astype(np.int64)))]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("row"), *arrays], ["key", "row", "mark", "n_bytes", "sha", "anchors"])

    return common.stored(rows.mapInArrow(run, f"key {kind}, row long, mark binary, n_bytes long, sha string, anchors array<long>"), "anchors")


def _cut(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """``row, first, anchor, lead, digest, piece`` of the segments with a shared anchor; a piece comes once a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.blocks(batches, "text", BLOCK):
            data, begin = _flat(b.column("text"))
            own, first, last, anchor, at = placed_segments(data, begin, length, gram)
            shared = b.column("shared")
            n = np.diff(np.asarray(shared.offsets))
            want = np.unique(np.stack([np.repeat(np.arange(len(n)), n), shared.flatten().to_numpy()], 1), axis=0) if n.sum() else np.zeros((0, 2), np.int64)
            known = set(map(tuple, want.tolist()))
            rows = b.column("row").to_numpy()
            out, seen = [], set()
            for i, x, y, a, z in zip(own.tolist(), first.tolist(), last.tolist(), anchor.astype(np.int64).tolist(), at.tolist()):
                if (i, a) in known:
                    piece = data[x : y + length].tobytes()
                    digest = xxhash.xxh3_128_digest(piece)
                    out.append((int(rows[i]), x - int(begin[i]), a, z - x, digest, None if digest in seen else piece))
                    seen.add(digest)
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["row", "first", "anchor", "lead", "digest", "piece"])

    return texts.mapInArrow(run, "row long, first long, anchor long, lead int, digest binary, piece binary")


def _by_transform(pieces: DataFrame, length: int) -> DataFrame:
    """``digest, found`` (packed runs of repeated windows) of the distinct pieces, anchor by anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, bytes, int]] = []
        size, last = 0, None

        def flush() -> pa.RecordBatch:
            hits = repeated([p for _, p, _ in held], length)
            out = [(d, _pack(np.array([[0, len(p) - length]]) if n > 1 else runs(h))) for (d, p, n), h in zip(held, hits) if n > 1 or len(h)]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.binary()) for i in (0, 1)], ["digest", "found"])

        for b in batches:
            for anchor, digest, piece, n in zip(*(b.column(c).to_pylist() for c in ("anchor", "digest", "piece", "n"))):
                if size >= BUFFER and anchor != last:
                    yield flush()
                    held, size = [], 0
                held.append((digest, piece, n))
                size, last = size + len(piece), anchor
        if held:
            yield flush()

    return pieces.select("anchor", "digest", "piece", "n").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "digest binary, found binary")


def _by_count(pieces: DataFrame, length: int) -> DataFrame:
    """The same for anchors with very many distinct pieces, by counts.

    Windows are taken ``STEP`` at a time by their distance from the anchor, so equal windows are in equal steps.  The
    bytes that all windows of a step have are its core: a core that occurs once ends there.  Steps with the same bytes are counted as one, and only their windows are counted singly."""

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for p, lead in zip(b.column("piece").to_pylist(), b.column("lead").to_pylist()):
                last, own = len(p) - length, []
                for k in range((lead - last) // STEP, lead // STEP + 1):  # windows from lead - k STEP - STEP + 1 to lead - k STEP
                    i, j = max(0, lead - k * STEP - STEP + 1), min(last, lead - k * STEP)
                    core = p[lead - k * STEP : lead - k * STEP - STEP + 1 + length]
                    own.append({"at": i, "upto": j, "core": xxhash.xxh3_128_digest(core, k), "whole": xxhash.xxh3_128_digest(p[i : j + length], k)})
                out.append(own)
            kind = pa.list_(pa.struct([("at", pa.int64()), ("upto", pa.int64()), ("core", pa.binary()), ("whole", pa.binary())]))
            yield pa.RecordBatch.from_arrays([b.column("digest"), b.column("n"), pa.array(out, kind)], ["digest", "n", "steps"])

    pieces = pieces.select("digest", "n", "lead", "piece").repartition("digest")
    each = pieces.mapInArrow(steps, "digest binary, n long, steps array<struct<at: long, upto: long, core: binary, whole: binary>>").select("digest", "n", F.inline("steps"))
    each = common.stored(each, "steps")
    often = each.groupBy(F.col("core").alias("c")).agg(F.sum("n").alias("times")).filter("times > 1").select("c")
    left = common.stored(each.join(often, F.col("core") == F.col("c"), "left_semi").select("digest", "n", "at", "upto", "whole"), "shared-steps")
    one = left.groupBy("whole").agg(F.sum("n").alias("times"), F.min(F.struct("digest", "at", "upto")).alias("first"))
    texts = one.select("whole", "times", F.col("first.digest").alias("digest"), F.col("first.at").alias("at"), F.col("first.upto").alias("upto")).join(pieces.select("digest", "piece"), "digest")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks = [[xxhash.xxh3_128_digest(p[i : i + length]) for i in range(at, upto + 1)] for p, at, upto in zip(*(b.column(c).to_pylist() for c in ("piece", "at", "upto")))]
            yield pa.RecordBatch.from_arrays([b.column("whole"), b.column("times"), pa.array(marks, pa.list_(pa.binary()))], ["whole", "times", "marks"])

    single = texts.select("whole", "times", "at", "upto", "piece").repartition("whole").mapInArrow(windows, "whole binary, times long, marks array<binary>").select("whole", "times", F.posexplode("marks").alias("k", "mark"))
    single = common.stored(single, "windows")
    again = single.groupBy(F.col("mark").alias("m")).agg(F.sum("times").alias("all")).filter("all > 1").select("m")
    hits = single.join(again, F.col("mark") == F.col("m"), "left_semi").groupBy("whole").agg(F.collect_list(F.col("k").cast("long")).alias("ks"))
    found = left.join(hits, "whole").groupBy("digest").agg(F.array_sort(F.flatten(F.collect_list(F.transform("ks", lambda k: k + F.col("at"))))).alias("at"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array([_pack(runs(np.array(x))) for x in b.column("at").to_pylist()], pa.binary())], ["digest", "found"])

    return found.mapInArrow(pack, "digest binary, found binary")


def spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, key: str = "doc_id", text: str = "text", hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Anchored rows, and per distinct text with repeated windows ``row, n_copies, text, at`` (array of packed runs, with offsets)."""
    rows = anchored(docs, key, text, length, gram)
    one = rows.groupBy("mark").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("n_copies"))
    # An anchor is shared if two different texts have it or one text has it twice.
    copies = rows.filter("size(anchors) > 0").join(one.select("row"), "row", "left_semi").select("row", F.explode("anchors").alias("anchor"))
    places = copies.groupBy("row", "anchor").agg(F.count(F.lit(1)).alias("n"))
    shared = places.groupBy(F.col("anchor").alias("k")).agg(F.min("row").alias("lo"), F.max("row").alias("hi"), F.max("n").alias("n")).filter("lo <> hi OR n > 1").select("k")
    wanted = places.join(shared, F.col("anchor") == F.col("k")).groupBy("row").agg(F.collect_list("anchor").alias("shared"))
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    texts = common.stored(source.join(wanted, "row"), "texts")
    pieces = common.stored(_cut(texts, length, gram), "pieces")
    distinct = common.stored(pieces.groupBy("digest").agg(F.first("anchor").alias("anchor"), F.first("lead").alias("lead"), F.max("piece").alias("piece"), F.count(F.lit(1)).alias("n")), "distinct-pieces")
    many = common.stored(distinct.groupBy(F.col("anchor").alias("k")).agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > hot).select("k"), "hot-anchors")
    if many.isEmpty():
        found = _by_transform(distinct, length)
    else:
        found = _by_transform(distinct.join(many, F.col("anchor") == F.col("k"), "left_anti"), length).unionByName(_by_count(distinct.join(many, F.col("anchor") == F.col("k"), "left_semi"), length))
    at = pieces.select("row", "first", "digest").join(common.stored(found, "found"), "digest").groupBy("row").agg(F.collect_list(F.struct("first", "found")).alias("at"))
    return rows.join(one.select("mark", F.col("row").alias("own"), "n_copies"), "mark"), texts.select("row", "text").join(at, "row")


def removed(data: bytes, at: list[dict], length: int) -> tuple[bytes, int, int]:
    """Kept bytes, number of removed bytes, number of maximal removed runs."""
    edge = np.zeros(len(data) + 1, np.int64)
    for x in at:
        r = np.frombuffer(x["found"], "<i8").reshape(-1, 2) + x["first"]
        np.add.at(edge, r[:, 0], 1)
        np.add.at(edge, r[:, 1] + length, -1)
    gone = np.cumsum(edge)[:-1] > 0
    starts = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
    return np.frombuffer(data, np.uint8)[~gone].tobytes(), int(gone.sum()), starts


def dedup(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text", gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """Per row ``key, n_bytes, n_removed, n_spans, kept_sha256``."""
    rows, cut = spans(docs, length, gram, key, text, hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.blocks(batches, "text", BLOCK):
            out = [removed(t.encode(), at, length) for t, at in zip(b.column("text").to_pylist(), b.column("at").to_pylist())]
            kept = [hashlib.sha256(k).hexdigest() for k, _, _ in out]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array([n for _, n, _ in out], pa.int64()), pa.array([s for _, _, s in out], pa.int64()), pa.array(kept, pa.string())], ["own", "gone", "runs", "kept"])

    each = cut.mapInArrow(run, "own long, gone long, runs long, kept string")
    whole = (F.col("n_copies") > 1) & (F.col("n_bytes") >= length)
    joined = rows.join(each, "own", "left")
    return joined.select(
        F.col("key").alias(key),
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("gone", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(whole, F.lit(1).cast("long")).otherwise(F.coalesce("runs", F.lit(0).cast("long"))).alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )
