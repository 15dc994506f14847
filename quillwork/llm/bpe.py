"""BPE encoding and decoding with a pair occurrence index.

The distinct space-bounded pieces of a block of texts are laid out in one symbol array.  An index maps each
mergeable pair to all its positions there; ranks that are active are applied in ascending order, each merge at
all positions of its pair at once, and the lists of the pairs it makes are extended.  Whole texts are then
gathered from the pieces.  Rows do not depend on each other, so there is no shuffle.

Defined cases: null text encodes as empty text (no ids); repeated rows give repeated results; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwork.llm import common

#: The pieces of byte-level BPE (fixed value; also public_tokenizers.PATTERN).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WHITE = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WHITE_PAIR = f"[{WHITE}]{{2}}"
#: Bytes of encoded chunks (texts, ids and their places) that a Python worker remembers between blocks.
REMEMBERED_BYTES = 48 << 20
END, NONE = -1, 1 << 30


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies, as letter -> byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Merges, token bytes and special tokens of a byte-level ``tokenizers`` file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        ids = model["vocab"]
        self.size = 1 + max([*ids.values(), *(t["id"] for t in spec["added_tokens"])])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_bytes = [b""] * self.size
        for token, i in ids.items():
            if token not in self.special:
                self.token_bytes[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.of_byte = np.zeros(256, np.int64)
        for letter, b in letters.items():
            self.of_byte[b] = ids[letter]
        pairs = [m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"]]
        left = np.array([ids[a] for a, _ in pairs], np.int64)
        right = np.array([ids[b] for _, b in pairs], np.int64)
        made = np.array([ids[a + b] for a, b in pairs], np.int64)
        rank_of = np.full(self.size, -1, np.int64)
        rank_of[made] = np.arange(len(made))
        if (np.maximum(rank_of[left], rank_of[right]) >= np.arange(len(made))).any():
            raise ValueError("a merge uses a token that a later merge makes")
        self.left, self.right, self.made = left, right, made
        key = left * self.size + right
        self.order = np.argsort(key)
        self.key = key[self.order]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``NONE`` where it is no merge or a side is the end of a piece."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where((self.key[at] == key) & (left >= 0) & (right >= 0), self.order[at], NONE)

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after another, and the number of each."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        n = int(size.sum()) + len(pieces)
        sym = np.full(n, END, np.int64)
        body = np.ones(n, bool)
        body[np.cumsum(size + 1) - 1] = False
        sym[body] = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        self._merge(sym)
        kept = sym >= 0
        owner = np.repeat(np.arange(len(pieces)), size + 1)
        return sym[kept], np.bincount(owner[kept], minlength=len(pieces))

    def _merge(self, sym: np.ndarray) -> None:
        """Merges in place; a symbol that was merged into its left neighbour becomes -2, an end stays -1."""
        n = len(sym)
        if n < 2:
            return
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[-1] = n - 1
        first = self.ranks(sym[:-1], sym[1:])
        at = np.flatnonzero(first < NONE)
        at = at[np.argsort(first[at], kind="stable")]
        rank, cut = np.unique(first[at], return_index=True)
        index: dict[int, list] = {int(r): [p] for r, p in zip(rank, np.split(at, cut[1:]))}
        active = list(index)
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            arrays = [x for x in lists if not isinstance(x, int)]
            more = [x for x in lists if isinstance(x, int)]
            pos = np.concatenate([*arrays, np.array(more, np.int64)]) if more else arrays[0] if len(arrays) == 1 else np.concatenate(arrays)
            a, b, made = self.left[r], self.right[r], self.made[r]
            if more or len(arrays) > 1:
                pos = np.unique(pos)
            pos = pos[(sym[pos] == a) & (sym[after[pos]] == b)]
            if not len(pos):
                continue
            if a == b and len(pos) > 1:  # of overlapping pairs the leftmost goes first
                start = np.concatenate([[True], after[pos[:-1]] != pos[1:]])
                run = np.maximum.accumulate(np.where(start, np.arange(len(pos)), 0))
                pos = pos[(np.arange(len(pos)) - run) % 2 == 0]
            gone = after[pos]
            nxt = after[gone]
            sym[pos], sym[gone] = made, -2
            after[pos], before[nxt] = nxt, pos
            prev = before[pos]
            prev = prev[prev >= 0]
            for left in (prev, pos):
                new = self.ranks(sym[left], sym[after[left]])
                ok = new < NONE
                for k, p in zip(new[ok].tolist(), left[ok].tolist()):
                    if k in index:
                        index[k].append(p)
                    else:
                        index[k] = [p]
                        heapq.heappush(active, k)


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Chunks:
    """Encodes texts by their space-bounded chunks; ``encode`` gets an array of distinct chunks and returns their ids."""

    def __init__(self, encode) -> None:
        self.encode = encode
        self.known = pa.array([], pa.large_string())
        self.start = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, chunks: pa.Array) -> np.ndarray:
        """Where each of the distinct ``chunks`` is among those known; beyond the limit only these are remembered."""
        found = pc.index_in(chunks, value_set=self.known)
        place = found.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        unknown = np.flatnonzero(place < 0)
        if len(unknown):
            new = chunks.take(pa.array(unknown))
            ids, length = self.encode(new)
            place[unknown] = len(self.known) + np.arange(len(unknown))
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(length) - length])
            self.length = np.concatenate([self.length, length.astype(np.int32)])
            self.ids = np.concatenate([self.ids, ids.astype(np.uint32)])
            self.known = pa.concat_arrays([self.known, new])
        if self.known.nbytes + self.start.nbytes + self.length.nbytes + self.ids.nbytes > REMEMBERED_BYTES and len(self.known) > len(chunks):
            start, self.length = self.start[place], self.length[place]
            self.ids = self.ids[common.ragged(start, self.length.astype(np.int64))]
            self.start = np.cumsum(self.length, dtype=np.int64) - self.length
            self.known, place = chunks, np.arange(len(chunks))
        return place

    def __call__(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and where each text's begin (one more entry than texts)."""
        text = common.large(text)
        n = len(text)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        # A space between two characters that are not white space always begins a piece, so the text can be cut there.
        odd = pc.match_substring_regex(text, WHITE_PAIR).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(odd), "", text)
        parts = pc.split_pattern(plain, " ")
        count = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = parts.flatten()
        begin = np.cumsum(count) - count
        first = np.zeros(len(flat), bool)
        first[begin] = True
        spaced = pc.binary_join_element_wise(pc.if_else(pa.array(first), "", " ").cast(pa.large_string()), flat, pa.scalar("", pa.large_string()))
        if odd.any():  # texts with wider white space are cut one by one
            cut = [regex.split(r"(?<=\S)(?= \S)(?<![\x1c-\x1f])(?! [\x1c-\x1f])", text[i].as_py()) for i in np.flatnonzero(odd).tolist()]
            count[odd] = [len(c) for c in cut]
            begin[odd] = len(spaced) + np.cumsum(count[odd]) - count[odd]
            spaced = pa.concat_arrays([spaced, pa.array([c for x in cut for c in x], pa.large_string())])
        encoded = spaced.dictionary_encode()
        code = encoded.indices.to_numpy(zero_copy_only=False)
        piece = self._learn(encoded.dictionary)[code]
        if odd.any():
            piece = piece[common.ragged(begin, count)]
        length = self.length[piece].astype(np.int64)
        out = self.ids[common.ragged(self.start[piece], length)]
        edge = np.concatenate([[0], np.cumsum(count)])
        return out, np.concatenate([[0], np.cumsum(length)])[edge]


def own_encoder(path: str):
    """Encodes distinct chunks by the pair occurrence index."""
    vocab = vocabulary(path)
    find = regex.compile(PATTERN)
    special = regex.compile("|".join(map(regex.escape, sorted(vocab.special, key=len, reverse=True)))) if vocab.special else None

    def encode(chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        at: dict[bytes, int] = {}
        use: list[int] = []
        count = np.zeros(len(chunks), np.int64)
        marks = list(vocab.special.values())
        for i, chunk in enumerate(chunks.to_pylist()):
            spans = [(chunk, None)]
            if special and (hits := list(special.finditer(chunk))):
                edges = [0, *(x for m in hits for x in m.span()), len(chunk)]
                spans = [(chunk[a:b], None) for a, b in zip(edges[::2], edges[1::2])]
                spans = [x for pair in zip(spans, [*((m.group(), vocab.special[m.group()]) for m in hits), ("", None)]) for x in pair]
            before = len(use)
            for part, mark in spans:
                if mark is not None:
                    use.append(-1 - marks.index(mark))
                else:
                    use.extend(at.setdefault(p.encode(), len(at)) for p in find.findall(part))
            count[i] = len(use) - before
        ids, length = vocab.encode_pieces(list(at))
        start = np.cumsum(length) - length
        ids = np.concatenate([ids, np.array(marks, np.int64)])
        start = np.concatenate([start, len(ids) - len(marks) + np.arange(len(marks))])
        length = np.concatenate([length, np.ones(len(marks), np.int64)])
        piece = np.array(use, np.int64)
        piece = np.where(piece < 0, len(at) - 1 - piece, piece)
        per = length[piece]
        edge = np.concatenate([[0], np.cumsum(per)])[np.concatenate([[0], np.cumsum(count)])]
        return ids[common.ragged(start[piece], per)], np.diff(edge)

    return encode


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Chunks:
    return Chunks(own_encoder(path))


class Decoder:
    """Bytes of ids, by a flat table of token bytes."""

    def __init__(self, token_bytes: list[bytes]) -> None:
        self.length = np.fromiter(map(len, token_bytes), np.int64, len(token_bytes))
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(token_bytes), np.uint8)

    def __call__(self, ids: np.ndarray) -> bytes:
        return self.flat[common.ragged(self.start[ids], self.length[ids])].tobytes()


@functools.lru_cache(maxsize=2)
def decoder(path: str) -> Decoder:
    return Decoder(vocabulary(path).token_bytes)


def encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, ids`` (array<int>) of every whole text."""
    rows = common.plain_text(df, key, text)
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.blocks(batches):
            ids, begin = encoder(path)(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(ids.astype(np.int32)))], ["key", "ids"])

    return rows.mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def decode(df: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key, text`` of every list of ids; bytes that are no UTF-8 become U+FFFD.  Null ids decode as empty text."""
    rows = df.selectExpr(f"`{key}` AS key", f"`{ids}` AS ids")
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = decoder(path)
            out = [at(np.array(x.as_py() or [], np.int64)).decode("utf-8", "replace") for x in b.column("ids")]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(out, pa.string())], ["key", "text"])

    return rows.mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)


def round_trip(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_tokens, ids_sha256, decoded_sha256``: encodes every whole text, decodes its ids, digests both."""
    rows = common.plain_text(df, key, text)
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.blocks(batches):
            ids, begin = encoder(path)(b.column("text"))
            raw, at = ids.astype("<u4").tobytes(), decoder(path)
            length = np.concatenate([[0], np.cumsum(at.length[ids])])[begin]
            data = at(ids)
            a, d = [], []
            for i in range(b.num_rows):
                a.append(hashlib.sha256(raw[4 * begin[i] : 4 * begin[i + 1]]).hexdigest())
                part = data[length[i] : length[i + 1]]
                d.append(hashlib.sha256(part.decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(np.diff(begin), pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(run, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)


def tokenized(df: DataFrame, path: str, carry: list[str], text: str = "text") -> DataFrame:
    """Columns ``carry`` with ``n_tokens``, ``ids`` (array<int>) and whether the ids decode to the text again."""
    rows = df.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "n_tokens long, ids array<int>, same_text boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.blocks(batches):
            ids, begin = encoder(path)(b.column("text"))
            at = decoder(path)
            length = np.concatenate([[0], np.cumsum(at.length[ids])])[begin]
            data = at(ids)
            same = [data[x:y].decode("utf-8", "replace") == t for x, y, t in zip(length, length[1:], b.column("text").to_pylist())]
            lists = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.diff(begin)), lists, pa.array(same)], [*b.schema.names[:-1], "n_tokens", "ids", "same_text"])

    out = rows.mapInArrow(run, schema)
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(carry)), "n_tokens", "ids", "same_text")
