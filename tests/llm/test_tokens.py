"""BPE and token files against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import DATA

from quillwork.llm import bpe, queries, token_store

PATH = queries.tokenizer_path()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def strange(n: int) -> list[str]:
    rng = random.Random(5)
    some = ["", " ", "  ", "a  b", "\n\n x\ny ", "<|endoftext|>a <|endoftext|>  b<|endoftext|>", "aaaaaaaa aaaaa", "it's I'LL we've  'd", "　x   y\x85 z", "a\x1c b \x1d c", "日本語 テスト  \U0001f600\U0001f600 é́", "x" * 3000, "ab" * 2000]
    return some + ["".join(rng.choice(" \n\ta'bsétre1 2!? \x1f<|\x00") for _ in range(rng.randint(0, 50))) for _ in range(n)]


@pytest.mark.parametrize("make", [bpe.own_encoder, token_store.library_encoder])
def test_ids_equal_the_librarys(library, make):
    texts = strange(1500)
    ids, begin = bpe.Chunks(make(PATH))(pa.array(texts))
    want = library.encode_batch(texts, add_special_tokens=False)
    assert [ids[a:b].tolist() for a, b in zip(begin, begin[1:])] == [e.ids for e in want]


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED_BYTES", 300)
    chunks = bpe.Chunks(bpe.own_encoder(PATH))
    for t in strange(40):
        assert chunks(pa.array([t]))[0].tolist() == library.encode(t, add_special_tokens=False).ids


def test_decoding(library):
    at = bpe.Decoder(bpe.vocabulary(PATH).token_bytes)
    rng = np.random.default_rng(0)
    for _ in range(50):
        ids = rng.integers(0, 50257, 20)
        assert at(ids).decode("utf-8", "replace") == library.decode(ids.tolist(), skip_special_tokens=False)


def expected(library, texts):
    for t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        yield ids, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def test_round_trip_of_all_documents(spark, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = {r["doc_id"]: tuple(r) for r in queries.op3_bpe_round_trip(spark, DATA).collect()}
    want = {k: (k, len(i), a, d) for (k, _), (i, a, d) in zip(texts.items(), expected(library, texts.values()))}
    assert got == want


def test_odd_rows(spark, odd, empty, library):
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    got = sorted(map(str, (tuple(r) for r in bpe.round_trip(odd, PATH).collect())))
    assert got == sorted(str((k, len(i), a, d)) for (k, _), (i, a, d) in zip(rows, expected(library, [t for _, t in rows])))
    assert bpe.round_trip(empty, PATH).count() == 0
    back = bpe.decode(bpe.encode(odd.filter("doc_id = 9"), PATH), PATH).first()
    assert back["text"] == odd.filter("doc_id = 9").first()["text"]


def check_files(got, rows, library):
    at, want = 0, []
    for k, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((k, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == want


def test_token_files_of_all_documents(spark, library):
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect())
    check_files(queries.op4_token_files(spark, DATA).collect(), rows, library)


def test_token_files_of_odd_rows_in_small_segments(spark, odd, empty, library, tmp_path):
    rows = sorted(((r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    manifest = token_store.write(odd, PATH, str(tmp_path), segment=64)
    check_files(token_store.read(manifest, str(tmp_path)).collect(), rows, library)
    ids = [i for _, t in rows for i in library.encode(t or "", add_special_tokens=False).ids + [0]]
    asked = spark.createDataFrame([(p,) for p in range(0, len(ids), 997)], "position long")
    assert all(r["id"] == ids[r["position"]] for r in token_store.tokens_at(manifest, str(tmp_path), asked).collect())
    assert token_store.read(token_store.write(empty, PATH, str(tmp_path / "e")), str(tmp_path / "e")).count() == 0


@pytest.mark.parametrize("top", [200, 256, 70_000, 1 << 32])
def test_any_token_is_addressable(top):
    rng = np.random.default_rng(top % 97)
    ids = rng.integers(0, top, 3000, np.uint64).astype(np.uint32)
    reader = token_store.Reader(token_store.to_file(ids, [None], np.array([0, 3000])))
    at = rng.permutation(3000)
    assert (reader.get(at) == ids[at]).all() and all(reader.one(int(i)) == ids[i] for i in at[:200])
