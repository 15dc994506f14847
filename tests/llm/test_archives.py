"""WARC bundles."""

import base64
import hashlib

import pytest
import zstandard
from helpers import DATA

from quillwork.llm import common, queries, warc


def plain(rows, least=0):
    """(id, bytes, digest, type, refers) of (id, html) in scan order."""
    first = {}
    for i, (k, h) in enumerate(rows):
        p = (h or "").encode()
        place = (k is None, k or 0, i)
        if len(p) >= least and place < first.get(p, ((True, 1 << 62, 0),))[0]:
            first[p] = (place, i)
    for i, (k, h) in enumerate(rows):
        p = (h or "").encode()
        mine = len(p) < least or first[p][1] == i
        yield k, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if mine else "revisit", None if mine else rows[first[p][1]][0]


def test_archives_of_all_pages(spark):
    rows = [(r["page_id"], r["html"]) for r in common.table(spark, DATA, "pages").collect()]
    got = sorted(map(tuple, queries.op9_warc(spark, DATA).collect()), key=str)
    assert got == sorted(plain(rows), key=str)


def test_sql_of_the_archives(spark, duck):
    got = queries.op9_warc(spark, DATA)
    want = duck.execute(queries.SQL["op9_warc"])
    names = [d[0] for d in want.description]
    assert sorted(str(tuple(r)) for r in got.select(*names).collect()) == sorted(map(str, want.fetchall()))


@pytest.mark.parametrize("least", [0, 3])
def test_odd_pages(spark, tmp_path, least):
    rows = [(3, "same"), (1, "same"), (1, "same"), (None, "same"), (5, None), (6, ""), (7, "é\r\n\r\n WARC/1.1"), (None, None), (8, "x" * 700_000), (9, "ab"), (4, "ab")]
    df = spark.createDataFrame([(k, None if k == 3 else "http://a/\r\nX: y", h, "r") for k, h in rows], "page_id long, url string, html string, row string").coalesce(1)
    index = warc.write(df, str(tmp_path / "w"), min_bytes=least)
    got = sorted(map(str, (tuple(r) for r in warc.read(index, str(tmp_path / "w")).collect())))
    assert got == sorted(map(str, plain(rows, least)))
    asked = spark.createDataFrame([(7,), (8,), (99,)], "page_id long")
    assert {(r["page_id"], r["payload"]) for r in warc.fetch(index, str(tmp_path / "w"), asked).collect()} == {(7, rows[6][1]), (8, rows[8][1])}
    assert warc.read(warc.write(df.limit(0), str(tmp_path / "e")), str(tmp_path / "e")).count() == 0


def test_a_plain_decompressor_reads_a_bundle():
    b = warc.Bundle()
    records = [warc.to_record("response", warc.record_id(i, i), "u", b"p" * (i * 9000), None, "D") for i in range(60)]
    for i, r in enumerate(records):
        b.add(warc.record_id(i, i), r)
    data = b.close()
    assert len(b.sizes) > 1
    out = b"".join(zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read(-1) for _ in range(1))
    assert out == b"".join(records)
