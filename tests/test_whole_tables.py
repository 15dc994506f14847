"""Queries that take every row, against loops."""

import re

from helpers import DATA

from quillwork.functions import text as T
from quillwork.plans.queries import QUERIES


def items(spark):
    return {r["item_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}


def test_highlight_takes_every_item(spark):
    got = {r["item_id"]: r["highlighted"] for r in QUERIES["marker_highlight_whole"](spark, DATA).collect()}
    assert got == {i: re.sub(r"\b(the)\b", r"**\1**", t, flags=re.IGNORECASE) for i, t in items(spark).items()}
    assert any(not t.isascii() for t in got.values())


def test_highlight_beside_other_letters(spark):
    texts = ["éthe the", "theé", "“The”—the", "the_x the2 the²", "éthe thé", "дthe the"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in rows.select(T.highlighted(rows["text"], "the")).collect()] == [re.sub(r"\b(the)\b", r"**\1**", t, flags=re.IGNORECASE) for t in texts]


def test_residue_takes_every_item(spark):
    got = {r["item_id"]: r["residue_words"] for r in QUERIES["residue_words_whole"](spark, DATA).collect()}
    assert got == {i: len(re.findall(T.WORD, t.lower().replace("the", " ", 1))) for i, t in items(spark).items()}
