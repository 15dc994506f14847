"""The pipeline's stages against plain versions, each on its own input."""

import re

from helpers import DATA
from test_dedup import brute_classes
from test_filters import brute_leaks

import corpus_pipeline
from quillwork.llm import bpe, common, queries, toxicity


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages(spark):
    docs = common.table(spark, DATA, "documents")
    held, kept = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        before = kept
        kept = common.stored(stage(spark, before, DATA), "test")
        held[name] = (by_id(before), by_id(kept))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert kept.columns == docs.columns
    before, after = held["toxicity"]
    scores = toxicity.judge(docs, common.table(spark, DATA, "labels")).collect()
    assert set(after) == {r["doc_id"] for r in scores if not r["predicted"]} and after == {k: before[k] for k in after}
    before, after = held["near-duplicates"]
    rows = [(k, r["text"]) for k, r in before.items()]
    assert set(after) == set(brute_classes(rows)) and after == {k: before[k] for k in after}
    before, after = held["decontamination"]
    items = [(r["item_id"], r["text"]) for r in common.table(spark, DATA, "benchmark").collect()]
    leaks = {k for k, *_ in brute_leaks([(k, r["text"]) for k, r in before.items()], items)}
    assert set(after) == set(before) - leaks
    before, after = held["secrets"]
    mask = lambda t: re.sub(r'(?i)(token = ")[0-9a-f]{40}"', r'\1[secret]"', t)
    assert {k: r["text"] for k, r in after.items()} == {k: mask(r["text"]) for k, r in before.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in after.values())
    before, after = held["bpe"]
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path())
    assert {k: r["ids"] for k, r in after.items()} == {k: library.encode(r["text"], add_special_tokens=False).ids for k, r in before.items()}
    assert all(r["same_text"] and r["n_tokens"] == len(r["ids"]) for r in after.values())


def test_run_equals_the_stages(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert out.count() > 0 and out.filter("NOT same_text").count() == 0


def test_odd_rows(spark, odd, empty, tmp_path):
    labels = spark.createDataFrame([(1, 0), (6, 0)], "doc_id long, toxic int")
    items = spark.createDataFrame([(1, "w30 w31 w32 w33 w34 q")], "item_id long, text string")
    for rows, n in ((odd, 7), (empty, 0)):
        folder = str(tmp_path / str(n))
        rows.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        items.write.parquet(f"{folder}/benchmark.parquet")
        assert corpus_pipeline.run(spark, folder).count() == n
    assert bpe.tokenized(empty, queries.tokenizer_path(), ["doc_id"]).count() == 0
