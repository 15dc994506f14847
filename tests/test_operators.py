"""Hand-computed expectations of single operators."""

import hashlib
import json
import zipfile

import numpy as np
import pytest
from helpers import rows_of
from pyspark.sql import functions as F

from quillwork.functions import hashing as H
from quillwork.functions import text as T
from quillwork.operators import agreement, blocks, callog, checks, estimate, sampling, scoring
from quillwork.sources import readers, sinks


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(expr.alias("x")).first()["x"]


def test_movement_and_ties(spark):
    rows = [(1.0, 0.0, 0.0, 2.0, "B"), (0.0, 1.0, 0.5, 0.5, "A"), (0.25, 0.0, 1.0, 0.0, "B")]
    got = scoring.score_movement(spark.createDataFrame(rows, "logit_a double, logit_b double, after_a double, after_b double, counter_target_label string")).collect()
    assert [(r["m_before"], r["m_after"], r["movement"], r["final_label"], r["flip"], r["initial_near_tie"], r["post_exact_tie"]) for r in got] == [(-1.0, 2.0, 3.0, "B", True, False, False), (-1.0, 0.0, 1.0, None, None, False, True), (-0.25, -1.0, -0.75, "A", False, True, False)]


def test_score_problems(spark):
    rows = [(float("nan"), 0.0, 0.0, 1.0, "A"), (1.0, 1.0, 0.0, 1.0, "A"), (1.0, 0.0, 0.0, 1.0, "A"), (1.0, 0.0, 0.0, 1.0, None), (1.0, 0.0, 0.0, 1.0, "B")]
    got = scoring.score_problems(spark.createDataFrame(rows, "logit_a double, logit_b double, after_a double, after_b double, counter_target_label string"))
    assert [r["problem"] for r in got.collect()] == ["a logit is not finite", "exact tie at the initial reading", "the counter target does not oppose the initial argmax", "the counter target is neither A nor B"]


def scores(spark, flips=(True, None, False, False, True, None)):
    cells = [("RS", "f1", "m1", 1.0), ("RS", "f2", "m2", 3.0), ("NS", "f1", "m1", 5.0), ("NS", "f2", "m2", 6.0), ("RP", "none", "none", 0.5), ("NP", "none", "none", 0.25)]
    rows = [("r", 1, "p1", 7, "d", "o1", "opt_1", -0.5, *c, f) for c, f in zip(cells, flips)]
    return spark.createDataFrame(rows, "run string, initial_id long, opening_id string, decision_id long, domain string, order_id string, initial_option string, m_before double, condition string, marker_family string, marker_id string, movement double, flip boolean")


def test_block_cells_and_contrasts(spark):
    b = blocks.build_blocks(scores(spark))
    r = b.first()
    assert (r["mov_RS"], r["mov_NS"], r["mov_RP"], r["mov_NP"]) == (2.0, 5.5, 0.5, 0.25)
    assert (r["flip_RS"], r["flip_NS"], r["flip_RP"], r["flip_NP"]) == (1.0, 0.0, 1.0, None)
    v = {(x["outcome"], x["quantity"]): (x["value"], x["n_movement_rows"], x["n_flip_rows"]) for x in blocks.values(b).collect()}
    assert v["movement", "NS_minus_NP"] == (5.25, 3, 0)
    assert v["movement", "interaction"] == (-3.75, 6, 0)
    assert v["flip", "RS_minus_NS"] == (1.0, 4, 3)
    assert ("flip", "NS_minus_NP") not in v
    assert blocks.block_problems(b).count() == 0
    assert blocks.block_problems(blocks.build_blocks(scores(spark).filter("condition <> 'RP'"))).count() == 1
    m = {(x["marker_id"], x["quantity"]): x["value"] for x in blocks.marker_values(b).collect()}
    assert m["m1", "NS_minus_NP"] == 4.75 and m["m2", "interaction"] == 2.5 - 5.75


def test_decision_mean_is_no_pooled_mean(spark):
    v = spark.createDataFrame([("q", 1, "d", 1.0), ("q", 2, "d", 4.0), ("q", 2, "d", 4.0), ("q", 2, "d", 4.0)], "k string, decision_id long, domain string, value double")
    assert estimate.plain_means(v, ["k"]).first()["estimate"] == 2.5


def test_holm(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "name string, p_boot double").withColumn("f", F.lit(1))
    got = {r["name"]: round(r["p_holm"], 12) for r in estimate.holm(df, ["f"], "name").collect()}
    assert got == {"a": 0.03, "b": 0.06, "c": 0.06}
    with pytest.raises(Exception, match="undefined p-value"):
        estimate.holm(df.withColumn("p_boot", F.lit(None).cast("double")), ["f"], "name").collect()


def test_slope(spark):
    v = spark.createDataFrame([("k", d, float(x), 2.0 * x + 1) for d in range(4) for x in range(d + 1, d + 4)], "k string, decision_id int, x double, value double")
    r = estimate.wls_slope(v, ["k"], F.col("x")).first()
    assert (r["slope"], r["n_blocks"], r["n_decisions"]) == (2.0, 12, 4)


def test_kernel_against_plain_numpy(spark):
    rng = np.random.default_rng(1)
    values = [(f"d{i}", "xy"[i % 2], float(v)) for i, v in enumerate(rng.normal(0.3, 1, 10))]
    per = spark.createDataFrame([("s", *v) for v in values], "k string, decision_id string, domain string, decision_value double")
    r = estimate.kernel_summaries(per, ["k"], replicates=200, seed=9).first()
    gen, draws = np.random.Generator(np.random.PCG64(9)), []
    for domain in "xy":
        own = np.array([v for _, d, v in sorted(values) if d == domain])
        draws.append(own[gen.integers(0, len(own), size=(200, len(own)))])
    reps = np.concatenate(draws, 1).mean(1)
    assert r["estimate"] == pytest.approx(np.mean([v for *_, v in values]))
    assert (r["ci_low"], r["ci_high"]) == pytest.approx(tuple(np.quantile(reps, [0.025, 0.975])))
    assert r["p_boot"] == pytest.approx(min(1, 2 * min(((reps <= 0).sum() + 1) / 201, ((reps >= 0).sum() + 1) / 201)))


def test_identical_estimates_differ_by_zero(spark):
    a = spark.createDataFrame([("q", 1.5), ("r", -2.0)], "k string, estimate double")
    assert rows_of(estimate.difference(a, a, ["k"])) == [("q", 0.0), ("r", 0.0)]


def test_text_functions(spark):
    assert one(spark, T.words(F.lit("It's a well-known x2, no?"))) == ["It's", "a", "well-known", "x2", "no"]
    assert one(spark, T.phrase_count(F.lit("Thus, thus thusly THUS."), "thus")) == 3
    assert one(spark, T.strip_once(F.lit("ab  We  should go. Ab"), F.lit("we should  go."))) == "ab   ab"
    assert one(spark, T.containment(F.lit("rain rain rain snow"), F.lit("rain"))) == 0.75
    assert one(spark, T.containment(F.lit("rain frame"), F.lit("rain"), ignore=("frame",))) == 1.0
    assert one(spark, T.less_words(F.array(*map(F.lit, "abcab")), F.array(*map(F.lit, "bzb")))) == ["a", "c", "a"]
    assert one(spark, T.contains_phrase(F.lit("Thus-far"), F.lit("thus"))) and not one(spark, T.contains_phrase(F.lit("thusly"), F.lit("thus")))
    runs = T.shared_runs(spark.createDataFrame([(1, "a b c d e f"), (2, "a b c x c d e")], "k int, text string"), spark.createDataFrame([("a b c",), ("c d e",)], "text string"), "k", "text", 3)
    assert rows_of(runs) == [(1, 0, 5, "a b c d e"), (2, 0, 3, "a b c"), (2, 4, 3, "c d e")]
    assert one(spark, T.ngrams(F.array(*map(F.lit, "abcd")), 3)) == ["a b c", "b c d"]
    assert one(spark, T.ngrams(F.array(F.lit("a")), 3)) == []
    assert one(spark, T.embedded_option(F.lit("Keep the tax."))) == "keep the tax"
    assert one(spark, T.sentences(F.lit("Dr. Roe left. She (e.g. Ann) stayed! Why? No."))) == ["Dr. Roe left.", "She (e.g. Ann) stayed!", "Why?", "No."]
    assert one(spark, T.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c")))) == 0.333
    assert one(spark, T.unhighlighted(T.highlighted(F.lit("Thus it is"), "thus"))) == "Thus it is"
    assert one(spark, T.redacted(F.lit("Bearer abc.def and sk-0123456789"))) == "Bearer [redacted] and [redacted]"


def test_near_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    sets = [sorted({int(x) for x in rng.integers(0, 14, rng.integers(1, 9))}) for _ in range(40)]
    df = spark.createDataFrame([(i, [str(x) for x in s]) for i, s in enumerate(sets)], "id int, tokens array<string>")
    want = {(i, j) for i in range(40) for j in range(i + 1, 40) if len(set(sets[i]) & set(sets[j])) / len(set(sets[i]) | set(sets[j])) >= 0.6}
    assert {(r["key_a"], r["key_b"]) for r in T.near_pairs(df, "id", "tokens", 0.6).collect()} == want


def test_canonical_json_and_hashes(spark):
    row = {"b": "é", "a": None, "c": 1}
    df = spark.createDataFrame([("é", None, 1)], "b string, a string, c int")
    assert df.select(H.canonical_json({k: F.col(k) for k in "abc"}).alias("x")).first()["x"] == H.canonical(row)
    content = spark.createDataFrame([(bytearray(b"hello\n"),)], "c binary")
    assert content.select(H.git_blob_sha1(F.col("c")).alias("x")).first()["x"] == sinks.provider_digest(b"hello\n", "git-blob") == "ce013625030ba8dba906f756967f9e9ca394464a"


def test_log_folds(spark):
    log = spark.createDataFrame([("k", 1, "x", False), ("k", 2, "y", True), ("k", 3, "z", True), ("m", 1, "x", False), ("m", 2, "w", False)], "key string, seq int, body string, ok boolean")
    assert rows_of(callog.latest_accepted(log, ["key"], ["seq"], "ok").select("key", "body")) == [("k", "y"), ("m", "w")]
    done, stale = callog.overlay(spark.createDataFrame([("a", "t", "h1"), ("b", "u", "h2")], "key string, v string, h string"), spark.createDataFrame([("a", "T", "h1"), ("b", "U", "old")], "key string, v string, h string"), "key", "v", "h")
    assert rows_of(done.select("key", "v", "corrected")) == [("a", "T", True), ("b", "u", False)] and rows_of(stale.select("key")) == [("b",)]


def test_constraints(spark):
    a, b = spark.createDataFrame([(1,), (2,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    assert rows_of(checks.missing_and_extra(a, b, ["k"])) == [(1, "missing"), (3, "extra")]
    assert rows_of(checks.duplicates(a, ["k"])) == [(2, 2)]
    with pytest.raises(ValueError, match="twice at 2"):
        checks.assert_none(checks.findings(checks.duplicates(a, ["k"]), "twice", "row", F.col("k")))


def test_agreement(spark):
    df = spark.createDataFrame([(1, 1)] * 20 + [(1, 0)] * 5 + [(0, 1)] * 10 + [(0, 0)] * 15, "a int, b int")
    assert agreement.kappa(df, "a", "b").first()["kappa"] == 0.4
    ratings = spark.createDataFrame([(u, v) for u, vs in enumerate([(1, 1), (2, 3), (3, 3), (4,)]) for v in vs], "u int, v int")
    values = [1, 1, 2, 3, 3, 3]
    expected = sum((x - y) ** 2 for i, x in enumerate(values) for j, y in enumerate(values) if i != j) / 30
    assert agreement.alpha(ratings, "u", "v").first()["alpha"] == round(1 - (2 / 6) / expected, 6)


def test_separation_and_quotas(spark):
    state, order = sampling.separated_order({"a": 3, "b": 2, "c": 2}, 3, 1, tries=0)
    assert state == "search" and all(order[i] != order[j] for i in range(7) for j in range(i + 1, min(7, i + 3)))
    assert sampling.separated_order({"a": 3, "b": 1}, 3, 1)[0] == "infeasible"
    counts = spark.createDataFrame([("a", 5), ("b", 5), ("c", 5)], "s string, n long")
    assert [r["quota"] for r in sampling.largest_remainder(counts, "s", "n", 1, 2).orderBy("s").collect()] == [3, 3, 2]


def test_scans(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": 1, "x": 0.5}\n\n{"k": 2, "x": null}\n{"k": oops\n')
    bad = readers.jsonl_problems(spark, str(tmp_path / "a.jsonl"), "k int, x double").collect()
    assert [(r["line"], r["text"]) for r in bad] == [(4, '{"k": oops')]
    with pytest.raises(Exception):
        readers.jsonl(spark, str(tmp_path / "a.jsonl"), "k int, x double").collect()
    assert readers.optional_jsonl(spark, str(tmp_path / "none.jsonl"), "k int").count() == 0
    (tmp_path / "b.csv").write_text("﻿Art;Note\n 1  A;x\n1 a;\n", encoding="utf-8")
    assert rows_of(readers.value_sets(spark, str(tmp_path / "b.csv"))) == [("Art", "1 a"), ("Note", "x")]
    tokens = spark.createDataFrame([("d", 0, 0, 2, "ab"), ("d", 1, 2, 3, "."), ("d", 2, 4, 6, "cd")], "k string, pos int, start int, stop int, token string")
    assert readers.tokens_to_text(tokens, "k", "pos", "start", "stop", "token").first()["text"] == "ab. cd"
    r = readers.responses(spark.createDataFrame([('{"a": " x ", "b": "y"}',), ('{"a": "x"}',), ('{"a": "x", "b": 1}',), ('{"a": "", "b": "y"}',), ("[]",)], "raw string"), "raw", ["a", "b"]).collect()
    assert [x["problem"] for x in r] == [None, "missing keys", "not a string", "blank value", "not an object"] and r[0]["response"] == {"a": "x", "b": "y"}


def test_sinks(spark, tmp_path):
    assert sinks.csv_text([{"a": 1e-05, "b": None}, {"a": float("nan"), "c": "x"}]) == "a,b,c\n1e-05,,\n,,x\n"
    assert sinks.gzip_bytes("x") == sinks.gzip_bytes("x")
    df = spark.createDataFrame([(1, 1e-05), (2, 123456789.0)], "k int, x double")
    assert [json.loads(r["line"]) for r in sinks.canonical_lines(df).collect()] == [{"k": 1, "x": 1e-05}, {"k": 2, "x": 123456789.0}]
    target = str(tmp_path / "out")
    out = sinks.Release(spark, target, "v1")
    out.table("t", df.repartition(4), ["k"])
    out.publish({"tables/t.csv"})
    assert (tmp_path / "out/tables/t.csv").read_text() == "k,x\n1,1e-05\n2,123456789.0\n"
    assert sorted(p.name for p in tmp_path.iterdir()) == ["out"] and sinks.audit(spark, target).count() == 0
    (tmp_path / "out/tables/t.csv").write_text("changed")
    (tmp_path / "out/more.txt").write_text("x")
    assert rows_of(sinks.audit(spark, target)) == [("more.txt", "unlisted"), ("tables/t.csv", "changed")]
    (tmp_path / "out/manifest.json").write_text((tmp_path / "out/manifest.json").read_text() + " ")
    assert ("manifest.json", "changed") in rows_of(sinks.audit(spark, target))
    for version, replace in (("v2", True), ("v1", False)):
        again = sinks.Release(spark, target, version)
        again.add("a.txt", "new")
        with pytest.raises(ValueError):
            again.publish(replace=replace)
    again = sinks.Release(spark, target, "v1")
    again.add("a.txt", "new")
    with pytest.raises(ValueError):
        again.publish({"b.txt"}, replace=True)
    again.publish(replace=True)
    assert rows_of(sinks.audit(spark, target)) == [] and (tmp_path / "out/a.txt").read_text() == "new" and not (tmp_path / "out/tables").exists()
    with pytest.raises(ValueError):
        sinks.Release(spark, f"{target}/x", "v1", keep_out=(target,))


def test_archives(tmp_path):
    at = str(tmp_path / "a.zip")
    with zipfile.ZipFile(at, "w") as z:
        z.writestr("d/x.txt", "x")
        z.writestr("y.pkl", "y")
    assert sinks.extract(at, str(tmp_path / "to")) == ["d/x.txt"] and (tmp_path / "to/d/x.txt").read_text() == "x"
    for name in ("../x", "/x", "d/../../x", "c:x"):
        with zipfile.ZipFile(at, "w") as z:
            z.writestr("fine", "x")
            z.writestr(name, "x")
        with pytest.raises(ValueError):
            sinks.extract(at, str(tmp_path / "bad"))
    assert not (tmp_path / "bad").exists()
    assert sinks.verify_bytes(b"x", 1, "none", "") == hashlib.sha256(b"x").hexdigest()
    with pytest.raises(ValueError):
        sinks.verify_bytes(b"x", 2, "md5", "9dd4e461268c8034f5c8564e155c67a6")
