"""Recorded rows against another computation of them."""

from helpers import DATA
from pyspark.sql import functions as F

from quillwork.plans import outcomes as O
from quillwork.plans.queries import QUERIES


def test_a_wrong_score_is_found(spark, monkeypatch):
    right = O.scores
    monkeypatch.setattr(O, "scores", lambda spark, sf_dir: right(spark, sf_dir).withColumn("movement", F.when(F.col("initial_id") == 1, 99.0).otherwise(F.col("movement"))))
    assert QUERIES["rescoring_mismatches"](spark, DATA).agg(F.collect_set("initial_id")).first()[0] == [1]


def test_planted_differences_are_found(spark):
    kinds = {r["mismatched"] for r in QUERIES["rescoring_planted"](spark, DATA).select("mismatched").distinct().collect()}
    assert kinds == {"absent", "m_after,movement", "final_label", "flip"}
