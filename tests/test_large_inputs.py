"""Operators beyond the sizes of the given tables."""

import re

from pyspark.sql import functions as F

from quillwork.operators import allocation, sampling


def test_blind_ids_stay_distinct(spark):
    n = 100_002
    got = sampling.blind_ids(spark.range(n).withColumnRenamed("id", "item_id"), "item_id", "i", 5)
    assert got.agg(F.countDistinct("blind_id")).first()[0] == n
    assert got.agg(F.min("blind_id"), F.max(F.length("blind_id"))).first()[:] == ("i00001", 7)


def test_collisions_of_many_markers(spark):
    texts = [" ".join(f"w{i}" for i in range(1500)), "W7, w8: it's well-known", "", "w7 w7", "—w9 w8"]
    markers = [*(f"w{i}" for i in range(1500)), "W8", "w7 w8", "well-known", "It's Well-known", "w8 w7", "w7 w8 it's", "absent"]
    rows = spark.createDataFrame(list(enumerate(texts)), "scenario_id int, scenario_text string")
    got = allocation.collisions(rows, spark.createDataFrame([(m,) for m in markers + markers[:5]], "marker string"))
    assert sorted(map(tuple, got.collect())) == sorted((i, m) for i, t in enumerate(texts) for m in markers if re.search(rf"(?<![A-Za-z]){re.escape(m)}(?![A-Za-z])", t, re.I))
