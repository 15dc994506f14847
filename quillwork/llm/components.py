"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwork.llm import common


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node with an edge (columns ``a``, ``b``, longs); ``root`` is the least of its component.

    Each round is written to the shared folder; the number of rounds grows with the logarithm of the longest path.
    Loops and repeated edges are allowed; no edges give no rows."""
    star = common.stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        mark = star.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == before or not mark["n"]:
            return star.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(star.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = mark
        both = star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, F.col("a") == F.col("u")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        own = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        near = large.join(own, F.col("a") == F.col("u")).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        star = common.stored(near.unionByName(own.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), "edges")
