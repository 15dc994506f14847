"""Constraints as queries: every rule gives findings ``code, severity, scope, locator, detail``; none means it holds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FINDING = "code string, severity string, scope string, locator string, detail string"


def findings(rows: DataFrame, code: str, scope: str, locator: Column, detail: Column | None = None, severity: str = "error") -> DataFrame:
    return rows.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(scope).alias("scope"), locator.cast("string").alias("locator"), (detail if detail is not None else F.lit(None)).cast("string").alias("detail"))


def union(*found: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), found)


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def missing_and_extra(expected: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Set equality both ways: ``keys, side`` (missing or extra)."""
    e, o = expected.select(*keys).distinct(), observed.select(*keys).distinct()
    return e.join(o, keys, "left_anti").withColumn("side", F.lit("missing")).unionByName(o.join(e, keys, "left_anti").withColumn("side", F.lit("extra")))


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose key no parent has (null keys included)."""
    return child.join(parent.select(F.col(parent_key).alias("_p")).distinct(), F.col(key) == F.col("_p"), "left_anti")


def balance(df: DataFrame, keys: list[str], dimensions: list[str]) -> DataFrame:
    """Counts by ``keys`` and each value of each dimension, in one pass: ``keys, dimension, level, n``."""
    parts = F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("level")) for d in dimensions)))
    return df.select(*keys, parts.alias("_d")).select(*keys, "_d.dimension", "_d.level").groupBy(*keys, "dimension", "level").agg(F.count(F.lit(1)).alias("n"))




def concentration(df: DataFrame, key: str, group: str) -> DataFrame:
    """Largest share that one group has of each key's rows."""
    per = df.groupBy(key, group).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(key).agg(F.max("n").alias("largest"), F.sum("n").alias("total")).withColumn("share", F.round(F.col("largest") / F.col("total"), 6))


def support(df: DataFrame, key: str, unit: str, least: int) -> DataFrame:
    """Keys that fewer than ``least`` distinct units have."""
    return df.groupBy(key).agg(F.countDistinct(unit).alias("units")).filter(F.col("units") < least)


def spectrum(df: DataFrame, key: str) -> DataFrame:
    """The distinct group sizes, and how many groups have each."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("groups"))


def cooccurrence(df: DataFrame, key: str, item: str) -> DataFrame:
    """Pairs of items of the same key, with the number of keys: pairs come from a key's own distinct items."""
    sets = df.groupBy(key).agg(F.array_sort(F.collect_set(item)).alias("items"))
    pairs = F.flatten(F.transform("items", lambda a: F.transform(F.filter("items", lambda b: b > a), lambda b: F.struct(a.alias("item_a"), b.alias("item_b")))))
    return sets.select(F.inline(pairs)).groupBy("item_a", "item_b").agg(F.count(F.lit(1)).alias("keys"))


def summary(found: DataFrame) -> DataFrame:
    return found.groupBy("severity", "code").agg(F.count(F.lit(1)).alias("n"))


def assert_none(found: DataFrame, limit: int = 20) -> None:
    """Raises with every code and the first findings."""
    some = found.limit(limit).collect()
    if some:
        raise ValueError("; ".join(f"{r['code']} at {r['locator']}: {r['detail']}" for r in some))
