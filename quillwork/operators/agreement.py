"""Agreement of codings: percent, Cohen's kappa, prevalence, Krippendorff's alpha."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(F.col(a).alias("code_a"), F.col(b).alias("code_b")).agg(F.count(F.lit(1)).alias("n"))


def kappa(df: DataFrame, a: str, b: str, digits: int = 6) -> DataFrame:
    """One row: units, observed agreement, chance agreement, kappa (null without variation)."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    s = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.avg((x == y).cast("double")).alias("po"), F.avg(x).alias("pa"), F.avg(y).alias("pb"))
    pe = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    return s.select("n", F.round("po", digits).alias("observed"), F.round(pe, digits).alias("expected"), F.round((F.col("po") - pe) / F.nullif(1 - pe, F.lit(0.0)), digits).alias("kappa"), F.round("pa", digits).alias("prevalence_a"), F.round("pb", digits).alias("prevalence_b"))


def alpha(ratings: DataFrame, unit: str, value: str, digits: int = 6) -> DataFrame:
    """Krippendorff's alpha (interval distance) of long ratings, from per-unit sums: no pairs are made."""
    v = F.col(value).cast("double")
    per = ratings.filter(F.col(value).isNotNull()).groupBy(unit).agg(F.count(F.lit(1)).alias("m"), F.sum(v).alias("s"), F.sum(v * v).alias("q")).filter("m > 1")
    t = per.agg(F.sum("m").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(2 * (F.col("m") * F.col("q") - F.col("s") * F.col("s")) / (F.col("m") - 1)).alias("d"))
    observed = F.col("d") / F.col("n")
    expected = 2 * (F.col("n") * F.col("q") - F.col("s") * F.col("s")) / (F.col("n") * (F.col("n") - 1))
    return t.select(F.col("n").alias("pairable"), F.round(observed, digits).alias("observed"), F.round(expected, digits).alias("expected"), F.round(1 - observed / F.nullif(expected, F.lit(0.0)), digits).alias("alpha"))
