"""Cluster-weighted estimates, the stratified bootstrap, Holm adjustment and weighted slopes.

A statistic is the mean over decisions of the mean over a decision's blocks.  A bootstrap replicate draws decisions with
replacement within each domain, so it is a mean over decisions weighted by how often each was drawn; only the counts
matter and block rows are never resampled.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillwork.operators import draws

DIGITS = 6


def decision_means(per: DataFrame, keys: list[str], digits: int = DIGITS) -> DataFrame:
    """Point estimates with denominators from values per decision.  An initial belongs to one decision, so its counts add up."""
    return per.groupBy(*keys).agg(
        F.round(F.avg("decision_value"), digits).alias("estimate"),
        F.sum("blocks").alias("n_blocks"),
        F.sum("movement_rows").alias("n_movement_rows"),
        F.sum("flip_rows").alias("n_flip_rows"),
        F.count(F.lit(1)).alias("n_decisions"),
        F.sum("initials").alias("n_initials"),
    )


def plain_means(values: DataFrame, keys: list[str], digits: int = DIGITS) -> DataFrame:
    """Point estimates alone (for values without row counts)."""
    per = values.groupBy(*keys, "decision_id").agg(F.avg("value").alias("v"), F.count(F.lit(1)).alias("n"))
    return per.groupBy(*keys).agg(F.round(F.avg("v"), digits).alias("estimate"), F.sum("n").alias("n_blocks"), F.count(F.lit(1)).alias("n_decisions"))


def ordered_mean(per_decision: DataFrame, keys: list[str], value: str = "decision_value") -> DataFrame:
    """A mean whose additions run in decision order, so its last bits do not depend on the partitioning."""
    rows = F.array_sort(F.collect_list(F.struct("decision_id", F.col(value).alias("v"))))
    out = per_decision.groupBy(*keys).agg(rows.alias("rows"))
    return out.withColumn("estimate", F.aggregate("rows", F.lit(0.0), lambda a, x: a + x["v"]) / F.size("rows")).drop("rows")


def difference(left: DataFrame, right: DataFrame, on: list[str], value: str = "estimate", digits: int = DIGITS) -> DataFrame:
    """``left`` minus ``right`` of the same statistic."""
    b = right.select(*on, F.col(value).alias("_other"))
    return left.select(*on, value).join(b, on).select(*on, F.round(F.col(value) - F.col("_other"), digits).alias("difference"))


# -- draws ---------------------------------------------------------------------------------------------------------

def hash_draws(decisions: DataFrame, replicates: int, seed: int) -> DataFrame:
    """``replicate, decision_id, domain, weight``: draws by md5, the same in any engine and partitioning.

    Draw number p of a replicate takes the decision at place md5(seed|domain|replicate|p) mod n of its domain."""
    return draws.counts(decisions, replicates, seed)


def replicate_estimates(per_decision: DataFrame, decisions: DataFrame, replicates: int, seed: int, keys: list[str]) -> DataFrame:
    """Weighted mean of each replicate of ``hash_draws`` over the decisions with a value; a replicate without weight is left out."""
    return draws.estimates(per_decision, decisions, replicates, seed, keys)


def summarise(replicates: DataFrame, keys: list[str], level: float = 0.95, digits: int = DIGITS) -> DataFrame:
    """Percentile interval and two-sided bootstrap p with inclusive tails; rounded before counting signs.

    A limit between two rounded numbers is often halfway between numbers of as many digits, so its last bits decide: it is
    interpolated and rounded as DuckDB does, with one rounding of lower * (1 - d) + (upper * d)."""
    v = F.round(F.col("replicate_estimate"), digits)
    tail = round((1 - level) / 2, 12)
    low, high, n = F.sum((v <= 0).cast("long")), F.sum((v >= 0).cast("long")), F.count(F.lit(1))
    p = F.round(F.least(F.lit(1.0), 2.0 * F.least((low + 1) / (n + 1), (high + 1) / (n + 1))), digits)
    ranked = replicates.groupBy(*keys).agg(F.sort_array(F.collect_list(v)).alias("_ranked"), n.alias("replicates_defined"), p.alias("p_boot"))

    @F.udf("double")
    def interpolated(lower, upper, d):
        return math.fma(lower, 1 - d, upper * d)

    def limit(q: float) -> Column:
        place = (F.col("replicates_defined") - 1) * F.lit(q)
        lower, upper = F.get("_ranked", F.floor(place).cast("int")), F.get("_ranked", F.ceil(place).cast("int"))
        # a product rounded to a whole number, not the shortest decimal of the quotient: halves that are not quite halves stay so
        return F.round(interpolated(lower, upper, place - F.floor(place)) * 10**digits, 0) / 10**digits

    return ranked.select(*keys, limit(tail).alias("ci_low"), limit(round(1 - tail, 12)).alias("ci_high"), "replicates_defined", "p_boot")


def stratified_counts(decisions: list[tuple[str, str]], replicates: int, seed: int) -> tuple[list[str], np.ndarray]:
    """Decisions in order, and how often each replicate draws each (decisions x replicates), by PCG64.

    One block of draws for each domain, domains in order."""
    ids = sorted(d for d, _ in decisions)
    at, rng = {d: i for i, d in enumerate(ids)}, np.random.Generator(np.random.PCG64(seed))
    counts = np.zeros((len(ids), replicates))
    for domain in sorted({x for _, x in decisions}):
        mine = np.array([at[d] for d in sorted(d for d, x in decisions if x == domain)])
        drawn = mine[rng.integers(0, len(mine), size=(replicates, len(mine)))]
        for r in range(replicates):
            np.add.at(counts[:, r], drawn[r], 1)
    return ids, counts


def kernel_summaries(per_decision: DataFrame, keys: list[str], replicates: int = 9999, seed: int = 20261005, level: float = 0.95) -> DataFrame:
    """``estimate, ci_low, ci_high, p_boot, replicates_defined`` of each statistic by the grouped kernel.

    The design's decisions are few by construction (dozens), so their count matrix is broadcast; sums run in decision
    order, which fixes their last bits."""
    found = [(r["decision_id"], r["domain"]) for r in per_decision.select("decision_id", "domain").distinct().collect()]
    ids, counts = stratified_counts(found, replicates, seed)
    if counts.nbytes > 64 << 20:
        raise ValueError("too many decisions for the kernel; use hash_draws or replicate_estimates")
    sent = per_decision.sparkSession.sparkContext.broadcast(({d: i for i, d in enumerate(ids)}, counts))
    kinds = {f.name: f.dataType.simpleString() for f in per_decision.schema.fields}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "estimate double, ci_low double, ci_high double, p_boot double, replicates_defined long"])

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        at, weight = sent.value
        rows = rows.sort_values("decision_id")
        where, v = rows["decision_id"].map(at).to_numpy(), rows["decision_value"].to_numpy()
        total, mass = np.zeros(weight.shape[1]), np.zeros(weight.shape[1])
        for i, x in zip(where, v):
            total += weight[i] * x
            mass += weight[i]
        reps = total[mass > 0] / mass[mass > 0]
        n = len(reps)
        lo, hi = np.quantile(reps, [(1 - level) / 2, (1 + level) / 2]) if n else (np.nan, np.nan)
        p = min(1.0, 2 * min(((reps <= 0).sum() + 1) / (n + 1), ((reps >= 0).sum() + 1) / (n + 1))) if n else np.nan
        return pd.DataFrame([[*key, float(v.mean()), float(lo), float(hi), p, n]], columns=[*keys, "estimate", "ci_low", "ci_high", "p_boot", "replicates_defined"])

    return per_decision.groupBy(*keys).applyInPandas(run, schema)


def holm(df: DataFrame, family: list[str], key: str, p: str = "p_boot") -> DataFrame:
    """Step-down adjustment within each family; ties are ordered by ``key``; an undefined p refuses the family."""
    order = Window.partitionBy(*family).orderBy(p, key)
    whole = Window.partitionBy(*family)
    stepped = df.withColumn("_i", F.row_number().over(order) - 1).withColumn("family_size", F.count(F.lit(1)).over(whole))
    refused = F.when(F.col(p).isNull() | F.isnan(p), F.raise_error(F.lit("cannot adjust an undefined p-value")).cast("double"))
    own = F.coalesce(refused, F.least(F.lit(1.0), (F.col("family_size") - F.col("_i")) * F.col(p)))
    return stepped.withColumn("p_holm", F.max(own).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_i")


def wls_slope(values: DataFrame, keys: list[str], x: Column, digits: int = DIGITS) -> DataFrame:
    """Slope and mean of ``value`` on ``x``, each block weighted by one over its decision's blocks, from five sums."""
    v = F.col("value")
    per = values.withColumn("_x", x).groupBy(*keys, "decision_id").agg(F.avg("_x").alias("sx"), F.avg(v).alias("sy"), F.avg(F.col("_x") * F.col("_x")).alias("sxx"), F.avg(F.col("_x") * v).alias("sxy"), F.count(F.lit(1)).alias("n"))
    s = per.groupBy(*keys).agg(F.count(F.lit(1)).alias("s0"), *(F.sum(c).alias(c) for c in ("sx", "sy", "sxx", "sxy")), F.sum("n").alias("n_blocks"))
    slope = (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("s0")) / F.nullif(F.col("sxx") - F.col("sx") * F.col("sx") / F.col("s0"), F.lit(0.0))
    return s.select(*keys, F.round(slope, digits).alias("slope"), F.round(F.col("sy") / F.col("s0"), digits).alias("mean"), "n_blocks", F.col("s0").alias("n_decisions"))
