"""Folds of an append-only log into current state: latest, accepted, attempts, supersession, overlays, approvals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_accepted(log: DataFrame, keys: list[str], seq: list[str], accepted: str) -> DataFrame:
    """One row per key: the first accepted entry if there is one, else the latest.  An accepted one is never displaced."""
    a = F.col(accepted)
    first = F.min(F.when(a, F.struct(*seq, *[c for c in log.columns if c not in (*keys, *seq)])))
    last = F.max(F.struct(*seq, *[c for c in log.columns if c not in (*keys, *seq)]))
    return log.groupBy(*keys).agg(F.coalesce(first, last).alias("_r")).select(*keys, "_r.*")


def attempts(log: DataFrame, keys: list[str], seq: list[str], body: str, spends: Column) -> DataFrame:
    """Attempt numbers that count only budget-spending entries, and whether the body is that of the entry before."""
    w = Window.partitionBy(*keys).orderBy(*seq)
    return log.withColumn("attempt", F.sum(F.when(spends, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("unchanged", F.coalesce(F.lag(body).over(w) == F.col(body), F.lit(False)))


def fewest_errors_before_last(log: DataFrame, keys: list[str], seq: list[str], errors: str) -> DataFrame:
    """Per key the earlier entry with the fewest errors (then the earliest), where it beats the last one."""
    last = F.max(F.struct(*seq, F.col(errors).alias("e")))
    best = F.min(F.struct(F.col(errors).alias("e"), *seq))
    out = log.groupBy(*keys).agg(last.alias("last"), best.alias("best"))
    return out.filter("best.e < last.e").select(*keys, *(F.col(f"best.{s}").alias(s) for s in seq), F.col("best.e").alias("fewest"), F.col("last.e").alias("last_errors"))


def identical_throughout(log: DataFrame, keys: list[str], body: str) -> DataFrame:
    return log.groupBy(*keys).agg((F.countDistinct(body) == 1).alias("one"), F.count(F.lit(1)).alias("n")).select(*keys, (F.col("one") & (F.col("n") > 1)).alias("identical_throughout"))


def superseded(current: DataFrame, redrafts: DataFrame, key: str, call: str, value: str) -> DataFrame:
    """``current`` with the value of the redraft that names exactly the call it replaces."""
    r = redrafts.select(F.col(key).alias("_k"), F.col("supersedes").alias("_c"), F.col(value).alias("_v"))
    out = current.join(r, (F.col(key) == F.col("_k")) & (F.col(call) == F.col("_c")), "left")
    return out.withColumn("replaced", F.col("_k").isNotNull()).withColumn(value, F.coalesce("_v", value)).drop("_k", "_c", "_v")


def overlay(base: DataFrame, changes: DataFrame, key: str, value: str, guard: str) -> tuple[DataFrame, DataFrame]:
    """Corrections over values; a correction counts only if its guard still matches.  Second: those that do not."""
    c = changes.select(F.col(key).alias("_k"), F.col(guard).alias("_g"), F.col(value).alias("_v"))
    both = base.join(c, F.col(key) == F.col("_k"), "left")
    fits = F.col("_k").isNotNull() & F.col(guard).eqNullSafe(F.col("_g"))
    done = both.withColumn("corrected", F.coalesce(fits, F.lit(False))).withColumn(value, F.when(fits, F.col("_v")).otherwise(F.col(value))).drop("_k", "_g", "_v")
    stale = changes.join(base.select(key, guard), [key, guard], "left_anti")
    return done, stale


def approval_state(rows: DataFrame) -> Column:
    """Ordered rules: machine error, missing, pending, other decision, anonymous, stale, incomplete, approved."""
    c = F.col
    return (
        F.when(c("machine_errors") > 0, "machine_error")
        .when(c("decision").isNull(), "missing")
        .when(c("decision") == "pending", "pending")
        .when(c("decision") != "approved", "not_approved")
        .when(F.coalesce(F.trim("reviewer"), F.lit("")) == "", "anonymous")
        .when(~c("approved_hash").eqNullSafe(c("current_hash")), "stale")
        .when(~F.coalesce(c("complete"), F.lit(False)), "incomplete")
        .otherwise("approved")
    )


def completed(log: DataFrame, key: str, status: str, seq: list[str]) -> DataFrame:
    """The first entry of each call that is no transport failure (failures repeat the call id and spend nothing)."""
    done = log.filter(F.col(status) != "error")
    rest = [c for c in log.columns if c not in (key, *seq)]
    return done.groupBy(key).agg(F.min(F.struct(*seq, *rest)).alias("_r")).select(key, "_r.*")


def funnel(state: DataFrame, by: list[str], flags: dict[str, Column]) -> DataFrame:
    made = [F.sum(F.coalesce(v, F.lit(False)).cast("long")).alias(k) for k, v in flags.items()]
    return state.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), *made)


def next_gate(incomplete: Column, blocked: Column, review: Column, redraft: Column, approved: Column, expected: Column) -> Column:
    """The first open gate, in strict priority."""
    return F.when(incomplete > 0, "incomplete").when(blocked > 0, "blocked").when(review > 0, "needs_review").when(redraft > 0, "redraft").when(approved == expected, "approved").otherwise("incomplete")
