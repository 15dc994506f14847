"""Before/after readings: argmax, ties, movement toward the counter-target, flips."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Near-tie bound: the logit of probability 0.6.
TAU = math.log(0.6 / 0.4)


def argmax_label(a: Column, b: Column) -> Column:
    """``A`` or ``B``; null on an exact tie, with no tolerance."""
    return F.when(a == b, F.lit(None)).when(a > b, "A").otherwise("B")


def opposite_label(label: Column) -> Column:
    return F.when(label == "A", "B").when(label == "B", "A")


def opposite_option(option: Column) -> Column:
    return F.when(option == "opt_1", "opt_2").when(option == "opt_2", "opt_1")


def option_of(label: Column, order_id: Column) -> Column:
    """The semantic option behind a display label: under ``o1`` A shows opt_1, under ``o2`` it shows opt_2."""
    first = F.when(order_id == "o1", "opt_1").when(order_id == "o2", "opt_2")
    return F.when(label == "A", first).when(label == "B", opposite_option(first))


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def score_movement(df: DataFrame, tau: float = TAU) -> DataFrame:
    """Adds the outcome columns to rows with ``logit_a, logit_b, after_a, after_b, counter_target_label``.

    A final label and a flip are null on an exact post tie; movement never is."""
    a, b = F.col("after_a"), F.col("after_b")
    toward = lambda x, y: F.when(F.col("counter_target_label") == "A", x - y).otherwise(y - x)
    out = df.withColumn("initial_label", argmax_label(F.col("logit_a"), F.col("logit_b")))
    out = out.withColumn("m_before", toward(F.col("logit_a"), F.col("logit_b"))).withColumn("m_after", toward(a, b))
    out = out.withColumn("movement", F.col("m_after") - F.col("m_before")).withColumn("final_label", argmax_label(a, b))
    return out.withColumn("flip", F.col("final_label") == F.col("counter_target_label")).withColumn("initial_near_tie", F.abs("m_before") < F.lit(tau)).withColumn("post_exact_tie", a == b)


def score_problems(df: DataFrame) -> DataFrame:
    """Rows that scoring refuses, with the first reason."""
    first = argmax_label(F.col("logit_a"), F.col("logit_b"))
    why = (
        F.when(~(finite(F.col("logit_a")) & finite(F.col("logit_b")) & finite(F.col("after_a")) & finite(F.col("after_b"))), "a logit is not finite")
        .when(~F.coalesce(F.col("counter_target_label").isin("A", "B"), F.lit(False)), "the counter target is neither A nor B")
        .when(first.isNull(), "exact tie at the initial reading")
        .when(first == F.col("counter_target_label"), "the counter target does not oppose the initial argmax")
    )
    return df.withColumn("problem", why).filter(F.col("problem").isNotNull())


def runtime_selection(initials: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates whose required label is the initial argmax, and the excluded (tied) initials.

    An initial tie leaves no candidate rows at all."""
    seen = initials.withColumn("initial_label", argmax_label(F.col("logit_a"), F.col("logit_b")))
    labels = seen.filter(F.col("initial_label").isNotNull()).select("run", "initial_id", F.col("initial_label").alias("required_label"))
    chosen = candidates.join(labels, ["run", "initial_id", "required_label"], "left_semi")
    return chosen, seen.filter(F.col("initial_label").isNull()).withColumn("exclusion_reason", F.lit("exact_initial_tie"))


def movement_rows(scores: DataFrame) -> DataFrame:
    return scores


def flip_rows(scores: DataFrame) -> DataFrame:
    """Rows with a defined flip: a post tie leaves flip rates only."""
    return scores.filter(~F.col("post_exact_tie"))


def completion_label(initial_ties: Column, post_ties: Column) -> Column:
    """How a finished run is labelled, by the kinds of tie it recorded (fixed values)."""
    return (
        F.when((initial_ties > 0) & (post_ties > 0), "complete_with_recorded_exclusions_and_secondary_ties")
        .when(initial_ties > 0, "complete_with_recorded_exclusions")
        .when(post_ties > 0, "complete_with_recorded_secondary_ties")
        .otherwise("complete")
    )


def tie_counts(initials: DataFrame, scores: DataFrame) -> DataFrame:
    """Per run: readings, exact initial ties, scored rows, exact post ties, percents, completion."""
    a = initials.groupBy("run").agg(F.count(F.lit(1)).alias("initial_readings"), F.sum((F.col("logit_a") == F.col("logit_b")).cast("long")).alias("initial_ties"))
    b = scores.groupBy("run").agg(F.count(F.lit(1)).alias("score_rows"), F.sum(F.col("post_exact_tie").cast("long")).alias("post_ties"))
    out = a.join(b, "run", "left").withColumn("initial_ties_pct", F.round(100.0 * F.col("initial_ties") / F.col("initial_readings"), 6)).withColumn("post_ties_pct", F.round(100.0 * F.col("post_ties") / F.col("score_rows"), 6))
    return out.withColumn("completion", completion_label(F.col("initial_ties"), F.col("post_ties")))


def rescoring_mismatches(recorded: DataFrame, recomputed: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Per recorded row the fields that differ from their recomputation (bitwise, null equals null), if any."""
    other = recomputed.select(*keys, *(F.col(f).alias(f"_again_{f}") for f in fields), F.lit(True).alias("_found"))
    both = recorded.select(*keys, *fields).join(other, keys, "left")
    wrong = F.array_compact(F.array(*(F.when(~F.col(f).eqNullSafe(F.col(f"_again_{f}")), F.lit(f)) for f in fields)))
    return both.withColumn("mismatched", F.when(F.col("_found").isNull(), F.array(F.lit("absent"))).otherwise(wrong)).filter(F.size("mismatched") > 0).select(*keys, "mismatched")
