"""Transcripts of one and three turns, their variants, hashes and role checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def option_lines(first: Column, second: Column, labels: tuple[str, str] = ("A", "B")) -> Column:
    return F.concat(F.lit(f"{labels[0]}. "), first, F.lit(f"\n{labels[1]}. "), second)


def render_initial(plan: DataFrame, question: str, cue: str, labels: tuple[str, str] = ("A", "B"), swap_lines: bool = False) -> DataFrame:
    """Adds ``transcript`` (array of role and content) of the first reading; ``o2`` shows the options the other way round."""
    one = F.when(F.col("order_id") == "o1", F.col("opt_1")).otherwise(F.col("opt_2"))
    two = F.when(F.col("order_id") == "o1", F.col("opt_2")).otherwise(F.col("opt_1"))
    if swap_lines:
        lines = F.concat(F.lit(f"{labels[1]}. "), two, F.lit(f"\n{labels[0]}. "), one)
    else:
        lines = option_lines(one, two, labels)
    text = F.concat(F.col("scenario_text"), F.lit(f"\n\n{question}\n"), lines, F.lit(f"\n\n{cue}"))
    return plan.withColumn("transcript", F.array(F.struct(F.lit("user").alias("role"), text.alias("content"))))


def render_branch(initial: DataFrame, cue: str) -> DataFrame:
    """The three-turn transcript: the first turn, the label chosen, then the counterargument; its beginning is shared."""
    last = F.struct(F.lit("user").alias("role"), F.concat(F.col("rendered"), F.lit(f"\n\n{cue}")).alias("content"))
    return initial.withColumn("transcript", F.concat("transcript", F.array(F.struct(F.lit("assistant").alias("role"), F.col("initial_label").alias("content"))), F.array(last)))


def materialised(transcript: Column) -> Column:
    return F.array_join(F.transform(transcript, lambda t: F.concat(t["role"], F.lit(": "), t["content"])), "\n\n")


def prompt_hash(transcript: Column, cue: str) -> Column:
    """SHA-256 of the canonical JSON of cue and turns (no doubles in it)."""
    return F.sha2(F.to_json(F.struct(F.lit(cue).alias("answer_cue"), F.transform(transcript, lambda t: F.struct(t["content"].alias("content"), t["role"].alias("role"))).alias("transcript"))), 256)


def prompt_digest(rows: DataFrame, key: str, mark: str) -> Column:
    """One digest over all prompts in key order; for the design's few thousand rows."""
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, mark))), lambda x: x[mark]), "\n"), 256)


def role_problems(rows: DataFrame, key: str) -> DataFrame:
    """Transcripts that do not begin and end with the user, or repeat a role."""
    t = F.col("transcript")
    same = F.exists(F.arrays_zip(F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))).alias("a"), F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))).alias("b")), lambda x: x["a"]["role"] == x["b"]["role"])
    why = F.when(F.size(t) == 0, "empty").when(F.element_at(t, 1)["role"] != "user", "does not begin with the user").when(F.element_at(t, -1)["role"] != "user", "does not end with the user").when(same, "a role repeats")
    return rows.select(key, why.alias("problem")).filter("problem IS NOT NULL")


def shares_prefix(initial: Column, branch: Column) -> Column:
    return F.slice(branch, 1, F.size(initial)) == initial
