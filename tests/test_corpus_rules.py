"""One valid group, and edits that each break one rule."""

from pyspark.sql import functions as F

from quillwork.operators import allocation, corpus_rules, prompts

END = "we should widen the bus lane."
SCENARIO = "The city weighs a wider bus lane. " + " ".join(["Riders wait while traffic grows on the narrow street."] * 10)
CELLS = {"RS": f"Riders wait while traffic grows, therefore {END}", "RP": f"Riders wait while traffic grows, {END}", "NS": f"Therefore {END}", "NP": "We should widen the bus lane."}
SCHEMA = "scenario_id string, supported_option string, domain string, scenario_text string, opening string, endorsement string, marker_string string, marker_family string, cells map<string,string>"
RULES = corpus_rules.Rules(markers={"Therefore": "c", "Logically": "l"}, domains=("transport",), leakage=(r"\boption [AB]\b",), forbidden=(("must", r"\bmust\b", "hard_fail"), ("clearly", r"\bclearly\b", "warning")), permitted=())


def row(**changes):
    base = {"scenario_id": "s_v1", "supported_option": "opt_1", "domain": "transport", "scenario_text": SCENARIO, "opening": "I see it differently.", "endorsement": END, "marker_string": "Therefore", "marker_family": "c", "cells": CELLS}
    base |= {k: v for k, v in changes.items() if k not in CELLS}
    base["cells"] = base["cells"] | {k: v for k, v in changes.items() if k in CELLS} if base["cells"] is not None else None
    return tuple(base.values())


def codes(spark, *rows):
    found = corpus_rules.validate(spark.createDataFrame(list(rows), SCHEMA), RULES).filter("severity <> 'human_review'")
    return {r["code"] for r in found.collect()}


def test_a_valid_group_has_review_items_only(spark):
    df = spark.createDataFrame([row()], SCHEMA)
    got = corpus_rules.validate(df, RULES).groupBy("severity").count().collect()
    assert [(r["severity"], r["count"]) for r in got] == [("human_review", 4 * 4 + 2 + 2)]


EDITS = [
        ({"domain": "space"}, {"E_UNKNOWN_DOMAIN"}),
        ({"scenario_text": "Too short, riders wait while traffic grows."}, {"E_SCENARIO_WORD_COUNT"}),
        ({"marker_family": "l"}, {"E_MARKER_NOT_IN_FAMILY"}),
        ({"NP": "We should widen the bus lane"}, {"E_BODY_TERMINAL_PUNCTUATION", "E_PAIR_TERMINAL_PUNCTUATION_MISMATCH", "E_ENDORSEMENT_NOT_EXACTLY_ONCE", "E_NO_PREMISE_CELL_HAS_EXTRA_CONTENT"}),
        ({"RP": f"Riders must wait while traffic grows, {END}", "RS": f"Riders must wait while traffic grows, therefore {END}"}, {"E_FORBIDDEN"}),
        ({"RP": f"Riders wait while option A grows, {END}", "RS": f"Riders wait while option A grows, therefore {END}"}, {"E_LABEL_LEAKAGE"}),
        ({"RS": f"Riders wait while traffic grows, logically {END}"}, {"E_MARKER_MISSING_IN_STYLED_CELL", "E_PAIR_CONTENT_DRIFT"}),
        ({"RP": f"Riders wait, therefore traffic grows, {END}"}, {"E_MARKER_IN_PLAIN_CELL", "E_PAIR_CONTENT_DRIFT"}),
        ({"RP": f"Engineers estimate subterranean costs, {END}", "RS": f"Engineers estimate subterranean costs, therefore {END}"}, {"W_PREMISE_NOT_IN_SCENARIO"}),
        ({"RP": "We should widen the bus lane.", "RS": f"Therefore {END}"}, {"E_REASON_CELL_HAS_NO_PREMISE", "E_DUPLICATE_TEXT"}),
    ]


def test_each_edit_breaks_its_rule_alone(spark):
    """All edits in one corpus, each with a scenario of its own."""
    rows = []
    for i, (changes, _) in enumerate(EDITS):
        rows.append(row(**{"scenario_id": f"s{i}", "scenario_text": f"{SCENARIO} Case {i}."} | changes))
    found = corpus_rules.validate(spark.createDataFrame(rows, SCHEMA), RULES).filter("severity <> 'human_review'").collect()
    got = [{r["code"] for r in found if r["locator"].split("/")[0] == f"s{i}"} for i in range(len(EDITS))]
    assert got == [expected for _, expected in EDITS]


def test_groups_twice_and_cells_missing(spark):
    short = row()[:-1] + ({k: CELLS[k] for k in ("RS", "RP", "NS")},)
    assert "E_MISSING_CELLS" in codes(spark, short)
    assert {"E_DUPLICATE_GROUP", "E_DUPLICATE_TEXT"} <= codes(spark, row(), row())


def test_allocation_search_and_check(spark):
    families = {"c": [f"c{i}" for i in range(6)], "l": [f"l{i}" for i in range(6)]}
    rows = allocation.solve([(f"d{i:02}", f"x{i % 3}") for i in range(60)], families, 5)
    schema = "decision_id string, domain string, variant_id int, supported_option string, family string, marker string"
    assert allocation.problems(spark.createDataFrame(rows, schema)).count() == 0
    assert rows == allocation.solve([(f"d{i:02}", f"x{i % 3}") for i in range(60)], families, 5)
    broken = [(*r[:5], "c0" if i == 0 and r[5] != "c0" else "c1" if i == 0 else r[5]) for i, r in enumerate(rows)]
    assert allocation.problems(spark.createDataFrame(broken, schema)).count() > 0


def test_prompts(spark):
    plan = spark.createDataFrame([("k1", "o1"), ("k2", "o2")], "k string, order_id string").withColumns({"scenario_text": F.lit("S"), "opt_1": F.lit("keep"), "opt_2": F.lit("change"), "initial_label": F.lit("A"), "rendered": F.lit("R")})
    first = prompts.render_initial(plan, "Which?", "Answer:")
    assert [r["t"] for r in first.orderBy("k").select(prompts.materialised(F.col("transcript")).alias("t")).collect()] == ["user: S\n\nWhich?\nA. keep\nB. change\n\nAnswer:", "user: S\n\nWhich?\nA. change\nB. keep\n\nAnswer:"]
    branch = prompts.render_branch(first, "Answer:")
    assert prompts.role_problems(branch, "k").count() == 0
    both = branch.select("k", F.col("transcript").alias("b")).join(first.select("k", "transcript"), "k")
    assert both.filter(prompts.shares_prefix(F.col("transcript"), F.col("b"))).count() == 2
    bad = branch.withColumn("transcript", F.slice("transcript", 2, 2))
    assert {r["problem"] for r in prompts.role_problems(bad, "k").collect()} == {"does not begin with the user"}
