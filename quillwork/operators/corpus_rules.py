"""Rules over groups of four texts (cells RS, RP, NS, NP), each as findings.

Input rows: ``scenario_id, supported_option, domain, scenario_text, opening, endorsement, marker_string, marker_family,
cells`` (map from condition to body).  Words are counted by one expression; every rule is one filter over the exploded
cells or over the group, so a run is one scan.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwork.functions import text as T
from quillwork.operators.checks import findings, union

CONDITIONS = ("RS", "RP", "NS", "NP")
#: Unconditional human-review codes by scope.
REVIEW_CELL = ("H_SUPPORT_DIRECTION", "H_SUBSTANTIVE_SUPPORT", "H_NATURALNESS", "H_PRAGMATIC_COMMITMENT")
REVIEW_NO_REASON, REVIEW_PAIR = "H_NO_REASON_INTEGRITY", "H_PROPOSITION_PRESERVATION"


@dataclass(frozen=True)
class Rules:
    markers: dict[str, str] = field(default_factory=dict)  # marker string -> family
    domains: tuple[str, ...] = ()
    forbidden: tuple[tuple[str, str, str], ...] = ()  # id, pattern, hard_fail or warning
    leakage: tuple[str, ...] = ()
    permitted: tuple[str, ...] = ()  # function words that a pair may differ by
    scenario_words: tuple[int, int] = (90, 130)
    ratio_warn: float = 1.10
    ratio_fail: float = 1.15
    coverage: float = 0.75
    ignored: tuple[str, ...] = ()  # words of the frame, never counted as content
    body_sentences: int = 1


def _group(c: Column) -> Column:
    return F.concat_ws("/", "scenario_id", "supported_option", c)


def measured(groups: DataFrame) -> DataFrame:
    """One row per group and condition with its body and measurements."""
    cells = groups.select("*", F.explode("cells").alias("condition", "body"))
    full = F.concat_ws(" ", "opening", "body")
    out = cells.withColumn("full", full).withColumn("words_body", T.word_count(F.col("body"))).withColumn("words_full", T.word_count(F.col("full"))).withColumn("sentences_full", F.size(T.sentences(F.col("full")))).withColumn("sentences_body", F.size(T.sentences(F.col("body"))))
    return out.withColumn("styled", F.col("condition").isin("RS", "NS"))


def scenario_findings(scenarios: DataFrame, rules: Rules) -> DataFrame:
    """Rules of a scenario text alone."""
    s, at = F.col("scenario_text"), F.col("scenario_id")
    n = T.word_count(s)
    parts = [findings(scenarios.filter(~n.between(*rules.scenario_words)), "E_SCENARIO_WORD_COUNT", "scenario", at, n)]
    if rules.leakage:
        parts.append(findings(scenarios.filter(T.any_of(s, list(rules.leakage))), "E_LABEL_LEAKAGE", "scenario", at))
    for name, pattern, severity in rules.forbidden:
        hard = severity == "hard_fail"
        parts.append(findings(scenarios.filter(s.rlike(pattern)), "E_FORBIDDEN" if hard else "W_FORBIDDEN", "scenario", at, F.lit(name), "error" if hard else "warning"))
    return union(*parts)


def identity_findings(groups: DataFrame, rules: Rules) -> DataFrame:
    twice = groups.groupBy("scenario_id", "supported_option").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    parts = [findings(twice, "E_DUPLICATE_GROUP", "group", F.concat_ws("/", "scenario_id", "supported_option"), F.col("n"))]
    if rules.domains:
        parts.append(findings(groups.filter(~F.coalesce(F.col("domain").isin(*rules.domains), F.lit(False))), "E_UNKNOWN_DOMAIN", "group", F.concat_ws("/", "scenario_id", "supported_option"), F.col("domain")))
    want = F.array(*map(F.lit, CONDITIONS))
    keys = F.coalesce(F.map_keys("cells"), F.array().cast("array<string>"))
    parts.append(findings(groups.filter((F.size(F.array_except(want, keys)) > 0) | (F.size(F.array_except(keys, want)) > 0)), "E_MISSING_CELLS", "group", F.concat_ws("/", "scenario_id", "supported_option"), F.array_join(F.array_sort(keys), ",")))
    if rules.markers:
        family = F.element_at(F.create_map(*(F.lit(x) for kv in rules.markers.items() for x in kv)), F.col("marker_string"))
        parts.append(findings(groups.filter(~F.coalesce(family == F.col("marker_family"), F.lit(False))), "E_MARKER_NOT_IN_FAMILY", "group", F.concat_ws("/", "scenario_id", "supported_option"), F.col("marker_string")))
    return union(*parts)


def cell_findings(groups: DataFrame, rules: Rules) -> DataFrame:
    """Rules of single cells."""
    c = measured(groups)
    at, body = _group(F.col("condition")), F.col("body")
    has = T.contains_phrase(body, F.col("marker_string"))
    parts = [findings(c.filter(F.col("styled") & ~has), "E_MARKER_MISSING_IN_STYLED_CELL", "cell", at, F.col("marker_string"))]
    if rules.markers:
        hits = F.array_compact(F.array(*(F.when(T.contains_phrase(body, F.lit(m)), F.lit(m)) for m in sorted(rules.markers))))
        parts.append(findings(c.filter(~F.col("styled") & (F.size(hits) > 0)), "E_MARKER_IN_PLAIN_CELL", "cell", at, F.array_join(hits, ",")))
    parts.append(findings(c.filter(F.contains(T.normalised(body), T.normalised(F.col("opening")))), "E_OPENING_REPEATED_IN_BODY", "cell", at))
    for name, pattern, severity in rules.forbidden:
        hard = severity == "hard_fail"
        parts.append(findings(c.filter(F.col("full").rlike(pattern)), "E_FORBIDDEN" if hard else "W_FORBIDDEN", "cell", at, F.concat_ws(": ", F.lit(name), F.regexp_extract("full", pattern, 0)), "error" if hard else "warning"))
    if rules.leakage:
        parts.append(findings(c.filter(T.any_of(F.col("full"), list(rules.leakage))), "E_LABEL_LEAKAGE", "cell", at))
    parts.append(findings(c.filter(body.rlike(T.LIST_MARK) | F.contains(body, F.lit("\n"))), "E_PROHIBITED_FORMATTING", "cell", at))
    for kind, n in T.ambiguity_counts(F.col("full")).items():
        parts.append(findings(c.filter(n > 0), "W_AMBIGUOUS_SEGMENTATION", "cell", at, F.lit(kind), "warning"))
    premise = T.strip_once(T.strip_once(F.col("body"), F.coalesce("endorsement", F.lit(""))), F.when(F.col("styled"), F.col("marker_string")).otherwise(""))
    part = F.round(T.containment(premise, F.col("scenario_text"), ignore=rules.ignored), 4)
    parts.append(findings(c.filter(F.col("condition").isin("RS", "RP") & (part < rules.coverage)), "W_PREMISE_NOT_IN_SCENARIO", "cell", at, part, "warning"))
    tail = F.rtrim(body)
    parts.append(findings(c.filter(~F.endswith(tail, F.lit(".")) | F.endswith(tail, F.lit(".."))), "E_BODY_TERMINAL_PUNCTUATION", "cell", at, F.right(tail, F.lit(12))))
    parts.append(findings(c.filter(F.col("endorsement").isNull()), "E_ENDORSEMENT_NOT_SUPPLIED", "group", at))
    times = T.occurrences(T.normalised(F.col("body")), T.normalised(F.col("endorsement")))
    parts.append(findings(c.filter(times != 1), "E_ENDORSEMENT_NOT_EXACTLY_ONCE", "cell", at, times))
    left = T.residue(body, F.col("endorsement"), F.when(F.col("styled"), F.col("marker_string")).otherwise(""))
    parts.append(findings(c.filter(F.col("condition").isin("NS", "NP") & (F.size(left) > 0)), "E_NO_PREMISE_CELL_HAS_EXTRA_CONTENT", "cell", at, F.array_join(left, " ")))
    parts.append(findings(c.filter(F.col("condition").isin("RS", "RP") & (F.size(left) == 0)), "E_REASON_CELL_HAS_NO_PREMISE", "cell", at))
    return union(*parts)


def group_findings(groups: DataFrame, rules: Rules, pairwise: bool = True) -> DataFrame:
    """Rules that compare the cells of a group."""
    m = measured(groups)
    pick = lambda name, cond: F.max(F.when(F.col("condition") == cond, F.col(name)))
    keys = ["scenario_id", "supported_option"]
    wide = m.groupBy(*keys).agg(
        F.first("marker_string").alias("marker_string"),
        *(pick(n, c).alias(f"{n}_{c}") for n in ("words_full", "words_body", "sentences_full", "sentences_body", "body") for c in CONDITIONS),
        *(f(n).alias(f"{a}_{n}") for n in ("words_full", "words_body", "sentences_full") for a, f in (("lo", F.min), ("hi", F.max))),
    )
    at, parts = F.concat_ws("/", *keys), []
    if pairwise:
        for styled, plain in (("RS", "RP"), ("NS", "NP")):
            pair = F.concat_ws("/", *keys, F.lit(f"{styled}-{plain}"))
            delta = F.abs(F.col(f"words_body_{styled}") - F.col(f"words_body_{plain}"))
            parts += [
                findings(wide.filter(F.col(f"sentences_full_{styled}") != F.col(f"sentences_full_{plain}")), "E_PAIR_SENTENCE_COUNT", "pair", pair),
                findings(wide.filter(F.col(f"sentences_body_{styled}") != rules.body_sentences), "E_BODY_SENTENCE_COUNT", "pair", pair, F.col(f"sentences_body_{styled}")),
                findings(wide.filter(delta > T.word_count(F.col("marker_string"))), "E_PAIR_WORD_DELTA", "pair", pair, delta),
                findings(wide.filter(F.right(F.rtrim(f"body_{styled}"), F.lit(1)) != F.right(F.rtrim(f"body_{plain}"), F.lit(1))), "E_PAIR_TERMINAL_PUNCTUATION_MISMATCH", "pair", pair),
            ]
    else:
        parts.append(findings(wide.filter("lo_sentences_full <> hi_sentences_full"), "E_SENTENCE_COUNT_MISMATCH", "group", at))
        for name in ("words_full", "words_body"):
            ratio = F.col(f"hi_{name}") / F.nullif(F.col(f"lo_{name}"), F.lit(0))
            label = "FULL_TEXT" if name == "words_full" else "BODY"
            parts.append(findings(wide.filter(F.coalesce(ratio > rules.ratio_fail, F.lit(True))), f"E_WORD_RATIO_{label}", "group", at, F.round(ratio, 4)))
            parts.append(findings(wide.filter((ratio > rules.ratio_warn) & (ratio <= rules.ratio_fail)), f"W_WORD_RATIO_{label}", "group", at, F.round(ratio, 4), "warning"))
    allowed = F.array(*map(F.lit, rules.permitted)) if rules.permitted else F.array().cast("array<string>")
    for styled, plain in (("RS", "RP"), ("NS", "NP")):
        a = F.filter(T.less_words(T.words(F.lower(f"body_{styled}")), T.words(F.lower("marker_string"))), lambda w: ~F.array_contains(allowed, w))
        b = F.filter(T.words(F.lower(f"body_{plain}")), lambda w: ~F.array_contains(allowed, w))
        drift = F.array_sort(a) != F.array_sort(b)
        parts.append(findings(wide.filter(drift), "E_PAIR_CONTENT_DRIFT", "pair", F.concat_ws("/", *keys, F.lit(f"{styled}-{plain}")), F.concat_ws(" | ", F.array_join(F.array_except(a, b), " "), F.array_join(F.array_except(b, a), " "))))
    return union(*parts)


def duplicate_findings(groups: DataFrame, with_scenario: bool = True) -> DataFrame:
    """Rendered texts that occur more than once; the first place is named.  ``with_scenario``: the scenario is part of it."""
    c = measured(groups)
    text = F.concat_ws("\n", F.col("scenario_text"), F.col("full")) if with_scenario else F.col("full")
    placed = c.select(F.md5(T.normalised(text).cast("binary")).alias("mark"), _group(F.col("condition")).alias("at"))
    places = placed.groupBy("mark", "at").agg(F.count(F.lit(1)).alias("times"))
    first = places.groupBy("mark").agg(F.min("at").alias("first"))
    return findings(places.join(first, "mark").filter("at <> first OR times > 1"), "E_DUPLICATE_TEXT", "cell", F.col("at"), F.col("first"))


def review_items(groups: DataFrame) -> DataFrame:
    """The judgements that only people make, for every cell and pair."""
    c = groups.select("scenario_id", "supported_option", F.explode(F.map_keys("cells")).alias("condition"))
    codes = F.concat(F.array(*map(F.lit, REVIEW_CELL)), F.when(F.col("condition").isin("NS", "NP"), F.array(F.lit(REVIEW_NO_REASON))).otherwise(F.array().cast("array<string>")))
    cells = c.withColumn("code", F.explode(codes)).select("code", F.lit("human_review").alias("severity"), F.lit("cell").alias("scope"), _group(F.col("condition")).alias("locator"), F.lit(None).cast("string").alias("detail"))
    pairs = groups.withColumn("pair", F.explode(F.array(F.lit("RS-RP"), F.lit("NS-NP")))).select(F.lit(REVIEW_PAIR).alias("code"), F.lit("human_review").alias("severity"), F.lit("pair").alias("scope"), _group(F.col("pair")).alias("locator"), F.lit(None).cast("string").alias("detail"))
    return cells.unionByName(pairs)


def validate(groups: DataFrame, rules: Rules, pairwise: bool = True) -> DataFrame:
    """All findings of a corpus."""
    return reduce(lambda a, b: a.unionByName(b), (scenario_findings(groups.dropDuplicates(["scenario_id"]), rules), identity_findings(groups, rules), cell_findings(groups, rules), group_findings(groups, rules, pairwise), duplicate_findings(groups), review_items(groups)))
