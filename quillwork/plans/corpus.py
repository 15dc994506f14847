"""Queries of corpus rules, prompts and allocations over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwork.functions import text as T
from quillwork.operators import allocation as A
from quillwork.operators import corpus_rules as R
from quillwork.operators import prompts as M
from quillwork.plans.registry import query
from quillwork.plans.roles import load

MARKERS = {"Therefore": "conclusion", "Thus": "conclusion", "Logically": "logic"}
ENDORSEMENT, OPENING = "we should keep it.", "I see this differently."


def groups(spark, sf_dir) -> DataFrame:
    """Two groups per item: the item as scenario, bodies from literals; every third styled cell lacks its marker."""
    b = load(spark, sf_dir, "benchmark").select(F.concat(F.lit("s"), "item_id").alias("scenario_id"), F.col("item_id"), F.col("text").alias("scenario_text"))
    b = b.withColumn("supported_option", F.explode(F.array(F.lit("opt_1"), F.lit("opt_2"))))
    premise = F.concat(F.lit("Since "), F.array_join(F.slice(T.words(F.lower("scenario_text")), 1, 6), " "), F.lit(", "))
    mark = F.when(F.col("item_id") % 3 == 0, "").otherwise("therefore ")
    plain = F.lit(ENDORSEMENT)
    cells = F.create_map(F.lit("RS"), F.concat(premise, mark, plain), F.lit("RP"), F.concat(premise, plain), F.lit("NS"), F.concat(F.initcap(F.lit("therefore")), F.lit(" "), plain), F.lit("NP"), F.concat(F.lit("We"), F.substr(plain, F.lit(3))))
    return b.select("scenario_id", "supported_option", F.lit("benchmark").alias("domain"), "scenario_text", F.lit(OPENING).alias("opening"), F.lit(ENDORSEMENT).alias("endorsement"), F.lit("Therefore").alias("marker_string"), F.lit("conclusion").alias("marker_family"), cells.alias("cells"))


RULES = R.Rules(markers=MARKERS, domains=("benchmark",), leakage=(r"\boption [AB]\b",), forbidden=(("stand", r"\bthat\b", "warning"),), scenario_words=(20, 60))


@query(None)
def corpus_findings(spark, sf_dir):
    """All rules over the groups, counted by code; segmentation and look-behind have no SQL form."""
    f = R.validate(groups(spark, sf_dir), RULES)
    return f.groupBy("severity", "code", "scope").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 's' || item_id || '/' || o || '/RS' AS locator FROM benchmark, (VALUES ('opt_1'), ('opt_2')) v(o) WHERE item_id % 3 = 0 AND NOT regexp_matches(text, '(?i)therefore')")
def missing_markers(spark, sf_dir):
    f = R.cell_findings(groups(spark, sf_dir), RULES)
    return f.filter("code = 'E_MARKER_MISSING_IN_STYLED_CELL'").select("locator")


@query("SELECT 's' || item_id AS locator, len(regexp_extract_all(text, '[A-Za-z0-9]+(?:[''’-][A-Za-z0-9]+)*'))::VARCHAR AS detail FROM benchmark WHERE len(regexp_extract_all(text, '[A-Za-z0-9]+(?:[''’-][A-Za-z0-9]+)*')) NOT BETWEEN 20 AND 60")
def scenario_word_band(spark, sf_dir):
    f = R.scenario_findings(groups(spark, sf_dir).dropDuplicates(["scenario_id"]), RULES)
    return f.filter("code = 'E_SCENARIO_WORD_COUNT'").select("locator", "detail")


@query("SELECT 's' || item_id AS scenario_id, m AS marker FROM benchmark, (VALUES ('the'), ('for'), ('et')) v(m) WHERE regexp_matches(text, '(?i)(^|[^A-Za-z])' || m || '($|[^A-Za-z])')")
def marker_collisions(spark, sf_dir):
    s = load(spark, sf_dir, "benchmark").select(F.concat(F.lit("s"), "item_id").alias("scenario_id"), F.col("text").alias("scenario_text"))
    return A.collisions(s, spark.createDataFrame([("the",), ("for",), ("et",)], "marker string"))


@query("SELECT 'E_' AS code, '' AS locator WHERE FALSE")
def allocation_check(spark, sf_dir):
    """A searched allocation of 60 decisions, checked apart from the search: no finding."""
    families = {"conclusion": [f"c{i}" for i in range(6)], "logic": [f"l{i}" for i in range(6)]}
    rows = A.solve([(f"d{i:02}", f"dom{i % 3}") for i in range(60)], families, 20261005)
    table = spark.createDataFrame(rows, "decision_id string, domain string, variant_id int, supported_option string, family string, marker string")
    return A.problems(table).select("code", "locator")


@query("SELECT item_id, sha256('{\"answer_cue\":\"Answer:\",\"transcript\":[{\"content\":\"s' || item_id || '\\n\\nWhich?\\nA. keep\\nB. change\\n\\nAnswer:\",\"role\":\"user\"}]}') AS prompt_hash FROM benchmark")
def prompt_hashes(spark, sf_dir):
    plan = load(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("s"), "item_id").alias("scenario_text"), F.lit("o1").alias("order_id"), F.lit("keep").alias("opt_1"), F.lit("change").alias("opt_2"))
    return M.render_initial(plan, "Which?", "Answer:").select("item_id", M.prompt_hash(F.col("transcript"), "Answer:").alias("prompt_hash"))
