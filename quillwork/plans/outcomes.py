"""Queries of the scoring and estimation family, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.operators import blocks as B
from quillwork.operators import estimate as E
from quillwork.operators import scoring as S
from quillwork.plans.registry import query
from quillwork.plans.roles import BLOCKS_SQL, INITIALS_SQL, LABELLED_SQL, SCORES_SQL, candidates, decisions, initials, scores

#: Replicates of `bootstrap_counts`, and of the planned analysis.
REPLICATES, PLANNED_REPLICATES, SEED = 60, 9999, 20261005


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.build_blocks(scores(spark, sf_dir))


def _coef(name: str, prefix: str) -> str:
    return " + ".join(f"({k}.0::DOUBLE)*{prefix}_{c}" for c, k in B.CONTRASTS[name].items())


def values_sql(source: str = BLOCKS_SQL, outcomes: tuple[str, ...] = ("movement", "flip"), cells: bool = True) -> str:
    parts = []
    for o in outcomes:
        p = "mov" if o == "movement" else "flip"
        for name, coef in B.CONTRASTS.items():
            flips = " + ".join(f"flips_{c}" for c in coef) if o == "flip" else "0"
            parts.append(f"SELECT *, '{o}' AS outcome, 'contrast' AS kind, '{name}' AS quantity, {_coef(name, p)} AS value, {sum(B.ROWS_OF[c] for c in coef)} AS n_mov, {flips} AS n_flip FROM b")
        for c in B.CONDITIONS if cells else ():
            parts.append(f"SELECT *, '{o}' AS outcome, 'cell' AS kind, '{c}' AS quantity, {p}_{c} AS value, {B.ROWS_OF[c]} AS n_mov, {f'flips_{c}' if o == 'flip' else '0'} AS n_flip FROM b")
    return f"WITH b AS ({source}), v AS (SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE value IS NOT NULL)"


def means_sql(keys: str, where: str = "TRUE") -> str:
    return f"""SELECT {keys}, round(avg(decision_value), 6) AS estimate, sum(blocks)::BIGINT AS n_blocks, sum(mov)::BIGINT AS n_movement_rows, sum(flip)::BIGINT AS n_flip_rows, count(*) AS n_decisions, sum(initials)::BIGINT AS n_initials
FROM (SELECT {keys}, decision_id, avg(value) AS decision_value, count(*) AS blocks, sum(n_mov) AS mov, sum(n_flip) AS flip, count(DISTINCT (run, initial_id)) AS initials FROM v WHERE {where} GROUP BY {keys}, decision_id) GROUP BY {keys}"""


SCORE_COLUMNS = ["run", "initial_id", "opening_id", "condition", "marker_id", "m_before", "m_after", "movement", "final_label", "flip", "initial_near_tie", "post_exact_tie"]


@query(f"SELECT {', '.join(SCORE_COLUMNS)} FROM ({SCORES_SQL})")
def movement_scores(spark, sf_dir):
    return scores(spark, sf_dir).select(*SCORE_COLUMNS)


@query(f"SELECT run, initial_id, opening_id, condition, marker_id, initial_label AS required_label FROM ({SCORES_SQL})")
def runtime_selection(spark, sf_dir):
    plan = candidates(spark, sf_dir).select("run", "initial_id", "opening_id", "condition", "marker_id").withColumn("required_label", F.explode(F.array(F.lit("A"), F.lit("B"))))
    return S.runtime_selection(initials(spark, sf_dir), plan)[0].select("run", "initial_id", "opening_id", "condition", "marker_id", "required_label")


@query(f"SELECT run, initial_id, decision_id, order_id, logit_a, logit_b, 'exact_initial_tie' AS exclusion_reason FROM ({LABELLED_SQL}) WHERE initial_label IS NULL")
def initial_exclusions(spark, sf_dir):
    plan = initials(spark, sf_dir).select("run", "initial_id", F.lit("A").alias("required_label"))
    return S.runtime_selection(initials(spark, sf_dir), plan)[1].select("run", "initial_id", "decision_id", "order_id", "logit_a", "logit_b", "exclusion_reason")


@query(f"SELECT run, condition, marker_id, opening_id, count(*) AS movement_rows, sum(post_exact_tie::INT)::BIGINT AS exact_post_ties, sum((NOT post_exact_tie)::INT)::BIGINT AS flip_defined_rows, round(100.0*sum(post_exact_tie::INT)/count(*), 6) AS exact_post_ties_pct FROM ({SCORES_SQL}) GROUP BY ALL")
def post_tie_breakdown(spark, sf_dir):
    tie = F.col("post_exact_tie").cast("long")
    return scores(spark, sf_dir).groupBy("run", "condition", "marker_id", "opening_id").agg(F.count(F.lit(1)).alias("movement_rows"), F.sum(tie).alias("exact_post_ties"), F.sum(1 - tie).alias("flip_defined_rows"), F.round(100.0 * F.sum(tie) / F.count(F.lit(1)), 6).alias("exact_post_ties_pct"))


@query(f"""SELECT i.run, initial_readings, initial_ties, score_rows, post_ties, round(100.0*initial_ties/initial_readings, 6) AS initial_ties_pct, round(100.0*post_ties/score_rows, 6) AS post_ties_pct,
CASE WHEN initial_ties > 0 AND post_ties > 0 THEN 'complete_with_recorded_exclusions_and_secondary_ties' WHEN initial_ties > 0 THEN 'complete_with_recorded_exclusions' WHEN post_ties > 0 THEN 'complete_with_recorded_secondary_ties' ELSE 'complete' END AS completion
FROM (SELECT run, count(*) AS initial_readings, sum((logit_a = logit_b)::INT)::BIGINT AS initial_ties FROM ({INITIALS_SQL}) GROUP BY run) i JOIN (SELECT run, count(*) AS score_rows, sum(post_exact_tie::INT)::BIGINT AS post_ties FROM ({SCORES_SQL}) GROUP BY run) s ON i.run = s.run""")
def tie_counts(spark, sf_dir):
    return S.tie_counts(initials(spark, sf_dir), scores(spark, sf_dir))


@query(f"""SELECT run, 'condition_rows' AS level, condition AS quantity, count(*) AS total, count(flip) AS defined FROM ({SCORES_SQL}) GROUP BY ALL
UNION ALL SELECT run, 'block_contrast', q, count(*), count(v) FROM (SELECT run, unnest([{', '.join(f"'{n}'" for n in B.CONTRASTS)}]) AS q, unnest([{', '.join(_coef(n, 'flip') for n in B.CONTRASTS)}]) AS v FROM ({BLOCKS_SQL})) GROUP BY run, q""")
def flip_denominators(spark, sf_dir):
    rows = scores(spark, sf_dir).groupBy("run", F.lit("condition_rows").alias("level"), F.col("condition").alias("quantity")).agg(F.count(F.lit(1)).alias("total"), F.count("flip").alias("defined"))
    each = F.inline(F.array(*(F.struct(F.lit(n).alias("quantity"), B.contrast(n, "flip").alias("v")) for n in B.CONTRASTS)))
    over = blocks(spark, sf_dir).select("run", each).groupBy("run", F.lit("block_contrast").alias("level"), "quantity").agg(F.count(F.lit(1)).alias("total"), F.count("v").alias("defined"))
    return rows.unionByName(over)


CELL_COLUMNS = ["run", "initial_id", "opening_id", "decision_id", "domain", "order_id", "initial_option", "m_before", *(f"{p}_{c}" for c in B.CONDITIONS for p in ("mov", "flip", "flips"))]


@query(f"SELECT {', '.join(CELL_COLUMNS)} FROM ({BLOCKS_SQL})")
def block_cells(spark, sf_dir):
    return blocks(spark, sf_dir).select(*CELL_COLUMNS)


def _means(b: DataFrame, keys: list[str], outcomes: tuple[str, ...] = ("movement", "flip"), cells: bool = True) -> DataFrame:
    return E.decision_means(B.decision_values(b, keys, outcomes, cells), keys)


@query(f"{values_sql()} {means_sql('run, outcome, kind, quantity')}")
def contrast_by_model(spark, sf_dir):
    return _means(blocks(spark, sf_dir), ["run", "outcome", "kind", "quantity"])


@query(f"{values_sql(outcomes=('movement',))} {means_sql('run, domain, kind, quantity')}")
def contrast_by_domain(spark, sf_dir):
    return _means(blocks(spark, sf_dir), ["run", "domain", "kind", "quantity"], ("movement",))


@query(f"{values_sql(cells=False)} {means_sql('run, order_id, outcome, quantity')}")
def contrast_by_order(spark, sf_dir):
    return _means(blocks(spark, sf_dir), ["run", "order_id", "outcome", "quantity"], cells=False)


def _heterogeneity(spark, sf_dir, level: str) -> DataFrame:
    """Differences of every two levels, with whether both have the same sign."""
    est = E.plain_means(B.values(blocks(spark, sf_dir), ("movement",), cells=False), ["run", level, "quantity"])
    a = est.select("run", "quantity", F.col(level).alias("level_a"), F.col("estimate").alias("a"))
    b = est.select("run", "quantity", F.col(level).alias("level_b"), F.col("estimate").alias("b"))
    return a.join(b, ["run", "quantity"]).filter("level_a < level_b").select("run", "quantity", "level_a", "level_b", F.round(F.col("a") - F.col("b"), 6).alias("difference"), (F.signum("a") == F.signum("b")).alias("same_sign"))


def _heterogeneity_sql(level: str) -> str:
    return f"""{values_sql(outcomes=('movement',), cells=False)}, e AS (SELECT run, {level} AS l, quantity, round(avg(x), 6) AS estimate FROM (SELECT run, {level}, quantity, decision_id, avg(value) AS x FROM v GROUP BY ALL) GROUP BY ALL)
SELECT a.run, a.quantity, a.l AS level_a, b.l AS level_b, round(a.estimate - b.estimate, 6) AS difference, sign(a.estimate) = sign(b.estimate) AS same_sign FROM e a JOIN e b ON a.run = b.run AND a.quantity = b.quantity AND a.l < b.l"""


@query(_heterogeneity_sql("order_id"))
def order_heterogeneity(spark, sf_dir):
    return _heterogeneity(spark, sf_dir, "order_id")


@query(_heterogeneity_sql("opening_id"))
def opening_heterogeneity(spark, sf_dir):
    return _heterogeneity(spark, sf_dir, "opening_id")


_MARKER_VALUES_SQL = f"""WITH m AS (SELECT run, initial_id, opening_id, min(decision_id) AS decision_id, marker_family, marker_id,
 avg(movement) FILTER (condition='RS') AS rs, avg(movement) FILTER (condition='NS') AS ns FROM ({SCORES_SQL}) WHERE marker_family <> 'none' GROUP BY run, initial_id, opening_id, marker_family, marker_id),
b AS (SELECT run, initial_id, opening_id, mov_RP AS rp, mov_NP AS np FROM ({BLOCKS_SQL})),
v AS (SELECT run, decision_id, marker_family, marker_id, unnest(['NS_minus_NP','RS_minus_RP','RS_minus_NS','interaction']) AS quantity, unnest([ns - np, rs - rp, rs - ns, (rs - rp) - (ns - np)]) AS value FROM m JOIN b USING (run, initial_id, opening_id)),
e AS (SELECT run, marker_family, marker_id, quantity, round(avg(x), 6) AS estimate, sum(n)::BIGINT AS n_blocks, count(*) AS n_decisions FROM (SELECT run, marker_family, marker_id, quantity, decision_id, avg(value) AS x, count(*) AS n FROM v WHERE value IS NOT NULL GROUP BY ALL) GROUP BY ALL)"""


def _markers(spark, sf_dir) -> DataFrame:
    return E.plain_means(B.marker_values(blocks(spark, sf_dir)), ["run", "marker_family", "marker_id", "quantity"])


@query(f"{_MARKER_VALUES_SQL} SELECT * FROM e")
def marker_contrasts(spark, sf_dir):
    return _markers(spark, sf_dir)


@query(f"{_MARKER_VALUES_SQL} SELECT run, marker_family, quantity, round(avg(estimate), 6) AS estimate, count(*) AS markers FROM e GROUP BY ALL")
def family_mean(spark, sf_dir):
    """The unweighted mean of a family's marker estimates, not a pooled mean."""
    return _markers(spark, sf_dir).groupBy("run", "marker_family", "quantity").agg(F.round(F.avg("estimate"), 6).alias("estimate"), F.count(F.lit(1)).alias("markers"))


@query(f"{_MARKER_VALUES_SQL}, f AS (SELECT run, marker_family, quantity, round(avg(estimate), 6) AS estimate FROM e GROUP BY ALL) SELECT a.run, a.quantity, round(a.estimate - b.estimate, 6) AS difference FROM f a JOIN f b ON a.run = b.run AND a.quantity = b.quantity AND a.marker_family = 'conclusion' AND b.marker_family = 'logic'")
def family_difference(spark, sf_dir):
    f = family_mean(spark, sf_dir)
    return E.difference(f.filter("marker_family = 'conclusion'"), f.filter("marker_family = 'logic'"), ["run", "quantity"])


def _common(spark, sf_dir, same_choice: bool) -> DataFrame:
    """Initials valid in every run (and with the same option in all)."""
    valid = initials(spark, sf_dir).filter(F.col("initial_label").isNotNull())
    per = valid.groupBy("initial_id").agg(F.countDistinct("run").alias("runs"), F.min("initial_option").alias("lo"), F.max("initial_option").alias("hi"))
    return per.filter((F.col("runs") == 2) & (F.lit(not same_choice) | (F.col("lo") == F.col("hi")))).select("initial_id")


_COMMON_SQL = f"SELECT initial_id FROM ({LABELLED_SQL}) WHERE initial_label IS NOT NULL GROUP BY initial_id HAVING count(DISTINCT run) = 2"


@query(_COMMON_SQL)
def common_valid_subset(spark, sf_dir):
    return _common(spark, sf_dir, False)


@query(f"{_COMMON_SQL} AND min(initial_option) = max(initial_option)")
def common_choice_subset(spark, sf_dir):
    return _common(spark, sf_dir, True)


@query(f"""{values_sql(outcomes=('movement',))}, e AS (SELECT run, kind, quantity, round(avg(x), 6) AS estimate FROM (SELECT run, kind, quantity, decision_id, avg(value) AS x FROM v WHERE initial_id IN ({_COMMON_SQL}) GROUP BY ALL) GROUP BY ALL)
SELECT a.kind, a.quantity, round(a.estimate - b.estimate, 6) AS difference FROM e a JOIN e b ON a.kind = b.kind AND a.quantity = b.quantity AND a.run = 'instruct' AND b.run = 'base'""")
def model_difference(spark, sf_dir):
    mine = blocks(spark, sf_dir).join(_common(spark, sf_dir, False), "initial_id", "left_semi")
    e = E.plain_means(B.values(mine, ("movement",)), ["run", "kind", "quantity"])
    return E.difference(e.filter("run = 'instruct'"), e.filter("run = 'base'"), ["kind", "quantity"])


@query(f"""SELECT run, count(*) AS valid_initials, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS sd, min(x) AS min, quantile_cont(x, 0.25) AS q25, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q75, max(x) AS max, sum((x < ln(0.6::DOUBLE/0.4::DOUBLE))::INT)::BIGINT AS near_ties
FROM (SELECT run, abs(logit_a - logit_b) AS x FROM ({LABELLED_SQL}) WHERE initial_label IS NOT NULL) GROUP BY run""")
def margin_descriptives(spark, sf_dir):
    x = initials(spark, sf_dir).filter(F.col("initial_label").isNotNull()).select("run", F.abs(F.col("logit_a") - F.col("logit_b")).alias("x"))
    return x.groupBy("run").agg(F.count(F.lit(1)).alias("valid_initials"), F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_samp("x"), 6).alias("sd"), F.min("x").alias("min"), *(F.percentile("x", F.lit(q)).alias(n) for q, n in ((0.25, "q25"), (0.5, "median"), (0.75, "q75"))), F.max("x").alias("max"), F.sum((F.col("x") < S.TAU).cast("long")).alias("near_ties"))


@query(f"""SELECT run, condition, count(*) AS raw_rows, round(avg(movement), 6) AS raw_mean, round(stddev_samp(movement), 6) AS raw_sd, min(movement) AS raw_min, quantile_cont(movement, 0.25) AS raw_q25, quantile_cont(movement, 0.5) AS raw_median, quantile_cont(movement, 0.75) AS raw_q75, max(movement) AS raw_max, sum((movement > 0)::INT)::BIGINT AS raw_positive,
count(flip) AS raw_flip_defined, sum(flip::INT)::BIGINT AS raw_flips FROM ({SCORES_SQL}) GROUP BY ALL""")
def condition_descriptives(spark, sf_dir):
    m = F.col("movement")
    return scores(spark, sf_dir).groupBy("run", "condition").agg(F.count(F.lit(1)).alias("raw_rows"), F.round(F.avg(m), 6).alias("raw_mean"), F.round(F.stddev_samp(m), 6).alias("raw_sd"), F.min(m).alias("raw_min"), *(F.percentile(m, F.lit(q)).alias(n) for q, n in ((0.25, "raw_q25"), (0.5, "raw_median"), (0.75, "raw_q75"))), F.max(m).alias("raw_max"), F.sum((m > 0).cast("long")).alias("raw_positive"), F.count("flip").alias("raw_flip_defined"), F.sum(F.col("flip").cast("long")).alias("raw_flips"))


_CUTS_SQL = f"SELECT run, quantile_cont(abs(m), 0.25) AS q1, quantile_cont(abs(m), 0.5) AS q2, quantile_cont(abs(m), 0.75) AS q3 FROM (SELECT run, initial_id, min(m_before) AS m FROM ({BLOCKS_SQL}) GROUP BY ALL) GROUP BY run"


@query(f"""{values_sql(outcomes=('movement',), cells=False)}, c AS ({_CUTS_SQL}), w AS (SELECT v.*, CASE WHEN abs(m_before) <= q1 THEN 'Q1' WHEN abs(m_before) <= q2 THEN 'Q2' WHEN abs(m_before) <= q3 THEN 'Q3' ELSE 'Q4' END AS quartile FROM v JOIN c USING (run))
SELECT run, quartile, quantity, round(avg(x), 6) AS estimate, sum(n)::BIGINT AS n_blocks, count(*) AS n_decisions FROM (SELECT run, quartile, quantity, decision_id, avg(value) AS x, count(*) AS n FROM w GROUP BY ALL) GROUP BY ALL""")
def margin_quartiles(spark, sf_dir):
    own = blocks(spark, sf_dir)
    one = own.select("run", "initial_id", F.abs("m_before").alias("x")).dropDuplicates(["run", "initial_id"])
    cuts = one.groupBy("run").agg(*(F.percentile("x", F.lit(q)).alias(f"q{i}") for i, q in ((1, 0.25), (2, 0.5), (3, 0.75))))
    x = F.abs("m_before")
    label = F.when(x <= F.col("q1"), "Q1").when(x <= F.col("q2"), "Q2").when(x <= F.col("q3"), "Q3").otherwise("Q4")
    split = own.join(F.broadcast(cuts), "run").withColumn("quartile", label).drop("q1", "q2", "q3")  # one row per run
    return E.plain_means(B.values(split, ("movement",), cells=False), ["run", "quartile", "quantity"])


@query(f"""{values_sql(outcomes=('movement',), cells=False)}, d AS (SELECT run, quantity, decision_id, avg(abs(m_before)) AS sx, avg(value) AS sy, avg(m_before*m_before) AS sxx, avg(abs(m_before)*value) AS sxy, count(*) AS n FROM v GROUP BY ALL),
s AS (SELECT run, quantity, count(*) AS s0, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(sxy) AS sxy, sum(n)::BIGINT AS n FROM d GROUP BY ALL)
SELECT run, quantity, round((sxy - sx*sy/s0) / nullif(sxx - sx*sx/s0, 0), 6) AS slope, round(sy/s0, 6) AS mean, n AS n_blocks, s0 AS n_decisions FROM s""")
def wls_moderation(spark, sf_dir):
    return E.wls_slope(B.values(blocks(spark, sf_dir), ("movement",), cells=False), ["run", "quantity"], F.abs("m_before"))


@query(f"{values_sql(cells=False)} {means_sql('run, outcome, quantity', 'abs(m_before) >= ln(0.6::DOUBLE/0.4::DOUBLE)')}")
def near_tie_sensitivity(spark, sf_dir):
    return _means(blocks(spark, sf_dir).filter(F.abs("m_before") >= S.TAU), ["run", "outcome", "quantity"], cells=False)


def _draws_sql(replicates: int) -> str:
    return f"""p AS (SELECT c_custkey AS decision_id, r_name AS domain, row_number() OVER (PARTITION BY r_name ORDER BY c_custkey) - 1 AS place, count(*) OVER (PARTITION BY r_name) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
z AS (SELECT domain, max(n) AS n FROM p GROUP BY domain),
t AS (SELECT domain, replicate, ('0x' || substr(md5('{SEED}|' || domain || '|' || replicate || '|' || q), 1, 8))::BIGINT % n AS place FROM z, range(0, {replicates}) AS r(replicate), LATERAL (SELECT unnest(range(0, n)) AS q)),
k AS (SELECT t.replicate::INT AS replicate, decision_id, domain, count(*) AS weight FROM t JOIN p USING (domain, place) GROUP BY ALL)"""


_DRAWS_SQL = _draws_sql(REPLICATES)


@query(f"WITH {_DRAWS_SQL} SELECT replicate, decision_id, domain, weight FROM k")
def bootstrap_counts(spark, sf_dir):
    return E.hash_draws(decisions(spark, sf_dir), REPLICATES, SEED)


def _planned_boot(spark, sf_dir, replicates: int = PLANNED_REPLICATES) -> DataFrame:
    keys = ["run", "outcome", "quantity"]
    own = B.build_blocks(scores(spark, sf_dir, together=True)).drop("domain")  # the draws have the domains
    per = B.decision_values(own, keys, cells=False)
    return E.summarise(E.replicate_estimates(per, decisions(spark, sf_dir), replicates, SEED, keys), keys)


def _planned_holm(summaries: DataFrame) -> DataFrame:
    """The planned families: four contrasts of an outcome and run; the interaction stands apart."""
    h = E.holm(summaries.filter("quantity <> 'interaction'").select("run", "outcome", "quantity", "p_boot"), ["run", "outcome"], "quantity")
    return h.select("run", "outcome", "quantity", "p_boot", "family_size", F.round("p_holm", 6).alias("p_holm"))


_BOOT_SQL = f"""{values_sql(cells=False)}, {_draws_sql(PLANNED_REPLICATES)},
d AS (SELECT run, outcome, quantity, decision_id, avg(value) AS x FROM v GROUP BY ALL), r AS (SELECT run, outcome, quantity, replicate, round(sum(weight*x)/sum(weight), 6) AS e FROM d JOIN k USING (decision_id) GROUP BY ALL),
s AS (SELECT run, outcome, quantity, round(quantile_cont(e, 0.025), 6) AS ci_low, round(quantile_cont(e, 0.975), 6) AS ci_high, count(*) AS replicates_defined, round(least(1.0::DOUBLE, 2.0::DOUBLE*least((sum((e <= 0)::INT)+1)/(count(*)+1)::DOUBLE, (sum((e >= 0)::INT)+1)/(count(*)+1)::DOUBLE)), 6) AS p_boot FROM r GROUP BY ALL)"""


@query(f"{_BOOT_SQL} SELECT * FROM s")
def bootstrap_intervals(spark, sf_dir):
    """Both outcomes at all planned replicates."""
    return _planned_boot(spark, sf_dir)


@query(f"""{_BOOT_SQL}, h AS (SELECT run, outcome, quantity, p_boot, count(*) OVER (PARTITION BY run, outcome) AS family_size, row_number() OVER (PARTITION BY run, outcome ORDER BY p_boot, quantity) AS i FROM s WHERE quantity <> 'interaction')
SELECT run, outcome, quantity, p_boot, family_size, round(max(least(1.0::DOUBLE, (family_size - i + 1)*p_boot)) OVER (PARTITION BY run, outcome ORDER BY p_boot, quantity ROWS UNBOUNDED PRECEDING), 6) AS p_holm FROM h""")
def holm_adjusted(spark, sf_dir):
    """The planned families at all planned replicates."""
    return _planned_holm(_planned_boot(spark, sf_dir))


@query(None)
def bootstrap_counts_planned(spark, sf_dir):
    """All planned replicates; the tests compare a few of them with a loop."""
    return E.hash_draws(decisions(spark, sf_dir), PLANNED_REPLICATES, SEED)


@query(None)
def bootstrap_intervals_planned(spark, sf_dir):
    """Both outcomes at all planned replicates."""
    return _planned_boot(spark, sf_dir)


@query(None)
def holm_adjusted_planned(spark, sf_dir):
    return _planned_holm(_planned_boot(spark, sf_dir))


@query(f"""SELECT g.run, g.order_id, g.slot, count(i.initial_id) AS n, max(t.readings) AS readings, round(100.0*count(i.initial_id)/max(t.readings), 6) AS pct
FROM (SELECT * FROM (VALUES ('base'), ('instruct')) a(run), (VALUES ('o1'), ('o2')) b(order_id), (VALUES ('A'), ('B'), ('tie')) c(slot)) g
LEFT JOIN (SELECT *, coalesce(initial_label, 'tie') AS slot FROM ({LABELLED_SQL})) i ON i.run = g.run AND i.order_id = g.order_id AND i.slot = g.slot
LEFT JOIN (SELECT run, order_id, count(*) AS readings FROM ({INITIALS_SQL}) GROUP BY ALL) t ON t.run = g.run AND t.order_id = g.order_id GROUP BY ALL""")
def initial_choice_grid(spark, sf_dir):
    """Slots of every run and order, zeros included."""
    own = initials(spark, sf_dir).withColumn("slot", F.coalesce("initial_label", F.lit("tie")))
    n = own.groupBy("run", "order_id", "slot").agg(F.count(F.lit(1)).alias("n"))
    total = own.groupBy("run", "order_id").agg(F.count(F.lit(1)).alias("readings"))
    grid = spark.createDataFrame([(r, o, s) for r in ("base", "instruct") for o in ("o1", "o2") for s in ("A", "B", "tie")], "run string, order_id string, slot string")
    out = grid.join(n, ["run", "order_id", "slot"], "left").join(total, ["run", "order_id"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return out.select("run", "order_id", "slot", "n", "readings", F.round(100.0 * F.col("n") / F.col("readings"), 6).alias("pct"))


@query(f"""SELECT coalesce(a.order_id, 'all') AS order_id, count(*) AS readings, sum((a.initial_option = b.initial_option)::INT)::BIGINT AS same_option, count(*) FILTER (a.initial_label IS NULL OR b.initial_label IS NULL) AS with_tie
FROM ({LABELLED_SQL}) a JOIN ({LABELLED_SQL}) b ON a.initial_id = b.initial_id AND a.run = 'instruct' AND b.run = 'base' GROUP BY ROLLUP (a.order_id)""")
def agreement_with_reference(spark, sf_dir):
    """One run's choices against the other's, per order and in all."""
    own = initials(spark, sf_dir)
    a = own.filter("run = 'instruct'").select("initial_id", "order_id", "initial_label", "initial_option")
    b = own.filter("run = 'base'").select("initial_id", F.col("initial_label").alias("ref_label"), F.col("initial_option").alias("ref_option"))
    both = a.join(b, "initial_id").rollup("order_id").agg(F.count(F.lit(1)).alias("readings"), F.sum((F.col("initial_option") == F.col("ref_option")).cast("long")).alias("same_option"), F.sum((F.col("initial_label").isNull() | F.col("ref_label").isNull()).cast("long")).alias("with_tie"))
    return both.withColumn("order_id", F.coalesce("order_id", F.lit("all")))


RECORDED = ["m_before", "m_after", "movement", "final_label", "flip"]
ROW_KEYS = ["run", "initial_id", "opening_id", "condition", "marker_id"]


def _recomputed(spark, sf_dir) -> DataFrame:
    """The recorded fields by another path than the scores': from the signs and sizes of the logit differences alone."""
    rows = candidates(spark, sf_dir).withColumn("d", F.col("logit_a") - F.col("logit_b")).withColumn("e", F.col("after_a") - F.col("after_b")).filter("d <> 0")
    m_after = F.expr("-sign(d) * e")
    return rows.select(
        *ROW_KEYS, (-F.abs("d")).alias("m_before"), m_after.alias("m_after"), (m_after + F.abs("d")).alias("movement"), F.expr("CASE sign(e) WHEN 1 THEN 'A' WHEN -1 THEN 'B' END").alias("final_label"), F.expr("CASE WHEN e <> 0 THEN sign(d) <> sign(e) END").alias("flip")
    )


@query(f"SELECT run, initial_id, opening_id, condition, marker_id FROM ({SCORES_SQL}) WHERE FALSE")
def rescoring_mismatches(spark, sf_dir):
    """Recorded rows against their recomputation: none may differ."""
    return S.rescoring_mismatches(scores(spark, sf_dir), _recomputed(spark, sf_dir), ROW_KEYS, RECORDED).select(*ROW_KEYS)


@query(f"""SELECT run, initial_id, opening_id, condition, marker_id, CASE initial_id % 7 WHEN 0 THEN 'absent' WHEN 1 THEN 'm_after,movement' WHEN 2 THEN 'final_label' ELSE 'flip' END AS mismatched
FROM ({SCORES_SQL}) WHERE initial_id % 7 < 2 OR (initial_id % 7 = 2 AND final_label IS NOT NULL) OR (initial_id % 7 = 3 AND flip IS NULL)""")
def rescoring_planted(spark, sf_dir):
    """Recorded rows with planted differences: moved values, lost labels, invented flips, and rows that recompute to nothing."""
    k = F.col("initial_id") % 7
    own = scores(spark, sf_dir).withColumn("m_after", F.col("m_after") + F.when(k == 1, 0.0625).otherwise(0.0)).withColumn("movement", F.col("movement") + F.when(k == 1, 0.0625).otherwise(0.0))
    own = own.withColumn("final_label", F.when(k != 2, F.col("final_label"))).withColumn("flip", F.when(k == 3, F.coalesce("flip", F.lit(False))).otherwise(F.col("flip")))
    found = S.rescoring_mismatches(own, _recomputed(spark, sf_dir).filter(k != 0), ROW_KEYS, RECORDED)
    return found.select(*ROW_KEYS, F.array_join("mismatched", ",").alias("mismatched"))


def _kernel(spark, sf_dir) -> DataFrame:
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("nk"), F.col("n_regionkey").cast("string").alias("region"))
    who = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("decision_id"), F.col("c_nationkey").alias("nk")).join(F.broadcast(nation), "nk")
    v = blocks(spark, sf_dir).join(who, "decision_id")
    v = v.withColumn("decision_id", F.lpad(F.col("nk").cast("string"), 2, "0")).withColumn("domain", F.col("region"))
    keys = ["run", "outcome", "quantity"]
    return E.kernel_summaries(B.decision_values(v, keys, cells=False), keys, PLANNED_REPLICATES, SEED)


@query(None)
def kernel_bootstrap(spark, sf_dir):
    """The PCG64 kernel over nations as decisions (few, as in the design), both outcomes: no SQL form."""
    return _kernel(spark, sf_dir)


@query(None)
def kernel_holm(spark, sf_dir):
    return _planned_holm(_kernel(spark, sf_dir))
