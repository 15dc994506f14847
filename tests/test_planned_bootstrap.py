"""The bootstrap with its planned parameters, against loops."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
from helpers import DATA, rows_of
from pyspark.sql import functions as F

from quillwork.operators import blocks as B
from quillwork.operators import estimate as E
from quillwork.plans import outcomes as O
from quillwork.plans.queries import QUERIES
from quillwork.plans.roles import decisions


def draws(spark, replicates):
    domains = defaultdict(list)
    for r in decisions(spark, DATA).collect():
        domains[r["domain"]].append(r["decision_id"])
    out = [Counter() for _ in range(replicates)]
    for d, ids in domains.items():
        ids = sorted(ids)
        for b in range(replicates):
            for p in range(len(ids)):
                out[b][ids[int(hashlib.md5(f"{O.SEED}|{d}|{b}|{p}".encode()).hexdigest()[:8], 16) % len(ids)]] += 1
    return out


def test_both_outcomes_equal_a_loop(spark):
    n = 15
    weights, values = draws(spark, n), defaultdict(lambda: defaultdict(list))
    for r in B.values(O.blocks(spark, DATA), cells=False).collect():
        values[r["run"], r["outcome"], r["quantity"]][r["decision_id"]].append(r["value"])
    want = {}
    for k, per in values.items():
        mean = {d: sum(v) / len(v) for d, v in per.items()}
        e = np.array([round(sum(w[d] * x for d, x in mean.items()) / sum(w[d] for d in mean), 6) for w in weights])
        want[k] = (*np.quantile(e, [0.025, 0.975]), n, min(1, 2 * min((e <= 0).sum() + 1, (e >= 0).sum() + 1) / (n + 1)))
    got = {(r["run"], r["outcome"], r["quantity"]): (r["ci_low"], r["ci_high"], r["replicates_defined"], r["p_boot"]) for r in O._planned_boot(spark, DATA, n).collect()}
    assert len(got) == 20 and got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k], atol=2e-6) for k in want)


def test_planned_counts(spark):
    rows = QUERIES["bootstrap_counts_planned"](spark, DATA)
    assert rows.agg(F.countDistinct("replicate")).first()[0] == 9999
    want = {(b, d): w for b, x in enumerate(draws(spark, 3)) for d, w in x.items()}
    assert {(r["replicate"], r["decision_id"]): r["weight"] for r in rows.filter("replicate < 3").collect()} == want


def test_kernel_has_planned_parameters(spark):
    rows = QUERIES["kernel_bootstrap"](spark, DATA).collect()
    assert {r["outcome"] for r in rows} == {"movement", "flip"} and {r["replicates_defined"] for r in rows} == {9999}
    families = Counter((r["run"], r["outcome"]) for r in QUERIES["kernel_holm"](spark, DATA).collect())
    assert len(families) == 4 and set(families.values()) == {4}


def test_a_clear_effect_is_significant(spark):
    per = spark.createDataFrame([("base", "flip", q, f"d{i}", "x", 1.0 + i / 9) for q in B.CONTRASTS for i in range(9)], "run string, outcome string, quantity string, decision_id string, domain string, decision_value double")
    found = O._planned_holm(E.kernel_summaries(per, ["run", "outcome", "quantity"], O.PLANNED_REPLICATES, O.SEED))
    assert {r[-1] for r in rows_of(found)} == {0.0008}


def test_many_draws_are_counted_without_rows(spark):
    """Counts of a domain with numbers of one to six digits, and of a prefix that md5 takes in two blocks, against single digests."""
    from quillwork.operators import draws as D

    for prefix, n in (("7|ASIA|12|", 100_050), ("x" * 60, 120)):
        want = Counter(int(hashlib.md5(f"{prefix}{p}".encode()).hexdigest()[:8], 16) % n for p in range(n))
        assert dict(enumerate(D.counted(prefix.encode(), n).tolist())) == {i: want[i] for i in range(n)}
    rows = spark.range(3000).selectExpr("id AS decision_id", "if(id % 3 = 0, 'x', 'y') AS domain")
    got = E.hash_draws(rows, 4, 9)
    assert got.groupBy("replicate", "domain").agg(F.sum("weight").alias("w")).filter("w <> if(domain = 'x', 1000, 2000)").count() == 0
    assert got.select("replicate", "decision_id").distinct().count() == got.count()


def test_counts_are_not_broadcast(spark):
    """Counts grow with decisions times replicates; their estimated size, that of the domains, must not send them to the driver."""
    for name in ("bootstrap_counts", "bootstrap_intervals", "holm_adjusted"):
        rows = QUERIES[name](spark, DATA)
        assert rows.collect()
        lines = rows._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0].splitlines()
        depth = [re.match(r"[ :+-]*", x).end() for x in lines]
        assert sum("MapInArrow" in x for x in lines)
        for i, x in enumerate(lines):
            if "BroadcastExchange" in x:
                under = lines[i + 1 : next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))]
                assert not any("MapInArrow" in y for y in under), name


def test_blocks_without_a_domain(spark):
    """Decisions' values are the same without the domain, which only the draws need."""
    b, keys = O.blocks(spark, DATA), ["run", "outcome", "quantity"]
    got = B.decision_values(b.drop("domain"), keys, cells=False)
    assert "domain" not in got.columns
    assert rows_of(got) == rows_of(B.decision_values(b, keys, cells=False).drop("domain"))


def test_scored_rows_stay_in_their_task(spark):
    """The rows that are made of an order meet where they are made, and decisions are placed once."""
    for name in ("bootstrap_intervals", "holm_adjusted"):
        rows = QUERIES[name](spark, DATA)
        assert rows.collect()
        lines = rows._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0].splitlines()
        assert any("Exchange hashpartitioning" in x for x in lines)
        assert not any("Exchange hashpartitioning" in x and "opening_id" in x for x in lines), name
        assert sum("row_number() windowspecdefinition(domain" in x for x in lines) == 1, name


def test_estimates_over_several_blocks(spark):
    """Blocks' widths, the last one's too, against the counts of single decisions; some decisions have no value."""
    who = spark.range(1500).selectExpr("id AS decision_id", "if(id % 10 = 0, 'x', 'y') AS domain")
    per = who.filter("decision_id % 7 > 0").selectExpr("'base' AS run", "decision_id", "decision_id % 13 / 8.0D AS decision_value")
    got = {r["replicate"]: r["replicate_estimate"] for r in E.replicate_estimates(per, who, 5, 3, ["run"]).collect()}
    both = E.hash_draws(who, 5, 3).join(per, "decision_id").groupBy("replicate").agg((F.sum(F.col("weight") * F.col("decision_value")) / F.sum("weight")).alias("e"))
    want = {r["replicate"]: r["e"] for r in both.collect()}
    assert len(want) == 5 and got.keys() == want.keys() and np.allclose([got[k] for k in want], [*want.values()], atol=1e-12)
