"""The bootstrap queries take all planned replicates of both outcomes; their limits are those of the SQL engine."""

import numpy as np
from helpers import DATA
from pyspark.sql import functions as F

from quillwork.operators import estimate as E
from quillwork.plans.queries import QUERIES, SQL


def test_intervals_take_all_replicates(spark):
    rows = QUERIES["bootstrap_intervals"](spark, DATA).collect()
    assert len(rows) == 20 and {r["outcome"] for r in rows} == {"movement", "flip"}
    assert {r["replicates_defined"] for r in rows} == {9999}
    assert "range(0, 9999)" in SQL["bootstrap_intervals"] and "range(0, 60)" not in SQL["bootstrap_intervals"]


def test_holm_takes_all_replicates(spark):
    """Families of four of each run and outcome, with p-values in steps of 2 / 10,000 (of 2 / 61 at 60 replicates)."""
    rows = QUERIES["holm_adjusted"](spark, DATA).collect()
    assert len(rows) == 16 and {r["outcome"] for r in rows} == {"movement", "flip"} and {r["family_size"] for r in rows} == {4}
    assert all(abs(r["p_boot"] * 5000 - round(r["p_boot"] * 5000)) < 1e-9 for r in rows)
    assert "range(0, 9999)" in SQL["holm_adjusted"] and "range(0, 60)" not in SQL["holm_adjusted"]


def test_limits_halfway_between_numbers(spark, duck):
    """Interpolated limits that fall between two numbers of six digits are rounded as in DuckDB."""
    rng = np.random.default_rng(3)
    rows = [(g, int(k) / 1e6) for g in range(400) for k in rng.integers(-300, 300, 21 if g % 2 else 101)]
    got = {r["g"]: (r["ci_low"], r["ci_high"]) for r in E.summarise(spark.createDataFrame(rows, "g int, replicate_estimate double"), ["g"]).collect()}
    for g, limits in got.items():
        want = duck.execute("SELECT round(quantile_cont(e, 0.025), 6), round(quantile_cont(e, 0.975), 6) FROM (SELECT unnest(?) AS e)", [[e for h, e in rows if h == g]]).fetchone()
        assert limits == want


def test_estimates_of_keys_with_other_decisions(spark):
    """Keys that lack different decisions have masses of their own, beside counts of single decisions."""
    who = spark.range(2600).selectExpr("id AS decision_id", "if(id % 10 = 0, 'x', 'y') AS domain")
    per = who.selectExpr("explode(array('a', 'b', 'c')) AS run", "decision_id", "decision_id % 13 / 8.0D AS decision_value").filter("run = 'c' OR (run = 'a' AND decision_id % 7 > 0) OR (run = 'b' AND decision_id > 1200)")
    got = {(r["run"], r["replicate"]): r["replicate_estimate"] for r in E.replicate_estimates(per, who, 11, 3, ["run"]).collect()}
    both = E.hash_draws(who, 11, 3).join(per, "decision_id").groupBy("run", "replicate").agg((F.sum(F.col("weight") * F.col("decision_value")) / F.sum("weight")).alias("e"))
    want = {(r["run"], r["replicate"]): r["e"] for r in both.collect()}
    assert len(want) == 33 and got.keys() == want.keys() and np.allclose([got[k] for k in want], [*want.values()], atol=1e-12)
