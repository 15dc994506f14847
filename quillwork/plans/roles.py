"""The driver's tables in the roles of an experiment.

Decision: the customer; domain: its region; initial reading: an order, under two runs; order of the options: its parity;
openings and the six cells: literals.  Logits come from integer arithmetic on a grid of 1/16, so that sums are exact and
exact ties occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.operators.scoring import argmax_label, opposite_label, option_of, score_movement

RUNS = (("base", 0), ("instruct", 1))
OPENINGS = (("p1", 0), ("p2", 1), ("p3", 2))
#: condition, family (none for plain cells), number of the cell.
CELLS = (("RS", "conclusion", 0), ("RS", "logic", 1), ("NS", "conclusion", 2), ("NS", "logic", 3), ("RP", "none", 4), ("NP", "none", 5))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid(value: Column, modulus: int) -> Column:
    return (value % modulus - modulus // 2) / F.lit(16.0)


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``decision_id, domain`` of every customer; nation and region are fixed tables of 25 and 5 rows."""
    place = load(spark, sf_dir, "nation").join(F.broadcast(load(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    return load(spark, sf_dir, "customer").join(F.broadcast(place), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("decision_id"), F.col("r_name").alias("domain"))


def _literal(rows: tuple, names: str) -> Column:
    return F.inline(F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(r, names.split()))) for r in rows)))


def initials(spark: SparkSession, sf_dir: str, together: bool = False) -> DataFrame:
    """One row per run and order.  ``together``: orders are dealt by their key, so that what is made of one stays in its task."""
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("initial_id"), F.col("o_custkey").alias("decision_id"))
    rows = o.join(decisions(spark, sf_dir), "decision_id")
    if together:
        rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "initial_id")
    rows = rows.select("*", _literal(RUNS, "run r"))
    k, c, r = F.col("initial_id"), F.col("decision_id"), F.col("r")
    rows = rows.withColumn("order_id", F.when(k % 2 == 0, "o1").otherwise("o2")).withColumn("logit_a", grid(k * 7 + 3 + r * 5, 33)).withColumn("logit_b", grid(k * 13 + c + r * 11, 33))
    label = argmax_label(F.col("logit_a"), F.col("logit_b"))
    return rows.withColumn("initial_label", label).withColumn("initial_option", option_of(label, F.col("order_id")))


def candidates(spark: SparkSession, sf_dir: str, together: bool = False) -> DataFrame:
    """Every order, run, opening and cell, for either required label: the plan before selection."""
    rows = initials(spark, sf_dir, together).select("run", "r", "initial_id", "decision_id", "domain", "order_id", "logit_a", "logit_b", "initial_option", "initial_label")
    rows = rows.select("*", _literal(OPENINGS, "opening_id p")).select("*", _literal(CELLS, "condition marker_family cell"))
    k, c, r = F.col("initial_id"), F.col("decision_id"), F.col("r")
    number = (c % 3 + 1).cast("string")
    marker = F.when(F.col("marker_family") == "none", "none").otherwise(F.concat(F.col("marker_family"), F.lit("_"), number))
    return rows.withColumn("marker_id", marker).withColumn("after_a", grid(k * 11 + F.col("cell") * 5 + F.col("p") * 3 + r * 7, 41)).withColumn("after_b", grid(k * 17 + F.col("cell") * 2 + F.col("p") * 13 + c, 41))


def scores(spark: SparkSession, sf_dir: str, together: bool = False) -> DataFrame:
    """The scored rows of the readings without an initial tie."""
    rows = candidates(spark, sf_dir, together).filter(F.col("initial_label").isNotNull()).withColumn("counter_target_label", opposite_label(F.col("initial_label")))
    return score_movement(rows)


#: The same tables as DuckDB SQL, for the oracle.
INITIALS_SQL = """
SELECT o_orderkey AS initial_id, o_custkey AS decision_id, r_name AS domain, run, r,
  CASE WHEN o_orderkey % 2 = 0 THEN 'o1' ELSE 'o2' END AS order_id,
  ((o_orderkey*7 + 3 + r*5) % 33 - 16) / 16.0::DOUBLE AS logit_a, ((o_orderkey*13 + o_custkey + r*11) % 33 - 16) / 16.0::DOUBLE AS logit_b
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey,
  (VALUES ('base', 0), ('instruct', 1)) AS runs(run, r)
"""
LABELLED_SQL = f"""
SELECT *, CASE WHEN initial_label IS NULL THEN NULL WHEN (initial_label = 'A') = (order_id = 'o1') THEN 'opt_1' ELSE 'opt_2' END AS initial_option
FROM (SELECT *, CASE WHEN logit_a = logit_b THEN NULL WHEN logit_a > logit_b THEN 'A' ELSE 'B' END AS initial_label FROM ({INITIALS_SQL}))
"""
SCORES_SQL = f"""
SELECT *, m_after - m_before AS movement, final_label = counter_target_label AS flip, abs(m_before) < ln(0.6::DOUBLE/0.4::DOUBLE) AS initial_near_tie, after_a = after_b AS post_exact_tie FROM (
SELECT *, CASE WHEN counter_target_label = 'A' THEN logit_a - logit_b ELSE logit_b - logit_a END AS m_before,
  CASE WHEN counter_target_label = 'A' THEN after_a - after_b ELSE after_b - after_a END AS m_after,
  CASE WHEN after_a = after_b THEN NULL WHEN after_a > after_b THEN 'A' ELSE 'B' END AS final_label FROM (
SELECT i.*, opening_id, condition, marker_family, CASE WHEN marker_family = 'none' THEN 'none' ELSE marker_family || '_' || (decision_id % 3 + 1)::VARCHAR END AS marker_id,
  CASE WHEN initial_label = 'A' THEN 'B' ELSE 'A' END AS counter_target_label,
  ((initial_id*11 + cell*5 + p*3 + r*7) % 41 - 20) / 16.0::DOUBLE AS after_a, ((initial_id*17 + cell*2 + p*13 + decision_id) % 41 - 20) / 16.0::DOUBLE AS after_b
FROM ({LABELLED_SQL}) i, (VALUES ('p1', 0), ('p2', 1), ('p3', 2)) AS openings(opening_id, p),
  (VALUES ('RS','conclusion',0), ('RS','logic',1), ('NS','conclusion',2), ('NS','logic',3), ('RP','none',4), ('NP','none',5)) AS cells(condition, marker_family, cell)
WHERE initial_label IS NOT NULL))
"""
_CELL_SQL = ",\n  ".join(f"avg(movement) FILTER (condition = '{c}') AS mov_{c}, avg(flip::INT::DOUBLE) FILTER (condition = '{c}') AS flip_{c}, count(flip) FILTER (condition = '{c}') AS flips_{c}" for c in ("RS", "RP", "NS", "NP"))
BLOCKS_SQL = f"""
SELECT run, initial_id, opening_id, min(decision_id) AS decision_id, min(domain) AS domain, min(order_id) AS order_id, min(initial_option) AS initial_option, min(m_before) AS m_before,
  {_CELL_SQL}
FROM ({SCORES_SQL}) GROUP BY ALL
"""
