"""Blocks: the six rows of an initial reading and an opening, as one row; cells and linear contrasts over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONDITIONS = ("RS", "RP", "NS", "NP")
ROWS_OF = {"RS": 2, "NS": 2, "RP": 1, "NP": 1}
#: Coefficients of the five contrasts over the four cells.
CONTRASTS = {
    "NS_minus_NP": {"NS": 1, "NP": -1},
    "RS_minus_RP": {"RS": 1, "RP": -1},
    "RS_minus_NS": {"RS": 1, "NS": -1},
    "RP_minus_NP": {"RP": 1, "NP": -1},
    "interaction": {"RS": 1, "RP": -1, "NS": -1, "NP": 1},
}
KEYS = ["run", "initial_id", "opening_id"]
CARRIED = ["decision_id", "domain", "order_id", "initial_option", "m_before"]


def build_blocks(scores: DataFrame) -> DataFrame:
    """One row per run, initial and opening: a styled cell is the mean of its two markers, a plain control enters once.

    A flip cell averages the defined flips of its rows and is null if there are none."""
    cells = []
    for c in CONDITIONS:
        mine = F.col("condition") == c
        cells += [
            F.avg(F.when(mine, F.col("movement"))).alias(f"mov_{c}"),
            F.avg(F.when(mine, F.col("flip").cast("double"))).alias(f"flip_{c}"),
            F.sum((mine & F.col("flip").isNotNull()).cast("long")).alias(f"flips_{c}"),
            F.sum(mine.cast("long")).alias(f"rows_{c}"),
        ]
    styled = F.when(F.col("condition").isin("RS", "NS"), F.struct("condition", "marker_family", "marker_id", "movement", F.col("flip").cast("double").alias("flip")))
    return scores.groupBy(*KEYS).agg(*(F.first(c).alias(c) for c in CARRIED), *cells, F.sort_array(F.collect_list(styled)).alias("markers"))


def block_problems(blocks: DataFrame) -> DataFrame:
    """Blocks that are not 2 RS, 2 NS, 1 RP, 1 NP."""
    bad = reduce(lambda a, b: a | b, (F.col(f"rows_{c}") != n for c, n in ROWS_OF.items()))
    return blocks.filter(bad).select(*KEYS, *(f"rows_{c}" for c in CONDITIONS))


def contrast(name: str, outcome: str) -> Column:
    """The contrast's value; a flip contrast is null unless every cell it uses is defined."""
    prefix = "mov" if outcome == "movement" else "flip"
    return reduce(lambda a, b: a + b, (F.lit(float(k)) * F.col(f"{prefix}_{c}") for c, k in CONTRASTS[name].items()))


def quantities(outcomes: tuple[str, ...] = ("movement", "flip"), cells: bool = True) -> list[tuple[str, str, str, Column, int, Column]]:
    """``outcome, kind, quantity``, value, movement rows and flip rows of everything that a block yields."""
    made = []
    for outcome in outcomes:
        prefix = "mov" if outcome == "movement" else "flip"
        named = [("contrast", name, tuple(coef), contrast(name, outcome)) for name, coef in CONTRASTS.items()]
        named += [("cell", c, (c,), F.col(f"{prefix}_{c}")) for c in CONDITIONS if cells]
        for kind, name, used, value in named:
            flips = reduce(lambda a, b: a + b, (F.col(f"flips_{c}") for c in used)) if outcome == "flip" else F.lit(0).cast("long")
            made.append((outcome, kind, name, value, sum(ROWS_OF[c] for c in used), flips))
    return made


def values(blocks: DataFrame, outcomes: tuple[str, ...] = ("movement", "flip"), cells: bool = True) -> DataFrame:
    """Long form: ``outcome, kind, quantity, value, n_movement_rows, n_flip_rows`` of each block, without null values."""
    made = [F.struct(F.lit(o).alias("outcome"), F.lit(k).alias("kind"), F.lit(q).alias("quantity"), v.alias("value"), F.lit(n).cast("long").alias("n_movement_rows"), f.alias("n_flip_rows")) for o, k, q, v, n, f in quantities(outcomes, cells)]
    return blocks.select("*", F.inline(F.array(*made))).filter(F.col("value").isNotNull())


def decision_values(blocks: DataFrame, keys: list[str], outcomes: tuple[str, ...] = ("movement", "flip"), cells: bool = True) -> DataFrame:
    """Per statistic and decision: mean block value, its block count, row counts, and the initials it rests on.

    All quantities of an initial, then of a decision, are summed side by side in one row; only the few rows of decisions
    are turned into one row a quantity.  ``keys``: columns of the blocks, and of ``outcome, kind, quantity``.  Blocks without
    a domain give decisions without one."""
    by, made = [k for k in keys if k not in ("outcome", "kind", "quantity")], quantities(outcomes, cells)
    by = [*dict.fromkeys([*by, "decision_id", *(c for c in ("domain",) if c in blocks.columns)])]
    rows = blocks.select(*dict.fromkeys([*by, "run", "initial_id"]), *(c.alias(f"{n}{i}") for i, (*_, v, _, f) in enumerate(made) for n, c in (("v", v), ("f", f))))
    initial = rows.groupBy(*dict.fromkeys([*by, "run", "initial_id"])).agg(
        *(c.alias(f"{n}{i}") for i in range(len(made)) for n, c in (("s", F.sum(f"v{i}")), ("n", F.count(f"v{i}")), ("f", F.sum(F.when(F.col(f"v{i}").isNotNull(), F.col(f"f{i}"))))))
    )
    decision = initial.groupBy(*by).agg(
        *(c.alias(f"{n}{i}") for i in range(len(made)) for n, c in (("s", F.sum(f"s{i}")), ("n", F.sum(f"n{i}")), ("f", F.sum(f"f{i}")), ("i", F.count_if(F.col(f"n{i}") > 0))))
    )
    each = [
        F.struct(F.lit(o).alias("outcome"), F.lit(k).alias("kind"), F.lit(q).alias("quantity"), (F.col(f"s{i}") / F.nullif(F.col(f"n{i}"), F.lit(0))).alias("decision_value"), F.col(f"n{i}").alias("blocks"), (n * F.col(f"n{i}")).cast("long").alias("movement_rows"), F.col(f"f{i}").alias("flip_rows"), F.col(f"i{i}").alias("initials"))
        for i, (o, k, q, _, n, _) in enumerate(made)
    ]
    return decision.select(*by, F.inline(F.array(*each))).filter("blocks > 0")


def marker_values(blocks: DataFrame, outcome: str = "movement") -> DataFrame:
    """Per block and marker the four marker contrasts against the block's own shared controls."""
    field = "movement" if outcome == "movement" else "flip"
    prefix = "mov" if outcome == "movement" else "flip"
    pick = lambda c: F.filter("markers", lambda m: (m["condition"] == c) & (m["marker_id"] == F.col("marker_id")))[0][field]
    each = blocks.withColumn("marker", F.explode(F.array_distinct(F.transform("markers", lambda m: F.struct(m["marker_family"].alias("family"), m["marker_id"].alias("id"))))))
    each = each.withColumn("marker_family", F.col("marker.family")).withColumn("marker_id", F.col("marker.id")).withColumn("rs", pick("RS")).withColumn("ns", pick("NS"))
    rp, np_ = F.col(f"{prefix}_RP"), F.col(f"{prefix}_NP")
    named = {"NS_minus_NP": F.col("ns") - np_, "RS_minus_RP": F.col("rs") - rp, "RS_minus_NS": F.col("rs") - F.col("ns"), "interaction": (F.col("rs") - rp) - (F.col("ns") - np_)}
    made = [F.struct(F.lit(outcome).alias("outcome"), F.lit(q).alias("quantity"), v.alias("value")) for q, v in named.items()]
    return each.drop("marker", "markers").select("*", F.inline(F.array(*made))).filter(F.col("value").isNotNull())
