"""Balanced allocations of markers to groups: a search on the driver, and its check as queries."""

from __future__ import annotations

import math
import random
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwork.functions import text as T
from quillwork.operators.checks import findings, union

POSITIONS = ((1, "opt_1"), (1, "opt_2"), (2, "opt_1"), (2, "opt_2"))


def solve(decisions: list[tuple[str, str]], families: dict[str, list[str]], seed: int, iterations: int = 400_000) -> list[tuple[str, str, int, str, str, str]]:
    """``decision, domain, variant, option, family, marker`` rows: each decision gets four different markers of a family,
    every four-marker subset equally often, and positions and domains as even as annealed swaps make them.

    Two kinds of move keep the subsets balanced: decisions exchange their subsets, or a decision permutes its four.
    The cost is the squared deviation of marker counts by position and by domain from their means."""
    rng, rows = random.Random(seed), []
    for family, markers in sorted(families.items()):
        subsets = list(combinations(sorted(markers), 4))
        if len(decisions) % len(subsets):
            raise ValueError("decisions must be a multiple of the number of four-marker subsets")
        order = [list(s) for s in subsets for _ in range(len(decisions) // len(subsets))]
        rng.shuffle(order)
        for own in order:
            rng.shuffle(own)
        where = {m: i for i, m in enumerate(sorted(markers))}
        domains = sorted({d for _, d in decisions})
        at = {d: i for i, d in enumerate(domains)}
        place = [[0] * 4 for _ in markers]
        area = [[0] * len(domains) for _ in markers]
        for (_, d), own in zip(decisions, order):
            for p, m in enumerate(own):
                place[where[m]][p] += 1
                area[where[m]][at[d]] += 1
        mean_p, mean_d = len(decisions) / len(markers), 4 * len(decisions) / len(markers) / len(domains)
        cost = lambda: sum((x - mean_p) ** 2 for r in place for x in r) + sum((x - mean_d) ** 2 for r in area for x in r)
        least = sum(min((math.floor(mean_d) - mean_d) ** 2, (math.ceil(mean_d) - mean_d) ** 2) for _ in markers for _ in domains)
        now = cost()

        def put(i: int, own: list[str], sign: int) -> None:
            for p, m in enumerate(own):
                place[where[m]][p] += sign
                area[where[m]][at[decisions[i][1]]] += sign

        for step in range(iterations):
            if now <= least + 1e-9:
                break
            heat = 2.0 * (1 - step / iterations) + 1e-3
            i, j = rng.randrange(len(order)), rng.randrange(len(order))
            a, b = order[i], order[j]
            if rng.random() < 0.5 and i != j:
                new_i, new_j = list(b), list(a)
            else:
                j, b = i, a
                x, y = rng.sample(range(4), 2)
                new_i = list(a)
                new_i[x], new_i[y] = new_i[y], new_i[x]
                new_j = new_i
            touched = {i: (a, new_i)} if i == j else {i: (a, new_i), j: (b, new_j)}
            for k, (old, new) in touched.items():
                put(k, old, -1), put(k, new, 1)
            then = cost()
            if then <= now or rng.random() < math.exp((now - then) / heat):
                now = then
                for k, (_, new) in touched.items():
                    order[k] = new
            else:
                for k, (old, new) in touched.items():
                    put(k, new, -1), put(k, old, 1)
        for (decision, domain), own in zip(decisions, order):
            rows += [(decision, domain, v, o, family, m) for (v, o), m in zip(POSITIONS, own)]
    return rows


def problems(rows: DataFrame, decisions: int = 60) -> DataFrame:
    """Findings of an allocation (``decision_id, domain, variant_id, supported_option, family, marker``), apart from the search."""
    size = rows.groupBy("family").agg(F.countDistinct("marker").alias("markers"))
    per = rows.groupBy("decision_id", "family").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("marker")).alias("own"), F.countDistinct("variant_id", "supported_option").alias("places"))
    subset = per.groupBy("family", "own").agg(F.count(F.lit(1)).alias("times"))
    spread = subset.groupBy("family").agg(F.min("times").alias("lo"), F.max("times").alias("hi"), F.count(F.lit(1)).alias("used")).join(size, "family")
    count = rows.groupBy("family", "marker").agg(F.count(F.lit(1)).alias("groups"), F.countDistinct("decision_id").alias("decisions")).join(size, "family")
    place = rows.groupBy("family", "marker", "variant_id", "supported_option").agg(F.count(F.lit(1)).alias("n")).join(size, "family")
    area = rows.groupBy("family", "marker", "domain").agg(F.count(F.lit(1)).alias("n")).join(size, "family").crossJoin(rows.agg(F.countDistinct("domain").alias("domains")))
    mean = F.lit(4.0 * decisions) / F.col("markers")
    pairs = per.select("family", F.inline(F.flatten(F.transform("own", lambda a: F.transform(F.filter("own", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b"))))))).groupBy("family", "a", "b").agg(F.count(F.lit(1)).alias("n")).join(size, "family")
    together = F.lit(6.0 * decisions) / (F.col("markers") * (F.col("markers") - 1) / 2)
    n_subsets = F.col("markers") * (F.col("markers") - 1) * (F.col("markers") - 2) * (F.col("markers") - 3) / 24
    return union(
        findings(rows.agg(F.countDistinct("decision_id").alias("n")).filter(F.col("n") != decisions), "E_DECISIONS", "allocation", F.lit("all"), F.col("n")),
        findings(per.filter("n <> 4 OR size(own) <> 4 OR places <> 4"), "E_FOUR_POSITIONS", "decision", F.concat_ws("/", "decision_id", "family")),
        findings(spread.filter((F.col("lo") != F.col("hi")) | (F.col("used") != n_subsets)), "E_SUBSETS_UNEVEN", "family", F.col("family")),
        findings(count.filter((F.col("groups") != mean) | (F.col("decisions") != mean)), "E_MARKER_COUNT", "marker", F.col("marker"), F.col("groups")),
        findings(place.filter(F.col("n") != mean / 4), "E_POSITION_COUNT", "marker", F.concat_ws("/", "marker", "variant_id", "supported_option"), F.col("n")),
        findings(area.filter((F.col("n") < F.floor(mean / F.col("domains"))) | (F.col("n") > F.ceil(mean / F.col("domains")))), "E_DOMAIN_COUNT", "marker", F.concat_ws("/", "marker", "domain"), F.col("n")),
        findings(pairs.filter(F.col("n") != together), "E_COOCCURRENCE", "pair", F.concat_ws("+", "a", "b"), F.col("n")),
    )


def collisions(scenarios: DataFrame, markers: DataFrame) -> DataFrame:
    """``scenario_id, marker`` where the marker's text already occurs in the scenario with no letter A to Z beside it.

    A join on the marker's first run of letters, which must be a whole run of letters of the scenario, proposes; the
    whole marker then decides.  Markers without such a start meet every scenario."""
    run = F.regexp_extract(F.lower("marker"), "^([a-z]+)", 1)
    own = markers.select("marker").distinct().withColumn("_word", run)
    runs = F.array_union(F.array(F.lit("")), F.regexp_extract_all(F.lower("scenario_text"), F.lit("([a-z]+)"), F.lit(1)))
    return scenarios.select("scenario_id", "scenario_text", F.explode(runs).alias("_word")).join(own, "_word").filter(T.contains_phrase(F.col("scenario_text"), F.col("marker"))).select("scenario_id", "marker")
