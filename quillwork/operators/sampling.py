"""Stratified samples, balanced assignment, order with separation, and checks of allocations."""

from __future__ import annotations

import random
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillwork.functions.hashing import hash_order


def largest_remainder(counts: DataFrame, stratum: str, n: str, num: int, den: int) -> DataFrame:
    """Quota of each stratum for a sample of num/den: floors by integer arithmetic, the rest to the largest remainders.

    The total is rounded half to even; equal remainders go by stratum."""
    total = F.sum(n).over(Window.partitionBy())
    exact = (F.col(n) * num - F.col(n) * num % den) / den
    whole = counts.withColumn("floor_quota", exact.cast("long")).withColumn("remainder", (F.col(n) * num % den).cast("long"))
    whole = whole.withColumn("target", F.bround(total * num / den).cast("long")).withColumn("spare", F.col("target") - F.sum("floor_quota").over(Window.partitionBy()))
    place = F.row_number().over(Window.orderBy(F.col("remainder").desc(), F.col(stratum)))
    return whole.withColumn("place", place).select(stratum, n, "floor_quota", "remainder", (F.col("floor_quota") + (F.col("place") <= F.col("spare")).cast("long")).alias("quota"))


def stratified_pick(units: DataFrame, quotas: DataFrame, stratum: str, unit: str, seed: int, salt: str) -> DataFrame:
    """The first ``quota`` units of each stratum in a seeded hash order."""
    mark = hash_order(seed, salt, F.col(unit))
    place = F.row_number().over(Window.partitionBy(stratum).orderBy(mark, F.col(unit)))
    return units.withColumn("place", place).join(quotas.select(stratum, "quota"), stratum).filter("place <= quota").drop("quota")


def blind_ids(units: DataFrame, unit: str, prefix: str, seed: int) -> DataFrame:
    """Sequence labels in hash order, of five digits or as many as the number has, and a side flip by hash parity."""
    mark = hash_order(seed, prefix, F.col(unit))
    place = F.row_number().over(Window.orderBy(mark, F.col(unit)))
    flip = F.conv(F.substring(mark, 32, 1), 16, 10).cast("int") % 2 == 1
    return units.withColumn("blind_id", F.concat(F.lit(prefix), F.format_string("%05d", place))).withColumn("flipped", flip)


def min_gap(rows: DataFrame, key: str, position: str) -> DataFrame:
    """Least distance of neighbours with the same key."""
    gap = F.col(position) - F.lag(position).over(Window.partitionBy(key).orderBy(position))
    return rows.withColumn("_gap", gap).groupBy(key).agg(F.min("_gap").alias("min_gap")).filter("min_gap IS NOT NULL")


def alternating(rows: DataFrame, by: list[str], order: list[Column], names: tuple[str, str]) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("assigned", F.when(place % 2 == 1, names[0]).otherwise(names[1]))


def separated_order(sizes: dict[str, int], minimum: int, seed: int, tries: int = 2000, nodes: int = 200_000) -> tuple[str, list[str]]:
    """An order of group members in which members of a group are at least ``minimum`` places apart (driver search).

    Returns (``random``, ``search``, ``infeasible`` or ``gave_up``, order)."""
    rng, pool = random.Random(seed), [g for g, n in sorted(sizes.items()) for _ in range(n)]

    def ok(order: list[str]) -> bool:
        last: dict[str, int] = {}
        for i, g in enumerate(order):
            if g in last and i - last[g] < minimum:
                return False
            last[g] = i
        return True

    if sizes and len(pool) < (max(sizes.values()) - 1) * minimum + 1:
        return "infeasible", []
    for _ in range(tries):
        rng.shuffle(pool)
        if ok(pool):
            return "random", list(pool)
    left, order, last, seen = dict(sizes), [], {}, 0

    def place() -> bool | None:
        nonlocal seen
        if len(order) == len(pool):
            return True
        seen += 1
        if seen > nodes:
            return None
        for g in sorted((g for g in left if left[g]), key=lambda g: (-left[g], g)):
            if g in last and len(order) - last[g] < minimum:
                continue
            before = last.get(g)
            left[g] -= 1
            last[g] = len(order)
            order.append(g)
            found = place()
            if found or found is None:
                return found
            order.pop()
            left[g] += 1
            if before is None:
                del last[g]
            else:
                last[g] = before
        return False

    found = place()
    return ("search", order) if found else ("infeasible", []) if found is False else ("gave_up", [])


def exact_quotas(sizes: dict[str, int], fraction: Fraction) -> dict[str, int]:
    """Largest-remainder quotas with exact fractions (driver side)."""
    want = {k: n * fraction for k, n in sizes.items()}
    out = {k: int(v) for k, v in want.items()}
    spare = round(sum(want.values())) - sum(out.values())
    for k in sorted(sizes, key=lambda k: (-(want[k] - out[k]), k))[:spare]:
        out[k] += 1
    return out
