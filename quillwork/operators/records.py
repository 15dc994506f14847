"""Small operators over records: overlays, references, ranks, unit counts, differences, displays, identifiers."""

from __future__ import annotations

import difflib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwork.functions.hashing import row_hash


def overlay(layers: list[DataFrame], keys: list[str]) -> DataFrame:
    """One row a key, of the first layer that has it; layers have the same columns.  A key twice in a layer keeps the least row."""
    rest = [c for c in layers[0].columns if c not in keys]
    ranked = reduce(DataFrame.unionByName, (d.withColumn("_layer", F.lit(i)) for i, d in enumerate(layers)))
    first = F.min(F.struct("_layer", *rest)).alias("first")
    return ranked.groupBy(*keys).agg(first).select(*keys, *(F.col(f"first.{c}") for c in rest))


def shared_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that both sides have, where none may be."""
    return a.select(*keys).intersect(b.select(*keys))


def rank_of(c: Column, order: tuple[str, ...]) -> Column:
    """Place of a value in a fixed order; others come after all."""
    return F.coalesce(F.element_at(F.create_map(*(x for i, v in enumerate(order) for x in (F.lit(v), F.lit(i)))), c), F.lit(len(order)))


def first_with(rows: DataFrame, mark: str, place: list[str]) -> DataFrame:
    """The least place that carries each mark."""
    return rows.groupBy(mark).agg(F.min(F.struct(*place)).alias("first")).select(mark, *(F.col(f"first.{c}").alias(f"first_{c}") for c in place))


def unit_counts(rows: DataFrame, levels: list[str]) -> DataFrame:
    """``level, rating, units``: how often each rating of each level is given; no rating is no unit."""
    each = F.inline(F.array(*(F.struct(F.lit(c).alias("level"), F.col(c).cast("string").alias("rating")) for c in levels)))
    return rows.select(each).filter("rating IS NOT NULL").groupBy("level", "rating").agg(F.count(F.lit(1)).alias("units"))


def coverage(sample: DataFrame, facets: list[str], decision: str) -> DataFrame:
    """``facet, level, n``: sampled rows of each level of each facet, and as facet ``most`` the most of one decision."""
    each = F.inline(F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("level")) for c in facets)))
    counts = sample.select(each).groupBy("facet", "level").agg(F.count(F.lit(1)).alias("n"))
    most = sample.groupBy(decision).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n"))
    return counts.unionByName(most.select(F.lit("most").alias("facet"), F.lit(decision).alias("level"), "n"))


def differences_to_control(rows: DataFrame, control: DataFrame, on: list[str], mark: str, value: str) -> DataFrame:
    """Per mark the sorted distinct differences of a row's value to that of its control, as text."""
    both = rows.join(control.select(*on, F.col(value).alias("_control")), on)
    return both.groupBy(mark).agg(F.array_join(F.transform(F.sort_array(F.collect_set((F.col(value) - F.col("_control")).cast("long"))), lambda x: x.cast("string")), ",").alias("differences"))


def recorded(tables: list[DataFrame], key: str) -> DataFrame:
    """How many records of all tables together a key has."""
    return reduce(DataFrame.unionByName, (t.groupBy(key).agg(F.count(F.lit(1)).alias("n")) for t in tables)).groupBy(key).agg(F.sum("n").alias("records"))


def length_diagnostics(rows: DataFrame, group: str, words: str, ratio: float) -> DataFrame:
    """Per group the shortest and longest text, their ratio, how long the longest may be for the shortest and how short
    the shortest for the longest, and how many texts are over the first bound."""
    per = rows.groupBy(group).agg(F.min(words).alias("shortest"), F.max(words).alias("longest"))
    per = per.withColumn("ratio", F.round(F.col("longest") / F.nullif(F.col("shortest"), F.lit(0)), 4)).withColumn("most", F.floor(F.col("shortest") * ratio)).withColumn("least", F.ceil(F.col("longest") / ratio))
    over = rows.join(per.select(group, "most"), group).groupBy(group).agg(F.count_if(F.col(words) > F.col("most")).alias("offenders"))
    return per.join(over, group)


def back_references(controls: DataFrame, rows: DataFrame, key: str, listed: str, refers: str) -> DataFrame:
    """Controls whose list (an array) is not exactly the rows that refer to them: ``key, missing, unknown`` counts.

    Lists and references are counted pair by pair, so a control with very many rows is no array anywhere."""
    want = controls.select(F.col(key).alias("control"), F.explode(listed).alias("row")).withColumn("side", F.lit(1))
    have = rows.select(F.col(refers).alias("control"), F.col("row").alias("row")).withColumn("side", F.lit(2))
    pairs = want.unionByName(have).groupBy("control", "row").agg(F.bit_or("side").alias("sides")).filter("sides <> 3")
    return pairs.groupBy("control").agg(F.count_if(F.col("sides") == 2).alias("missing"), F.count_if(F.col("sides") == 1).alias("unknown"))


def incomplete_or_repeated(rows: DataFrame, keys: list[str], needed: list[str]) -> DataFrame:
    """``key, problem``: records with a blank needed field, and keys that several records have."""
    at = F.concat_ws("/", *keys)
    blank = [F.struct(F.concat(F.lit("blank "), F.lit(c)).alias("problem"), (F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "").alias("is")) for c in needed]
    missing = rows.select(at.alias("key"), F.inline(F.array(*blank))).filter("is").select("key", "problem")
    twice = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(at.alias("key"), F.lit("repeated").alias("problem"))
    return missing.unionByName(twice)


def substituted(template: str, **fields: Column) -> Column:
    """The template with each ``{name}`` replaced."""
    return reduce(lambda c, kv: F.replace(c, F.lit("{" + kv[0] + "}"), kv[1]), fields.items(), F.lit(template))


def connectives(c: Column, words: tuple[str, ...]) -> Column:
    """The connectives that occur as whole words, any case, each once, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"(?<![a-z])(" + "|".join(words) + r")(?![a-z])"), F.lit(1))))


def call_id(**fields: Column) -> Column:
    """A request's identifier: the SHA-256 of its canonical JSON."""
    return row_hash(fields)


def specific(facts: Column, pattern: str = r"\d") -> Column:
    """Whether some fact is specific."""
    return F.coalesce(F.exists(facts, lambda f: f.rlike(pattern)), F.lit(False))


def interval_side(low: Column, high: Column) -> Column:
    return F.when(low > 0, "above 0").when(high < 0, "below 0").otherwise("includes 0")


def p_text(p: Column) -> Column:
    return F.when(p < 0.001, "<0.001").otherwise(F.format_number(p, 3))


def word_diff(rows: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """``key, diff``: words of ``b`` with ``[-gone-]`` and ``{+new+}`` runs against ``a``; null is empty."""
    kind = rows.schema[key].dataType.simpleString()

    def one(x: str | None, y: str | None) -> str:
        x, y, out = (x or "").split(), (y or "").split(), []
        for op, i, j, k, m in difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
            if op == "equal":
                out += x[i:j]
            else:
                out += [f"[-{' '.join(x[i:j])}-]"] * (j > i) + [f"{{+{' '.join(y[k:m])}+}}"] * (m > k)
        return " ".join(out)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            made = [one(x, y) for x, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], ["key", "diff"])

    return rows.select(F.col(key).alias("key"), F.col(a).alias("a"), F.col(b).alias("b")).mapInArrow(run, f"key {kind}, diff string").withColumnRenamed("key", key)
