"""Scans: JSON lines (strict, diagnosed, optional), delimited value sets, token files, whole texts, configuration trees."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Schemas of the evidence files.
INITIAL_SCORES = "run_id string, model_variant string, initial_id string, decision_id string, domain string, scenario_id string, order_id string, initial_label string, initial_option string, excluded boolean, exclusion_reason string, logit_a double, logit_b double, input_tokens int, materialized_prompt_sha256 string"
BEHAVIORAL_SCORES = (
    "run_id string, model_variant string, branch_id string, initial_id string, stimulus_id string, decision_id string, domain string, scenario_id string, variant_id int, supported_option string, condition string, reason string, style string,"
    " marker_id string, marker_family string, marker_string string, opening_id string, order_id string, required_initial_option string, counter_target_label string, paired_control_stimulus_id string, initial_label string, initial_logit_a double,"
    " initial_logit_b double, after_logit_a double, after_logit_b double, m_before double, m_after double, movement_toward_counter double, final_label string, flip boolean, initial_near_tie boolean, post_exact_tie boolean, input_tokens int, materialized_prompt_sha256 string"
)
CALL_LOG = "call_id string, kind string, attempt int, decision_id string, variant_id int, supported_option string, model string, response_sha256 string, status string, error string, generated_at string, outcome string, extra string"


def jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """One row per non-blank line; ``strict`` fails on a malformed one.  NaN becomes null."""
    df = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)
    return df.select(*(F.nanvl(f.name, F.lit(None).cast("double")).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema.fields))


def jsonl_problems(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Malformed lines: ``file, line, text`` (lines count from 1 in each file)."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("at", "text")).filter("trim(text) <> ''")
    parsed = F.from_json("text", T._parse_datatype_string(schema + ", _bad string"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return lines.withColumn("p", parsed).filter("p._bad IS NOT NULL").select("file", (F.col("at") + 1).alias("line"), "text")


def optional_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An absent file is an empty table."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return jsonl(spark, path, schema)


def run_directories(spark: SparkSession, runs: dict[str, str], name: str, schema: str) -> DataFrame:
    """The same file of several run directories, with ``run``."""
    out = None
    for run, folder in sorted(runs.items()):
        df = jsonl(spark, f"{folder}/{name}", schema).withColumn("run", F.lit(run))
        out = df if out is None else out.unionByName(df)
    if out is None:
        raise ValueError("no runs")
    return out


def value_sets(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """``column, value``: distinct normalised cells of a delimited file (a byte order mark is dropped)."""
    df = spark.read.option("sep", sep).option("header", True).csv(path)
    cells = F.explode(F.array(*(F.struct(F.lit(c.lstrip("﻿").strip()).alias("column"), F.col(f"`{c}`").alias("value")) for c in df.columns)))
    norm = F.lower(F.trim(F.regexp_replace("c.value", r"\s+", " ")))
    return df.select(cells.alias("c")).select("c.column", norm.alias("value")).filter("value <> ''").distinct()


def tokens_to_text(tokens: DataFrame, key: str, position: str, start: str, stop: str, token: str) -> DataFrame:
    """Tokens joined in order, with a space wherever one does not begin where the last one stopped."""
    w = Window.partitionBy(key).orderBy(position)
    piece = F.concat(F.when(F.lag(stop).over(w) < F.col(start), " ").otherwise(""), F.col(token))
    rows = tokens.select(key, position, piece.alias("piece"))
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(position, "piece"))), lambda x: x["piece"]), "").alias("text"))


def source_texts(spark: SparkSession, folders: dict[str, str]) -> DataFrame:
    """Whole text files of several folders as ``source_id`` (prefix and file name) and ``text``."""
    out = spark.createDataFrame([], "source_id string, text string")
    for prefix, folder in sorted(folders.items()):
        df = spark.read.text(folder, wholetext=True).select(F.concat(F.lit(prefix + ":"), F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1)).alias("source_id"), F.col("value").alias("text"))
        out = out.unionByName(df)
    return out


def config(path: str) -> Any:
    """A JSON tree, or YAML where that library is present (driver side)."""
    raw = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        return json.loads(raw)
    import yaml

    return yaml.safe_load(raw)


def responses(df: DataFrame, column: str, wanted: list[str]) -> DataFrame:
    """``column`` (a JSON object) as a map, trimmed, with ``problem`` where keys are missing, extra, blank or no strings."""
    parsed = F.from_json(column, "map<string,string>")
    raw = F.from_json(column, "map<string,variant>")
    need = F.array(*map(F.lit, sorted(wanted)))
    keys = F.map_keys(parsed)
    strings = F.forall(F.map_values(raw), lambda v: F.schema_of_variant(v) == "STRING")
    problem = (
        F.when(parsed.isNull(), "not an object")
        .when(F.size(F.array_except(need, keys)) > 0, "missing keys")
        .when(F.size(F.array_except(keys, need)) > 0, "extra keys")
        .when(~F.coalesce(strings, F.lit(False)), "not a string")
        .when(F.exists(F.map_values(parsed), lambda v: F.coalesce(F.trim(v), F.lit("")) == ""), "blank value")
    )
    return df.withColumn("problem", problem).withColumn("response", F.when(F.col("problem").isNull(), F.transform_values(parsed, lambda k, v: F.trim(v))))
