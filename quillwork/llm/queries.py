"""The queries of this subpackage: ``op<N>_<name>(spark, sf_dir)`` and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.llm import ann, bpe, common, decontaminate, near_dup, secret_scan, suffix_dedup, token_store, toxicity, url_filter, warc

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(common.table(spark, sf_dir, "documents"), secret_scan.train())


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.search(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(common.table(spark, sf_dir, "documents"), tokenizer_path())


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    folder = common.scratch(spark, "tokens")
    return token_store.read(token_store.write(docs, tokenizer_path(), folder), folder)


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(common.table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_copies")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


#: Rules of op8: verdict, host, beginning of the path.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Listed canonical addresses of op8 that no rule covers.
LISTED = [("spam-farm.example.org", "/")]


def op8_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = common.prepare(spark).createDataFrame(LISTED, "host string, path string")
    return url_filter.judge(common.table(spark, sf_dir, "pages"), RULES, listed).select("page_id", "host", "path", "rule", "verdict")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.scratch(spark, "warc")
    return warc.read(warc.write(common.table(spark, sf_dir, "pages"), folder), folder)


def op10_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(common.table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_decontaminate, op3_bpe_round_trip, op4_token_files, op5_near_dup, op6_toxicity, op7_nearest, op8_url_verdicts, op9_warc, op10_repeated_bytes)}
_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"
_PREFIXES = ", ".join(f"('{h}', '{p}', '{v}', {by})" for rows, by in ((RULES, "true"), ([("block", h, p) for h, p in LISTED], "false")) for v, h, p in rows)
_FITS = "(p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.p)"
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_BITS = " || ".join(f"substr('{_LETTERS}', ((('0x' || substr(mark, i * 5 + 1, 5))::BIGINT >> {k}) & 31)::INT + 1, 1)" for k in (15, 10, 5, 0))

#: SQL of the queries that SQL can express; the others are tested against brute force.
SQL = {
    "op2_decontaminate": f"""
WITH i AS (SELECT item_id, w, least(5, len(w)) AS k FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
ig AS (SELECT DISTINCT item_id, k, array_to_string(w[j:j + k - 1], ' ') AS g FROM (SELECT item_id, k, w, unnest(range(1, len(w) - k + 2)) AS j FROM i)),
dg AS (SELECT DISTINCT doc_id, k, array_to_string(w[j:j + k - 1], ' ') AS g FROM (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS j FROM (SELECT doc_id, {_WORDS} AS w FROM documents), (SELECT DISTINCT k FROM i))),
s AS (SELECT item_id, count(*) AS n FROM ig GROUP BY item_id)
SELECT doc_id, item_id, n AS n_shingles, count(*) AS n_shared, count(*)::DOUBLE / n AS containment FROM dg JOIN ig USING (k, g) JOIN s USING (item_id) GROUP BY doc_id, item_id, n HAVING 5 * count(*) >= 4 * n""",
    "op8_url_verdicts": f"""
WITH r(h, p, verdict, by_rule) AS (VALUES {_PREFIXES}),
u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{url_filter.UPPER}', '{url_filter.LOWER}'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u)
SELECT page_id, host, path, (SELECT r.h || r.p FROM r WHERE by_rule AND {_FITS} ORDER BY length(r.h || r.p) DESC LIMIT 1) AS rule,
coalesce((SELECT r.verdict FROM r WHERE by_rule AND {_FITS} ORDER BY length(r.h || r.p) DESC LIMIT 1), CASE WHEN EXISTS (SELECT 1 FROM r WHERE NOT by_rule AND {_FITS}) THEN 'block' ELSE 'allow' END) AS verdict FROM p""",
    "op9_warc": f"""
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, array_to_string(list_transform(range(8), lambda i: {_BITS}), '') AS payload_digest,
CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM (SELECT page_id, payload, sha1(payload) AS mark, min(page_id) OVER (PARTITION BY payload) AS first FROM (SELECT page_id, coalesce(html, '') AS payload FROM pages))""",
}
