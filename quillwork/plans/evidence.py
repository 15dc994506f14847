"""Queries of the text, log, constraint, sampling and agreement families, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillwork.functions import hashing as H
from quillwork.functions import text as T
from quillwork.operators import agreement as G
from quillwork.operators import callog as L
from quillwork.operators import checks as C
from quillwork.operators import sampling as P
from quillwork.plans.registry import query
from quillwork.plans.roles import CELLS, decisions, load

N = 8
WORD_SQL = r"[A-Za-z0-9]+(?:[''’-][A-Za-z0-9]+)*"
TOKENS_SQL = f"regexp_extract_all(lower(text), '{WORD_SQL}')"
#: Phrases of the demonstration screen: code, pattern, severity.
SCREEN = (("hedge", "(?i)(^|[^a-z])that(?=[^a-z]|$)", "warning"), ("mark", "[#$%&*]{3}", "error"), ("mail", "[a-z0-9.]+@[a-z0-9.]+", "error"))
LEAKAGE = ("(?i)token *=", "[0-9]{12,}", "<[a-z/]+>")


# -- text ----------------------------------------------------------------------------------------------------------

@query(f"SELECT doc_id, len(regexp_extract_all(text, '{WORD_SQL}'))::INT AS words, len(regexp_extract_all(text, '[.!?]+'))::INT AS stops FROM documents")
def word_counts(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", T.word_count(F.col("text")).alias("words"), F.regexp_count("text", F.lit("[.!?]+")).alias("stops"))


@query("SELECT doc_id, len(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: x = 'the'))::INT AS n FROM documents")
def phrase_counts(spark, sf_dir):
    """A whole phrase with no letter beside it."""
    return load(spark, sf_dir, "documents").select("doc_id", T.phrase_count(F.col("text"), "the").alias("n"))


@query(" UNION ALL ".join(f"SELECT doc_id, '{c}' AS code, '{s}' AS severity FROM documents WHERE regexp_matches(text, '{p.replace('(?=[^a-z]|$)', '([^a-z]|$)')}')" for c, p, s in SCREEN))
def phrase_screen(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    return docs.select("doc_id", F.inline(F.array_compact(F.array(*(F.when(F.col("text").rlike(p), F.struct(F.lit(c).alias("code"), F.lit(s).alias("severity"))) for c, p, s in SCREEN)))))


@query("SELECT doc_id FROM documents WHERE " + " OR ".join(f"regexp_matches(text, '{p}')" for p in LEAKAGE))
def leakage_screen(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    return docs.filter(T.any_of(F.col("text"), list(LEAKAGE))).select("doc_id")


@query(f"""SELECT doc_id, item_id, count(*) AS shared_ngrams FROM (SELECT DISTINCT doc_id, array_to_string(t[i:i+{N - 1}], ' ') AS gram FROM (SELECT doc_id, t, unnest(range(1, len(t) - {N - 2})) AS i FROM (SELECT doc_id, {TOKENS_SQL} AS t FROM documents)))
JOIN (SELECT DISTINCT item_id, array_to_string(t[i:i+{N - 1}], ' ') AS gram FROM (SELECT item_id, t, unnest(range(1, len(t) - {N - 2})) AS i FROM (SELECT item_id, {TOKENS_SQL} AS t FROM benchmark))) USING (gram) GROUP BY ALL""")
def ngram_overlap(spark, sf_dir):
    return T.ngram_overlap(load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "benchmark"), "doc_id", "item_id", N)


@query(f"""WITH g AS (SELECT doc_id, t, i - 1 AS pos, array_to_string(t[i:i+{N - 1}], ' ') AS gram FROM (SELECT doc_id, t, unnest(range(1, len(t) - {N - 2})) AS i FROM (SELECT doc_id, {TOKENS_SQL} AS t FROM documents))),
b AS (SELECT DISTINCT array_to_string(t[i:i+{N - 1}], ' ') AS gram FROM (SELECT t, unnest(range(1, len(t) - {N - 2})) AS i FROM (SELECT {TOKENS_SQL} AS t FROM benchmark)))
SELECT doc_id, min(pos)::INT AS start, (max(pos) - min(pos) + {N})::BIGINT AS run_words, array_to_string(any_value(t)[min(pos) + 1:max(pos) + {N}], ' ') AS run FROM (SELECT *, sum(CASE WHEN gap <= {N} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM (SELECT doc_id, t, pos, pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS gap FROM g WHERE gram IN (SELECT gram FROM b))) GROUP BY doc_id, island""")
def shared_runs(spark, sf_dir):
    return T.shared_runs(load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "benchmark"), "doc_id", "text", N)


@query(f"""WITH t AS (SELECT item_id, list_distinct(list_filter({TOKENS_SQL}, lambda w: len(w) >= 4)) AS s FROM benchmark)
SELECT a.item_id AS key_a, b.item_id AS key_b, round(len(list_intersect(a.s, b.s))::DOUBLE / len(list_distinct(list_concat(a.s, b.s))), 3) AS jaccard FROM t a JOIN t b ON a.item_id < b.item_id WHERE len(a.s) > 0 AND len(b.s) > 0 AND len(list_intersect(a.s, b.s))::DOUBLE / len(list_distinct(list_concat(a.s, b.s))) >= 0.05""")
def near_duplicates(spark, sf_dir):
    items = load(spark, sf_dir, "benchmark").select("item_id", T.content_words(F.col("text")).alias("tokens"))
    return T.near_pairs(items, "item_id", "tokens", 0.05)


def _pairs(spark, sf_dir) -> DataFrame:
    """Each user turn with the assistant turn that follows it."""
    c = load(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    return c.withColumn("reply", F.lead("text").over(w)).withColumn("reply_role", F.lead("role").over(w)).filter("role = 'user' AND reply_role = 'assistant'").select("conv_id", "turn", "text", "reply")


_PAIRS_SQL = "SELECT conv_id, turn, text, reply FROM (SELECT *, lead(text) OVER w AS reply, lead(role) OVER w AS reply_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND reply_role = 'assistant'"


@query(f"""SELECT conv_id, turn, CASE WHEN len(b) = 0 THEN 1.0 ELSE round(len(list_filter(b, lambda w: list_contains(s, w)))::DOUBLE / len(b), 6) END AS coverage FROM (SELECT conv_id, turn, list_filter(regexp_extract_all(lower(reply), '{WORD_SQL}'), lambda w: len(w) >= 4) AS b, list_distinct(list_filter({TOKENS_SQL}, lambda w: len(w) >= 4)) AS s FROM ({_PAIRS_SQL}))""")
def containment_coverage(spark, sf_dir):
    return _pairs(spark, sf_dir).select("conv_id", "turn", F.round(T.containment(F.col("reply"), F.col("text")), 6).alias("coverage"))


@query(f"""WITH p AS ({_PAIRS_SQL}), a AS (SELECT conv_id, turn, word, count(*) AS n FROM (SELECT conv_id, turn, unnest({TOKENS_SQL}) AS word FROM p) GROUP BY ALL), b AS (SELECT conv_id, turn, word, count(*) AS m FROM (SELECT conv_id, turn, unnest(regexp_extract_all(lower(reply), '{WORD_SQL}')) AS word FROM p) GROUP BY ALL)
SELECT conv_id || ':' || turn AS key, word, coalesce(n, 0) - coalesce(m, 0) AS excess FROM a FULL JOIN b USING (conv_id, turn, word) WHERE coalesce(n, 0) <> coalesce(m, 0)""")
def multiset_drift(spark, sf_dir):
    p = _pairs(spark, sf_dir).withColumn("key", F.concat_ws(":", "conv_id", "turn"))
    return T.multiset_drift(p.select("key", T.words(F.lower("text")).alias("tokens")), p.select("key", T.words(F.lower("reply")).alias("tokens")), "key")


@query("SELECT doc_id, first_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))), lang) AS first_id FROM documents) WHERE doc_id <> first_id")
def duplicate_text(spark, sf_dir):
    """Later rows of the same normalised text and language, with the first: a pre-aggregated minimum, joined back."""
    d = load(spark, sf_dir, "documents").select("doc_id", "lang", F.md5(T.normalised(F.col("text")).cast("binary")).alias("mark"))
    first = d.groupBy("mark", "lang").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return d.join(first, ["mark", "lang"]).filter("doc_id <> first_id").select("doc_id", "first_id")


@query("SELECT conv_id, turn, CASE WHEN p IS NULL THEN 'does not start with the user' WHEN p = role THEN 'role repeats' END AS problem FROM (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations WHERE role <> 'system') WHERE p = role OR (p IS NULL AND role <> 'user')")
def role_alternation(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").filter("role <> 'system'")
    before = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    problem = F.when(F.col("p").isNull() & (F.col("role") != "user"), "does not start with the user").when(F.col("p") == F.col("role"), "role repeats")
    return c.withColumn("p", before).withColumn("problem", problem).filter("problem IS NOT NULL").select("conv_id", "turn", "problem")


@query("SELECT conv_id, count(*) AS turns, sha256(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS prompt_hash FROM conversations GROUP BY conv_id")
def prompt_render(spark, sf_dir):
    """Transcripts in turn order, rendered and hashed."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    text = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n")
    return load(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("t")).select("conv_id", F.size("t").cast("long").alias("turns"), F.sha2(text, 256).alias("prompt_hash"))


@query("""SELECT c_custkey, sha256('{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || '"}') AS content_hash FROM customer""")
def content_hash(spark, sf_dir):
    c = load(spark, sf_dir, "customer")
    return c.select("c_custkey", H.row_hash({n: F.col(n) for n in ("c_name", "c_custkey", "c_mktsegment")}).alias("content_hash"))


@query(None)
def sentence_shape(spark, sf_dir):
    """Sentences and unclear ends per item; the split uses look-behind, which the oracle's expressions lack."""
    b = load(spark, sf_dir, "benchmark")
    return b.select("item_id", F.size(T.sentences(F.col("text"))).alias("sentences"), *(c.alias(k) for k, c in T.ambiguity_counts(F.col("text")).items()))


@query("SELECT item_id, regexp_replace(text, '(?i)\\b(the)\\b', '**\\1**', 'g') AS highlighted FROM benchmark WHERE NOT regexp_matches(text, '[^\\x00-\\x7f]')")
def marker_highlight(spark, sf_dir):
    """Items in ASCII, as its SQL has them; ``marker_highlight_whole`` takes all."""
    return load(spark, sf_dir, "benchmark").filter("NOT text RLIKE '[^\\\\x00-\\\\x7f]'").select("item_id", T.highlighted(F.col("text"), "the").alias("highlighted"))


@query("SELECT item_id, len(list_filter(string_split_regex(regexp_replace(lower(text), 'the', ' '), '[^a-z0-9]+'), lambda x: x <> ''))::INT AS residue_words FROM benchmark WHERE NOT regexp_matches(text, '[^\\x00-\\x7f]')")
def residue_words(spark, sf_dir):
    """Words left when a literal is taken out once; items in ASCII, as its SQL has them (``residue_words_whole`` takes all)."""
    b = load(spark, sf_dir, "benchmark").filter("NOT text RLIKE '[^\\\\x00-\\\\x7f]'")
    return b.select("item_id", F.size(T.words(T.strip_once(F.lower("text"), F.lit("the")))).alias("residue_words"))


@query(None)
def marker_highlight_whole(spark, sf_dir):
    """Every item; the oracle's expressions have no look-around, so the tests compare with a loop."""
    return load(spark, sf_dir, "benchmark").select("item_id", T.highlighted(F.col("text"), "the").alias("highlighted"))


@query(f"SELECT item_id, len(regexp_extract_all(regexp_replace(lower(text), 'the', ' '), '{WORD_SQL}'))::INT AS residue_words FROM benchmark")
def residue_words_whole(spark, sf_dir):
    """Words left in every item when a literal is taken out once."""
    return load(spark, sf_dir, "benchmark").select("item_id", F.size(T.words(T.strip_once(F.lower("text"), F.lit("the")))).alias("residue_words"))


# -- call log ------------------------------------------------------------------------------------------------------

def _log(spark, sf_dir) -> DataFrame:
    e = load(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "accepted").otherwise("usable")
    return e.select("user_id", "ts", "event_id", "event_type", "value", status.alias("status"))


_LOG_SQL = "SELECT user_id, ts, event_id, event_type, value, CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'accepted' ELSE 'usable' END AS status FROM events"


@query(f"SELECT user_id, event_id, status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (status = 'accepted') DESC, CASE WHEN status = 'accepted' THEN ts END, CASE WHEN status = 'accepted' THEN event_id END, ts DESC, event_id DESC) AS i FROM ({_LOG_SQL}) WHERE status <> 'error') WHERE i = 1")
def latest_accepted(spark, sf_dir):
    """The first accepted entry of each key, else the latest usable one; transport errors do not count."""
    log = _log(spark, sf_dir).filter("status <> 'error'").withColumn("ok", F.col("status") == "accepted")
    return L.latest_accepted(log, ["user_id"], ["ts", "event_id"], "ok").select("user_id", "event_id", "status")


@query(f"SELECT user_id, event_id, sum(CASE WHEN status <> 'error' THEN 1 ELSE 0 END) OVER w::BIGINT AS attempt, coalesce(lag(event_type) OVER w = event_type, false) AS unchanged FROM ({_LOG_SQL}) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)".replace("OVER w::BIGINT", "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"))
def attempt_history(spark, sf_dir):
    return L.attempts(_log(spark, sf_dir), ["user_id"], ["ts", "event_id"], "event_type", F.col("status") != "error").select("user_id", "event_id", "attempt", "unchanged")


@query(f"SELECT user_id, count(*) AS total, sum((status = 'accepted')::INT)::BIGINT AS accepted, sum((status = 'usable')::INT)::BIGINT AS usable, sum((status = 'error')::INT)::BIGINT AS failed FROM ({_LOG_SQL}) GROUP BY user_id")
def status_funnel(spark, sf_dir):
    s = F.col("status")
    return L.funnel(_log(spark, sf_dir), ["user_id"], {"accepted": s == "accepted", "usable": s == "usable", "failed": s == "error"})


_CURRENT_SQL = f"SELECT user_id, arg_max(event_id, (ts, event_id)) AS call_id, count(*) AS n FROM ({_LOG_SQL}) WHERE status <> 'error' GROUP BY user_id"


def _current(spark, sf_dir) -> DataFrame:
    return _log(spark, sf_dir).filter("status <> 'error'").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("call_id"), F.count(F.lit(1)).alias("n"))


@query(f"SELECT user_id, call_id, coalesce(r.text, 'drafted') AS body, r.k IS NOT NULL AS replaced FROM ({_CURRENT_SQL}) LEFT JOIN (SELECT user_id AS k, event_id AS c, 'redraft ' || event_id AS text FROM events WHERE event_id % 3 = 0) r ON k = user_id AND c = call_id")
def supersession_overlay(spark, sf_dir):
    """A redraft replaces only the call it names."""
    redrafts = load(spark, sf_dir, "events").filter("event_id % 3 = 0").select("user_id", F.col("event_id").alias("supersedes"), F.concat(F.lit("redraft "), F.col("event_id")).alias("body"))
    return L.superseded(_current(spark, sf_dir).select("user_id", "call_id", F.lit("drafted").alias("body")), redrafts, "user_id", "call_id", "body")


@query(f"""SELECT user_id, CASE WHEN call_id % 11 = 0 THEN 'machine_error' WHEN user_id % 7 = 0 THEN 'missing' WHEN user_id % 7 = 1 THEN 'pending' WHEN user_id % 7 = 2 THEN 'not_approved' WHEN user_id % 5 = 0 THEN 'anonymous' WHEN call_id % 4 = 0 THEN 'stale' WHEN n % 2 = 0 THEN 'incomplete' ELSE 'approved' END AS state FROM ({_CURRENT_SQL})""")
def approval_state(spark, sf_dir):
    u, c = F.col("user_id"), F.col("call_id")
    rows = _current(spark, sf_dir).select(
        "user_id", F.when(c % 11 == 0, 1).otherwise(0).alias("machine_errors"), F.when(u % 7 == 1, "pending").when(u % 7 == 2, "redraft").when(u % 7 != 0, "approved").alias("decision"), F.when(u % 5 != 0, "editor").alias("reviewer"),
        F.md5(c.cast("string").cast("binary")).alias("current_hash"), F.md5(F.when(c % 4 == 0, c + 1).otherwise(c).cast("string").cast("binary")).alias("approved_hash"), (F.col("n") % 2 == 1).alias("complete"),
    )
    return rows.select("user_id", L.approval_state(rows).alias("state"))


@query("SELECT user_id, count(DISTINCT event_type) = 1 AND count(*) > 1 AS identical_throughout FROM events GROUP BY user_id")
def identical_throughout(spark, sf_dir):
    return L.identical_throughout(load(spark, sf_dir, "events"), ["user_id"], "event_type")


@query("""SELECT user_id, b.event_id, b.e AS fewest, l.e AS last_errors FROM (SELECT user_id, arg_min({'event_id': event_id, 'e': floor(value)::BIGINT % 10}, (floor(value)::BIGINT % 10, ts, event_id)) AS b, arg_max({'e': floor(value)::BIGINT % 10}, (ts, event_id)) AS l FROM events GROUP BY user_id) WHERE b.e < l.e""")
def fewest_errors_before_last(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("user_id", "ts", "event_id", (F.floor("value").cast("long") % 10).alias("errors"))
    return L.fewest_errors_before_last(e, ["user_id"], ["ts", "event_id"], "errors").select("user_id", "event_id", "fewest", "last_errors")


# -- constraints ---------------------------------------------------------------------------------------------------

@query("SELECT o_custkey AS custkey, 'extra' AS side FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0) UNION ALL SELECT c_custkey, 'missing' FROM customer WHERE c_custkey % 10 <> 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders)")
def set_difference(spark, sf_dir):
    plan = load(spark, sf_dir, "customer").filter("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("custkey"))
    return C.missing_and_extra(plan, load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey")), ["custkey"])


@query("SELECT o_custkey, o_orderdate::DATE AS day, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return C.duplicates(load(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day")), ["o_custkey", "day"])


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def referential_integrity(spark, sf_dir):
    return C.orphans(load(spark, sf_dir, "documents").select("doc_id"), "doc_id", load(spark, sf_dir, "labels"), "doc_id")


@query("SELECT c_mktsegment, d.dimension, d.level, count(*) AS n FROM (SELECT c_mktsegment, unnest([{'dimension': 'domain', 'level': r_name}, {'dimension': 'half', 'level': (c_custkey % 2)::VARCHAR}, {'dimension': 'nation', 'level': n_name}]) AS d FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) GROUP BY ALL")
def balance_table(spark, sf_dir):
    nation = load(spark, sf_dir, "nation").join(F.broadcast(load(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    c = load(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return C.balance(c.select("c_mktsegment", F.col("r_name").alias("domain"), (F.col("c_custkey") % 2).alias("half"), F.col("n_name").alias("nation")), ["c_mktsegment"], ["domain", "half", "nation"])


@query("SELECT o_custkey, max(n) AS largest, sum(n)::BIGINT AS total, round(max(n)::DOUBLE / sum(n)::DOUBLE, 6) AS share FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) GROUP BY o_custkey")
def concentration_caps(spark, sf_dir):
    return C.concentration(load(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority")


@query("SELECT p_brand, count(DISTINCT p_type) AS units FROM part GROUP BY p_brand HAVING count(DISTINCT p_type) < 150")
def minimum_support(spark, sf_dir):
    return C.support(load(spark, sf_dir, "part"), "p_brand", "p_type", 150)


@query("SELECT size, count(*) AS groups FROM (SELECT count(*) AS size FROM lineitem GROUP BY l_orderkey) GROUP BY size")
def group_spectrum(spark, sf_dir):
    return C.spectrum(load(spark, sf_dir, "lineitem"), "l_orderkey")


@query("WITH s AS (SELECT DISTINCT o_custkey, o_orderpriority AS p FROM orders) SELECT a.p AS item_a, b.p AS item_b, count(*) AS keys FROM s a JOIN s b ON a.o_custkey = b.o_custkey AND a.p < b.p GROUP BY ALL")
def cooccurrence_pairs(spark, sf_dir):
    return C.cooccurrence(load(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority")


@query("""SELECT severity, code, count(*) AS n FROM (SELECT 'error' AS severity, 'short_text' AS code FROM documents WHERE length(text) < 100 UNION ALL SELECT 'warning', 'long_text' FROM documents WHERE length(text) > 10000 UNION ALL SELECT 'error', 'unknown_language' FROM documents WHERE lang NOT IN ('en', 'de', 'fr') UNION ALL SELECT 'error', 'unlabelled' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) GROUP BY ALL""")
def findings_summary(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", "lang", F.length("text").alias("n"))
    key = F.col("doc_id")
    return C.summary(C.union(
        C.findings(d.filter("n < 100"), "short_text", "document", key, F.col("n")), C.findings(d.filter("n > 10000"), "long_text", "document", key, F.col("n"), "warning"),
        C.findings(d.filter(~F.col("lang").isin("en", "de", "fr")), "unknown_language", "document", key, F.col("lang")), C.findings(C.orphans(d, "doc_id", load(spark, sf_dir, "labels"), "doc_id"), "unlabelled", "document", key),
    ))


@query("SELECT c_mktsegment, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (c_mktsegment, n_name)")
def rollup_counts(spark, sf_dir):
    c = load(spark, sf_dir, "customer").join(F.broadcast(load(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.rollup("c_mktsegment", "n_name").agg(F.count(F.lit(1)).alias("n"))


# -- sampling ------------------------------------------------------------------------------------------------------

_QUOTA_SQL = """SELECT lang, n, floor_quota, remainder, floor_quota + (row_number() OVER (ORDER BY remainder DESC, lang) <= round_even(sum(n) OVER () * 3 / 20.0::DOUBLE, 0)::BIGINT - sum(floor_quota) OVER ())::INT::BIGINT AS quota
FROM (SELECT lang, count(*) AS n, count(*) * 3 // 20 AS floor_quota, count(*) * 3 % 20 AS remainder FROM documents GROUP BY lang)"""


def _quotas(spark, sf_dir) -> DataFrame:
    counts = load(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return P.largest_remainder(counts, "lang", "n", 3, 20)


@query(_QUOTA_SQL)
def largest_remainder_quota(spark, sf_dir):
    return _quotas(spark, sf_dir)


@query(f"SELECT lang, doc_id, place FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('17:pick:' || doc_id), doc_id)::INT AS place FROM documents) JOIN ({_QUOTA_SQL}) USING (lang) WHERE place <= quota")
def stratified_pick(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("lang", "doc_id")
    return P.stratified_pick(docs, _quotas(spark, sf_dir), "lang", "doc_id", 17, "pick").select("lang", "doc_id", "place")


@query("SELECT o_custkey, min(gap) AS min_gap FROM (SELECT o_custkey, o_orderkey - lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS gap FROM orders) WHERE gap IS NOT NULL GROUP BY o_custkey")
def min_sibling_gap(spark, sf_dir):
    return P.min_gap(load(spark, sf_dir, "orders"), "o_custkey", "o_orderkey")


@query("SELECT item_id, 'i' || lpad(row_number() OVER (ORDER BY md5('5:i:' || item_id), item_id)::VARCHAR, 5, '0') AS blind_id, ('0x' || substr(md5('5:i:' || item_id), 32, 1))::BIGINT % 2 = 1 AS flipped FROM benchmark")
def blind_ids(spark, sf_dir):
    return P.blind_ids(load(spark, sf_dir, "benchmark").select("item_id"), "item_id", "i", 5)


@query("SELECT s_nationkey, s_suppkey, CASE WHEN row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) % 2 = 1 THEN 'first' ELSE 'second' END AS assigned FROM supplier")
def alternating_assignment(spark, sf_dir):
    return P.alternating(load(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey"), ["s_nationkey"], [F.col("s_suppkey")], ("first", "second"))


@query("SELECT c_custkey AS decision_id, r_name AS domain, order_id, opening_id, condition, marker_family FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey, (VALUES ('o1'), ('o2')) o(order_id), (VALUES ('p1'), ('p2'), ('p3')) p(opening_id), (VALUES ('RS','conclusion'), ('RS','logic'), ('NS','conclusion'), ('NS','logic'), ('RP','none'), ('NP','none')) c(condition, marker_family)")
def design_grid(spark, sf_dir):
    """The plan: every decision under every order, opening and cell."""
    d = decisions(spark, sf_dir).withColumn("order_id", F.explode(F.array(F.lit("o1"), F.lit("o2")))).withColumn("opening_id", F.explode(F.array(*map(F.lit, ("p1", "p2", "p3")))))
    return d.select("*", F.inline(F.array(*(F.struct(F.lit(a).alias("condition"), F.lit(b).alias("marker_family")) for a, b, _ in CELLS))))


# -- agreement -----------------------------------------------------------------------------------------------------

@query("SELECT quality AS code_a, toxic AS code_b, count(*) AS n FROM labels GROUP BY ALL")
def kappa_contingency(spark, sf_dir):
    return G.contingency(load(spark, sf_dir, "labels"), "quality", "toxic")


@query("""SELECT n, round(po, 6) AS observed, round(pa*pb + (1-pa)*(1-pb), 6) AS expected, round((po - (pa*pb + (1-pa)*(1-pb))) / nullif(1 - (pa*pb + (1-pa)*(1-pb)), 0), 6) AS kappa, round(pa, 6) AS prevalence_a, round(pb, 6) AS prevalence_b
FROM (SELECT count(*) AS n, avg((quality = toxic)::INT::DOUBLE) AS po, avg(quality::DOUBLE) AS pa, avg(toxic::DOUBLE) AS pb FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL)""")
def kappa(spark, sf_dir):
    return G.kappa(load(spark, sf_dir, "labels"), "quality", "toxic")


@query("""SELECT n::BIGINT AS pairable, round(d/n, 6) AS observed, round(2*(n*q - s*s)/(n*(n-1)), 6) AS expected, round(1 - (d/n)/nullif(2*(n*q - s*s)/(n*(n-1)), 0), 6) AS alpha FROM (SELECT sum(m)::DOUBLE AS n, sum(s) AS s, sum(q) AS q, sum(2*(m*q - s*s)/(m-1)) AS d
FROM (SELECT l_orderkey, count(*) AS m, sum(l_linenumber::DOUBLE) AS s, sum(l_linenumber::DOUBLE*l_linenumber) AS q FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1))""")
def krippendorff_alpha(spark, sf_dir):
    return G.alpha(load(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")
