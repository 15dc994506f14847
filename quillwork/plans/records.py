"""Queries of the small operators over records, on the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillwork.functions import text as T
from quillwork.operators import records as R
from quillwork.plans.registry import query
from quillwork.plans.roles import load

PRIORITIES = ("2-HIGH", "1-URGENT", "5-LOW")
CONNECTIVES = ("the", "and", "for", "et", "in")
WORD_SQL = r"[A-Za-z0-9]+(?:[''’-][A-Za-z0-9]+)*"
_RANK_SQL = "CASE o_orderpriority WHEN '2-HIGH' THEN 0 WHEN '1-URGENT' THEN 1 WHEN '5-LOW' THEN 2 ELSE 3 END"


@query("SELECT c_custkey, arg_min(c_mktsegment, layer) AS c_mktsegment FROM (SELECT c_custkey, 'CORRECTED' AS c_mktsegment, 0 AS layer FROM customer WHERE c_nationkey = 3 UNION ALL SELECT c_custkey, c_mktsegment, 1 FROM customer) GROUP BY c_custkey")
def overlay_union(spark, sf_dir):
    """Records with corrections laid over them."""
    c = load(spark, sf_dir, "customer")
    mended = c.filter("c_nationkey = 3").select("c_custkey", F.lit("CORRECTED").alias("c_mktsegment"))
    return R.overlay([mended, c.select("c_custkey", "c_mktsegment")], ["c_custkey"])


@query("SELECT doc_id FROM labels INTERSECT SELECT doc_id FROM documents WHERE lang = 'en'")
def disjoint_keys(spark, sf_dir):
    """Documents on both sides of what should be apart."""
    return R.shared_keys(load(spark, sf_dir, "labels"), load(spark, sf_dir, "documents").filter("lang = 'en'"), ["doc_id"])


@query(f"SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY {_RANK_SQL}, o_orderkey)::INT AS place FROM orders")
def ranked_order(spark, sf_dir):
    """Each customer's orders in a fixed order of priorities."""
    order = Window.partitionBy("o_custkey").orderBy(R.rank_of(F.col("o_orderpriority"), PRIORITIES), "o_orderkey")
    return load(spark, sf_dir, "orders").select("o_orderkey", F.row_number().over(order).alias("place"))


@query("SELECT p_brand, min(p_size) AS first_p_size, arg_min(p_partkey, (p_size, p_partkey)) AS first_p_partkey FROM part GROUP BY p_brand")
def first_carrier(spark, sf_dir):
    return R.first_with(load(spark, sf_dir, "part"), "p_brand", ["p_size", "p_partkey"])


@query("SELECT level, rating::VARCHAR AS rating, count(*) AS units FROM (SELECT 'quality' AS level, quality AS rating FROM labels UNION ALL SELECT 'toxic', toxic FROM labels) WHERE rating IS NOT NULL GROUP BY ALL")
def rating_unit_counts(spark, sf_dir):
    return R.unit_counts(load(spark, sf_dir, "labels"), ["quality", "toxic"])


@query("""SELECT 'c_mktsegment' AS facet, c_mktsegment AS level, count(*) AS n FROM customer GROUP BY c_mktsegment UNION ALL SELECT 'c_nationkey', c_nationkey::VARCHAR, count(*) FROM customer GROUP BY c_nationkey
UNION ALL SELECT 'most', 'c_nationkey', max(n) FROM (SELECT count(*) AS n FROM customer GROUP BY c_nationkey)""")
def sample_coverage(spark, sf_dir):
    return R.coverage(load(spark, sf_dir, "customer"), ["c_mktsegment", "c_nationkey"], "c_nationkey")


@query("""SELECT l_returnflag, string_agg(d::VARCHAR, ',' ORDER BY d) AS differences FROM (SELECT DISTINCT a.l_returnflag, (a.l_quantity - b.l_quantity)::BIGINT AS d FROM (SELECT * FROM lineitem WHERE l_linenumber > 1) a
JOIN (SELECT l_orderkey, max(l_quantity) AS l_quantity FROM lineitem WHERE l_linenumber = 1 GROUP BY l_orderkey) b USING (l_orderkey)) GROUP BY l_returnflag""")
def added_per_marker(spark, sf_dir):
    """Distinct differences of every later line to the first line of its order."""
    li = load(spark, sf_dir, "lineitem")
    control = li.filter("l_linenumber = 1").groupBy("l_orderkey").agg(F.max("l_quantity").alias("l_quantity"))
    return R.differences_to_control(li.filter("l_linenumber > 1"), control, ["l_orderkey"], "l_returnflag", "l_quantity")


@query("SELECT doc_id, count(*) AS records FROM (SELECT doc_id FROM labels WHERE quality IS NOT NULL UNION ALL SELECT doc_id FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id FROM documents WHERE source IS NOT NULL) GROUP BY doc_id")
def recorded_judgements(spark, sf_dir):
    marked = load(spark, sf_dir, "labels")
    return R.recorded([marked.filter("quality IS NOT NULL").select("doc_id"), marked.filter("toxic = 1").select("doc_id"), load(spark, sf_dir, "documents").filter("source IS NOT NULL").select("doc_id")], "doc_id")


@query(f"""WITH w AS (SELECT conv_id, len(regexp_extract_all(text, '{WORD_SQL}'))::INT AS words FROM conversations), p AS (SELECT conv_id, min(words) AS shortest, max(words) AS longest FROM w GROUP BY conv_id)
SELECT conv_id, shortest, longest, round(longest::DOUBLE / nullif(shortest, 0), 4) AS ratio, floor(shortest * 1.5::DOUBLE)::BIGINT AS most, ceil(longest / 1.5::DOUBLE)::BIGINT AS least, (SELECT count(*) FROM w WHERE w.conv_id = p.conv_id AND w.words > floor(p.shortest * 1.5::DOUBLE)) AS offenders FROM p""")
def length_diagnostics(spark, sf_dir):
    rows = load(spark, sf_dir, "conversations").select("conv_id", F.coalesce(T.word_count(F.col("text")), F.lit(0)).alias("words"))
    return R.length_diagnostics(rows, "conv_id", "words", 1.5)


@query("""SELECT coalesce(w.control, h.control) AS control, count(*) FILTER (WHERE w.control IS NULL) AS missing, count(*) FILTER (WHERE h.control IS NULL) AS unknown
FROM (SELECT DISTINCT n_nationkey AS control, unnest([n_nationkey * 2, n_nationkey * 2 + 1])::BIGINT AS row FROM nation) w FULL JOIN (SELECT DISTINCT s_nationkey AS control, s_suppkey AS row FROM supplier) h ON w.control = h.control AND w.row = h.row
WHERE w.control IS NULL OR h.control IS NULL GROUP BY ALL""")
def back_references(spark, sf_dir):
    """Nations that list two suppliers each, against the suppliers that refer to them."""
    listed = load(spark, sf_dir, "nation").withColumn("listed", F.array((F.col("n_nationkey") * 2).cast("long"), (F.col("n_nationkey") * 2 + 1).cast("long")))
    return R.back_references(listed, load(spark, sf_dir, "supplier").withColumn("row", F.col("s_suppkey")), "n_nationkey", "listed", "s_nationkey")


@query("""SELECT conv_id || '/' || role AS key, 'blank text' AS problem FROM conversations WHERE trim(coalesce(text, '')) = '' UNION ALL SELECT conv_id || '/' || role, 'repeated' FROM conversations GROUP BY conv_id, role HAVING count(*) > 1""")
def record_completeness(spark, sf_dir):
    return R.incomplete_or_repeated(load(spark, sf_dir, "conversations"), ["conv_id", "role"], ["text"])


@query("SELECT p_partkey, 'We should take ' || p_name || ' (' || p_brand || ').' AS endorsement FROM part")
def template_text(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", R.substituted("We should take {name} ({brand}).", name=F.col("p_name"), brand=F.col("p_brand")).alias("endorsement"))


@query("SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w: list_contains(['the', 'and', 'for', 'et', 'in'], w)))), ',') AS found FROM benchmark")
def connective_search(spark, sf_dir):
    return load(spark, sf_dir, "benchmark").select("item_id", F.array_join(R.connectives(F.col("text"), CONNECTIVES), ",").alias("found"))


@query("""SELECT conv_id, turn, sha256('{"call":' || conv_id || ',"kind":"' || role || '","turn":' || turn || '}') AS call_id FROM conversations""")
def call_ids(spark, sf_dir):
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", R.call_id(call=F.col("conv_id"), kind=F.col("role"), turn=F.col("turn")).alias("call_id"))


@query("SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '[0-9]'))) > 0 AS specific FROM documents")
def specificity(spark, sf_dir):
    """Whether some line of a document has a figure."""
    return load(spark, sf_dir, "documents").select("doc_id", R.specific(F.split("text", "\n"), "[0-9]").alias("specific"))


@query("SELECT doc_id, array_to_string(regexp_extract_all(text, '(?i)[a-z]+ ([0-9]+)', 1), ',') AS articles FROM documents")
def article_numbers(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.array_join(F.regexp_extract_all("text", F.lit("(?i)[a-z]+ ([0-9]+)"), F.lit(1)), ",").alias("articles"))


@query("SELECT l_returnflag, CASE WHEN lo > 0 THEN 'above 0' WHEN hi < 0 THEN 'below 0' ELSE 'includes 0' END AS side, CASE WHEN p < 0.001 THEN '<0.001' ELSE printf('%.3f', p) END AS p FROM (SELECT l_returnflag, min(l_quantity) - 1 AS lo, max(l_quantity) AS hi, min(l_discount) AS p FROM lineitem GROUP BY l_returnflag)")
def interval_display(spark, sf_dir):
    per = load(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg((F.min("l_quantity") - 1).alias("lo"), F.max("l_quantity").alias("hi"), F.min("l_discount").alias("p"))
    return per.select("l_returnflag", R.interval_side(F.col("lo"), F.col("hi")).alias("side"), R.p_text(F.col("p")).alias("p"))


@query(None)
def word_diffs(spark, sf_dir):
    """Each turn against the one before it; the matcher has no SQL form, so a test holds it against its definition."""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = load(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("key"), before.alias("before"), "text")
    return R.word_diff(rows, "key", "before", "text")
