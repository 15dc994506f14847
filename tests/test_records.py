"""Hand-computed expectations of the small operators over records."""

from helpers import rows_of
from pyspark.sql import functions as F

from quillwork.operators import records as R


def test_overlays_and_references(spark):
    a, b = spark.createDataFrame([(1, "new"), (3, None)], "k int, v string"), spark.createDataFrame([(1, "old"), (2, "old"), (None, "old")], "k int, v string")
    assert sorted(map(str, map(tuple, R.overlay([a, b], ["k"]).collect()))) == ["(1, 'new')", "(2, 'old')", "(3, None)", "(None, 'old')"]
    assert rows_of(R.shared_keys(a, b, ["k"])) == [(1,)]
    controls = spark.createDataFrame([("c", ["x", "y"]), ("d", ["z"])], "key string, listed array<string>")
    rows = spark.createDataFrame([("x", "c"), ("q", "c"), ("z", "d"), ("z", "d")], "row string, refers string")
    assert rows_of(R.back_references(controls, rows, "key", "listed", "refers")) == [("c", 1, 1)]
    got = R.incomplete_or_repeated(spark.createDataFrame([("a", " "), ("a", "t"), ("b", None)], "k string, t string"), ["k"], ["t"])
    assert rows_of(got) == [("a", "blank t"), ("a", "repeated"), ("b", "blank t")]


def test_counts(spark):
    rows = spark.createDataFrame([("g", 4), ("g", 7), ("g", 5), ("h", 0)], "g string, n int")
    assert rows_of(R.length_diagnostics(rows, "g", "n", 1.5)) == [("g", 4, 7, 1.75, 6, 5, 1), ("h", 0, 0, None, 0, 0, 0)]
    assert rows_of(R.unit_counts(spark.createDataFrame([(1, None), (1, 2)], "a int, b int"), ["a", "b"])) == [("a", "1", 2), ("b", "2", 1)]
    assert rows_of(R.coverage(rows, ["g"], "g")) == [("g", "g", 3), ("g", "h", 1), ("most", "g", 3)]


def test_word_diff(spark):
    rows = spark.createDataFrame([(1, "a b c", "a x c d"), (2, None, "n"), (3, "same text", "same text"), (4, "", "")], "k int, a string, b string")
    assert rows_of(R.word_diff(rows, "k", "a", "b")) == [(1, "a [-b-] {+x+} c {+d+}"), (2, "{+n+}"), (3, "same text"), (4, "")]


def test_displays(spark):
    got = spark.createDataFrame([(0.1, 0.2, 0.0004), (-2.0, -1.0, 0.0456), (-1.0, 0.0, 1.0)], "lo double, hi double, p double")
    assert [tuple(r) for r in got.select(R.interval_side(F.col("lo"), F.col("hi")), R.p_text(F.col("p"))).collect()] == [("above 0", "<0.001"), ("below 0", "0.046"), ("includes 0", "1.000")]
    assert [r[0] for r in spark.createDataFrame([("b",), ("z",)], "v string").select(R.rank_of(F.col("v"), ("a", "b"))).collect()] == [1, 2]
