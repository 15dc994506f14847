"""Text expressions: normal forms, words, phrases, screens, shingles, overlap, residues."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A word: letters and digits with inner apostrophes or hyphens (fixed value).
WORD = r"[A-Za-z0-9]+(?:['’-][A-Za-z0-9]+)*"
LIST_MARK = r"(?m)^\s*(?:[-*•]|\d+[.)])\s+"


def normalised(c: Column) -> Column:
    """Lower case, white space collapsed and trimmed."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def unhyphenated(c: Column) -> Column:
    return normalised(F.replace(c, F.lit("-"), F.lit(" ")))


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({WORD})"), F.lit(1))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(WORD))


def phrase_count(c: Column, phrase: str) -> Column:
    """Occurrences of the whole phrase, any case, with no letter beside it."""
    return F.regexp_count(c, F.lit(f"(?i)(?<![A-Za-z]){re.escape(phrase)}(?![A-Za-z])"))


def has_marker(c: Column, marker: str) -> Column:
    return c.rlike(rf"(?i)\b{re.escape(marker)}\b")


def any_of(c: Column, patterns: list[str]) -> Column:
    return F.coalesce(c.rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(False))


def embedded_option(c: Column) -> Column:
    """An option text inside a sentence: no final stop, first letter lower case unless the word is an acronym."""
    bare = F.regexp_replace(F.trim(c), r"\.+$", "")
    acronym = bare.rlike(r"^[A-Z]{2}")
    return F.when(acronym, bare).otherwise(F.concat(F.lower(F.substring(bare, 1, 1)), F.substr(bare, F.lit(2))))


def strip_once(haystack: Column, needle: Column) -> Column:
    """Both in normal form, and the first ``needle`` taken out; no needle leaves the normal form."""

    def cut(h: Column, n: Column) -> Column:
        at = F.instr(h, n)
        return F.when((F.length(n) > 0) & (at > 0), F.trim(F.concat(F.substr(h, F.lit(1), at - 1), F.lit(" "), F.substr(h, at + F.length(n))))).otherwise(h)

    return cut(normalised(haystack), normalised(needle))


def contains_phrase(c: Column, phrase: Column) -> Column:
    """Whether the whole phrase is there, any case, with no letter A to Z beside it; both are columns."""
    pattern = F.concat(F.lit("(?iu)(?<![A-Za-z])\\Q"), phrase, F.lit("\\E(?![A-Za-z])"))
    return F.regexp_like(c, pattern)


def occurrences(haystack: Column, needle: Column) -> Column:
    return ((F.length(haystack) - F.length(F.replace(haystack, needle, F.lit("")))) / F.length(needle)).cast("int")


def residue(body: Column, endorsement: Column, marker: Column) -> Column:
    """The words left when the endorsement and the marker are each taken out once."""
    return words(strip_once(strip_once(body, endorsement), marker))


def content_words(c: Column, least: int = 4, stop: tuple[str, ...] = ()) -> Column:
    out = F.filter(words(F.lower(c)), lambda w: F.length(w) >= least)
    return F.array_except(out, F.array(*map(F.lit, stop))) if stop else F.array_distinct(out)


def containment(body: Column, scenario: Column, least: int = 4, ignore: tuple[str, ...] = ()) -> Column:
    """Share of the body's content words, as often as they occur, that the scenario has; 1 if it has none."""
    skip = F.array(*map(F.lit, ignore)) if ignore else F.array().cast("array<string>")
    own = F.filter(words(F.lower(body)), lambda w: (F.length(w) >= least) & ~F.array_contains(skip, w))

    def share(b: Column) -> Column:
        known = F.array_intersect(b, words(F.lower(scenario)))
        return F.when(F.size(b) == 0, 1.0).otherwise(F.size(F.filter(b, lambda w: F.array_contains(known, w))) / F.size(b))

    return _bound(own, share)


def less_words(tokens: Column, taken: Column) -> Column:
    """``tokens`` without one occurrence of each of ``taken``, in any order."""

    def without(left: Column, w: Column) -> Column:
        at = F.array_position(left, w).cast("int")
        return F.when(at > 0, F.concat(F.slice(left, F.lit(1), at - 1), F.slice(left, at + 1, F.greatest(F.size(left), F.lit(1))))).otherwise(left)

    return F.aggregate(F.coalesce(taken, F.array().cast("array<string>")), tokens, without)


def jaccard(a: Column, b: Column, digits: int = 3) -> Column:
    return F.when(F.size(F.array_union(a, b)) == 0, 0.0).otherwise(F.round(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)), digits))


def _bound(value: Column, f) -> Column:
    """``f`` of a value that is computed once a row, however often ``f`` uses it."""
    return F.transform(F.array(value), f)[0]


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of n tokens joined by a space; none if there are fewer."""

    def runs(t: Column) -> Column:
        return F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(0), F.size(t) - n), lambda i: F.array_join(F.slice(t, i + 1, n), " "))).otherwise(F.array().cast("array<string>"))

    return _bound(tokens, runs)


def shared_runs(texts: DataFrame, protected: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """Maximal runs of words of each text that shared n-grams cover: ``key, start, run_words, run`` (the words).

    Gaps and islands over the positions of shared n-grams: those no more than n apart cover one run.  An n-gram adds as
    many words to its run as it is ahead of the one before."""
    grams = texts.select(key, F.posexplode(ngrams(words(F.lower(text)), n)).alias("pos", "gram"))
    index = protected.select(F.explode(F.array_distinct(ngrams(words(F.lower("text")), n))).alias("gram")).distinct()
    order = Window.partitionBy(key).orderBy("pos")
    hits = grams.join(index, "gram", "left_semi").withColumn("gap", F.col("pos") - F.lag("pos").over(order))
    hits = hits.withColumn("adds", F.when(F.coalesce(F.col("gap") > n, F.lit(True)), n).otherwise(F.col("gap")))
    hits = hits.withColumn("island", F.sum(F.coalesce(F.col("gap") > n, F.lit(True)).cast("int")).over(order))
    piece = F.array_join(F.slice(F.split("gram", " "), n + 1 - F.col("adds"), F.col("adds")), " ")
    pieces = F.array_sort(F.collect_list(F.struct("pos", piece.alias("piece"))))
    return hits.groupBy(key, "island").agg(F.min("pos").alias("start"), F.sum("adds").alias("run_words"), F.array_join(F.transform(pieces, lambda x: x["piece"]), " ").alias("run")).drop("island")


def ngram_overlap(texts: DataFrame, protected: DataFrame, key: str, protected_key: str, n: int) -> DataFrame:
    """Pairs that share n-grams, with how many distinct ones: an equi-join on the n-gram."""
    a = texts.select(key, F.explode(F.array_distinct(ngrams(words(F.lower("text")), n))).alias("gram"))
    b = protected.select(protected_key, F.explode(F.array_distinct(ngrams(words(F.lower("text")), n))).alias("gram"))
    return a.join(b, "gram").groupBy(key, protected_key).agg(F.count(F.lit(1)).alias("shared_ngrams"))


def near_pairs(items: DataFrame, key: str, tokens: str, threshold: float) -> DataFrame:
    """Pairs of rows whose token sets have a Jaccard similarity of ``threshold`` or more, from shared tokens.

    Only a prefix of each set, in ascending order of how many rows have the token, is joined: sets as similar as asked
    must share one of its tokens.  The full sets then decide."""
    rows = items.select(key, F.array_distinct(tokens).alias("tokens")).filter(F.size("tokens") > 0)
    each = rows.select(key, F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    often = each.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("df", "token"))
    prefix = each.join(often, "token").withColumn("p", place).filter(F.col("p") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1)
    a, b = prefix.select(F.col(key).alias("key_a"), "token"), prefix.select(F.col(key).alias("key_b"), "token")
    pairs = a.join(b, "token").filter("key_a < key_b").select("key_a", "key_b").distinct()
    full = pairs.join(rows.select(F.col(key).alias("key_a"), F.col("tokens").alias("ta")), "key_a").join(rows.select(F.col(key).alias("key_b"), F.col("tokens").alias("tb")), "key_b")
    exact = F.size(F.array_intersect("ta", "tb")) / F.size(F.array_union("ta", "tb"))
    return full.withColumn("jaccard", exact).filter(F.col("jaccard") >= threshold).select("key_a", "key_b", F.round("jaccard", 3).alias("jaccard"))


def multiset_drift(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Words of ``left`` that ``right`` has not, and the other way, each as often as it is in excess: ``key, word, excess``."""
    a = left.select(key, F.explode("tokens").alias("word")).groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"))
    b = right.select(key, F.explode("tokens").alias("word")).groupBy(key, "word").agg(F.count(F.lit(1)).alias("m"))
    both = a.join(b, [key, "word"], "full")
    return both.withColumn("excess", F.coalesce("n", F.lit(0)) - F.coalesce("m", F.lit(0))).filter("excess <> 0").select(key, "word", "excess")


def highlighted(c: Column, marker: str) -> Column:
    """The whole marker, any case, in asterisks; letters and digits of any script and the underscore are inside a word."""
    return F.regexp_replace(c, rf"(?iu)(?<![\p{{L}}\p{{N}}_])({re.escape(marker)})(?![\p{{L}}\p{{N}}_])", "**$1**")


def unhighlighted(c: Column) -> Column:
    return F.replace(c, F.lit("**"), F.lit(""))


def redacted(c: Column) -> Column:
    """Key-like strings and bearer tokens masked."""
    return F.regexp_replace(F.regexp_replace(c, r"sk-[A-Za-z0-9_\-]{8,}", "[redacted]"), r"(?i)(bearer\s+)[A-Za-z0-9._\-]+", "$1[redacted]")


def sentences(c: Column) -> Column:
    """A rule-based split; common titles, initials and ``e.g.``/``i.e.`` do not end a sentence."""
    held = F.regexp_replace(c, r"\b(Mr|Mrs|Ms|Dr|Prof|St|No|vs|etc|e\.g|i\.e|[A-Z])\.(?=\s)", "$1\u0001")
    return F.transform(F.filter(F.split(F.trim(held), r"(?<=[.!?]|[.!?][\"'”’)])\s+(?=[\"'“‘(]?\p{Lu})"), lambda s: F.length(s) > 0), lambda s: F.replace(s, F.lit("\u0001"), F.lit(".")))


def ambiguity_counts(c: Column) -> dict[str, Column]:
    """How often each kind of unclear sentence end occurs."""
    return {
        "abbreviation": F.regexp_count(c, F.lit(r"\b(?:Mr|Mrs|Ms|Dr|Prof|St|e\.g|i\.e)\.")),
        "decimal": F.regexp_count(c, F.lit(r"\d\.\d")),
        "ellipsis": F.regexp_count(c, F.lit(r"\.\.\.|…")),
        "lower_case_start": F.regexp_count(c, F.lit(r"[.!?]\s+[a-z]")),
    }
