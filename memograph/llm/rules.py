"""Quality rules whose cutoffs are chosen under a risk limit, in DataFrame functions only.

Rules are put in levels, each stricter than the one before: a cutoff per measure. In every stratum the labelled
documents that nobody evaluates on say how many good ones a level would reject. A level is proven if the exact
binomial chance of so few false rejections, were the true rate above ``risk``, is at most ``delta`` divided by the
number of tests (levels times strata, Bonferroni). The strictest level counts up to which all are proven; a stratum
without proof rejects by the base rules alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memograph.llm.common import GAP, checkpointed, fold, stored

RISK = 0.02
DELTA = 0.05
#: Per level: most symbols, repeated lines and repeated words, by characters, lines and words; shortest and longest mean word.
LEVELS = [
    (0.50, 0.95, 0.50, 1.0, 20.0), (0.40, 0.90, 0.49, 1.2, 18.0), (0.30, 0.85, 0.48, 1.4, 16.0), (0.20, 0.80, 0.46, 1.6, 14.0),
    (0.15, 0.70, 0.44, 1.8, 13.0), (0.10, 0.60, 0.42, 2.0, 12.0), (0.06, 0.50, 0.40, 2.2, 11.0), (0.04, 0.45, 0.38, 2.5, 10.0),
]
#: Proven levels of at most so many strata are sent to all tasks.
FEW_STRATA = 10_000
SYMBOLS = r"[#*$%&|<>]"
SPACES = " \t\n\u000b\f\r"


def counted(docs: DataFrame, whole_rows: bool = False) -> DataFrame:
    """Per row: doc_id, stratum and the counts of its whole text; a null text counts as an empty one.

    With ``whole_rows`` all columns of ``docs`` come along in a struct ``row``.

    Windows of three words are compared by 64-bit hashes within their document.
    """
    text = F.coalesce("text", F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACES))
    stratum = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if whole_rows else F.lit(None)
    words = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), stratum.alias("stratum"), row.alias("row"), text.alias("text"),
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP)).alias("words"),
    ).withColumn("n_words", F.size("words").cast("long"))
    windows = F.arrays_zip(*[F.slice("words", i, F.greatest(F.size("words") - 2, F.lit(0))).alias(f"w{i}") for i in (1, 2, 3)])
    hashed = words.withColumn("hashes", F.transform(windows, lambda w: F.xxhash64(w["w1"], w["w2"], w["w3"])))
    again = F.size("hashes") > F.size(F.array_distinct("hashes"))
    ordered = hashed.select(
        "doc_id", "stratum", "row", "n_words", F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "").alias("lines"),
        F.when(again, F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("sorted"),
    )
    size = F.greatest(F.size("sorted") - 1, F.lit(0))
    beside = F.arrays_zip(F.slice("sorted", 1, size).alias("x"), F.slice("sorted", 2, size).alias("y"))
    equal = F.filter(beside, lambda z: z["x"]["h"] == z["y"]["h"])
    places = ordered.withColumn(
        "places", F.when(F.col("sorted").isNotNull(), F.sort_array(F.array_distinct(F.flatten(F.transform(equal, lambda z: F.array(z["x"]["i"], z["y"]["i"]))))))
    )
    # A window covers three words, or as many as there are before the next one begins.
    steps = F.arrays_zip(F.slice("places", 1, F.size("places") - 1).alias("x"), F.slice("places", 2, F.size("places") - 1).alias("y"))
    repeated = 3 + F.aggregate(steps, F.lit(0), lambda total, z: total + F.least(z["y"] - z["x"], F.lit(3)))
    return places.select(
        "doc_id", "stratum", "row", "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("places").isNull(), F.lit(0)).otherwise(repeated).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def broken_level() -> Column:
    """The mildest level that a document breaks; null if none."""
    share = lambda part, whole: F.col(part) / F.greatest(F.col(whole), F.lit(1))
    symbols, lines, words = share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words")
    length = share("word_chars", "n_words")
    breaks = [
        F.when((symbols > a) | (lines > b) | (words > c) | (length < d) | (length > e), F.lit(level))
        for level, (a, b, c, d, e) in enumerate(LEVELS, 1)
    ]
    return F.coalesce(*breaks)


def log_gamma(x: Column) -> Column:
    """Stirling's series seven steps up, exact to about 13 digits for x >= 1."""
    y = x + 7
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    product = x
    for i in range(1, 7):
        product = product * (x + i)
    return series - F.log(product)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X of n trials with chance p, summed down from k; 1 where k is not below the mean."""
    k, n = k.cast("double"), n.cast("double")
    at_k = F.exp(log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    # Terms fall at least as a normal density does; beyond ten deviations nothing is left of a double.
    terms = F.least(k, F.ceil(10 * F.sqrt(n * p * (1 - p))) + 60).cast("int")
    start = F.struct(F.lit(0.0).alias("total"), F.lit(1.0).alias("term"))

    def add(done: Column, i: Column) -> Column:
        j = k - i
        return F.struct((done["total"] + done["term"]).alias("total"), (done["term"] * j * (1 - p) / ((n - j + 1) * p)).alias("term"))

    summed = F.aggregate(F.sequence(F.lit(0), terms), start, add, lambda done: done["total"])
    return F.when(k < n * p, F.least(at_k * summed, F.lit(1.0))).otherwise(F.lit(1.0))


def proven_levels(measured: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """Per stratum: the strictest level whose false rejections are proven rare, 0 if none is."""
    marked = labels.filter("quality = 1").select("doc_id").distinct()
    good = measured.filter(fold("doc_id") != 0).join(marked, "doc_id", "left_semi").filter(~base_failed())
    tallied = good.groupBy("stratum").agg(
        F.count("*").alias("n"), *[F.count_if(broken_level() <= level).alias(f"k{level}") for level in range(1, len(LEVELS) + 1)]
    )
    strata = max(measured.select("stratum").distinct().count(), 1)
    limit = delta / (strata * len(LEVELS))
    tests = tallied.select("stratum", "n", F.posexplode(F.array(*[f"k{level}" for level in range(1, len(LEVELS) + 1)])))
    failing = F.when(binomial_tail(F.col("col"), F.col("n"), risk) > limit, F.col("pos"))
    return tests.groupBy("stratum").agg(F.coalesce(F.min(failing), F.lit(len(LEVELS))).alias("level"))


def _levels(measured: DataFrame, labels: DataFrame, risk: float, delta: float) -> DataFrame:
    """The proven levels for stored counts, sent along where they are few."""
    levels = checkpointed(proven_levels(measured, labels, risk, delta).filter("level > 0"))
    return F.broadcast(levels) if levels.count() <= FEW_STRATA else levels


def _judged(measured: DataFrame, levels: DataFrame) -> DataFrame:
    known = measured.join(levels, "stratum", "left").withColumn("level", F.coalesce("level", F.lit(0)).cast("int"))
    broken = F.coalesce(broken_level(), F.lit(len(LEVELS) + 1))
    return known.withColumns({"base_failed": base_failed(), "kept": ~base_failed() & (broken > F.col("level"))})


def quality_rules(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """Per row of ``docs``: doc_id, the counts, base_failed, level (proven for its stratum) and kept.

    Strata are the values of ``lang`` (null, empty and a missing column are one stratum). Labels of quality 1 count whose
    doc_id is in ``docs`` and outside the evaluation fold; repeated labels count once, null ones not. An empty or null
    text has no words and fails the base rules. A row without a doc_id is judged like any other, but never learned from.
    """
    measured = stored(counted(docs).drop("row"), "measured")
    return _judged(measured, _levels(measured, labels, risk, delta)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "level"
    )


def kept_rows(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """The rows of ``docs`` that the rules keep, unchanged, with all their columns; see ``quality_rules`` for odd rows.

    Rows are stored with their counts, once. A filter right above the counts would make the optimiser copy the whole chain of
    array functions into every comparison.
    """
    whole = stored(counted(docs, whole_rows=True), "counted")
    return _judged(whole, _levels(whole.drop("row"), labels, risk, delta)).filter("kept").select("row.*")
