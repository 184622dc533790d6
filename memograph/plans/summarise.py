"""Condensing results that are too large for a context, level by level."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memograph import schema as S
from memograph.functions import text as T
from memograph.operators import folding
from memograph.session import ensure_checkpointing

Summariser = Callable[[DataFrame], DataFrame]


def leading_text(chars: int = 200) -> Summariser:
    """Deterministic stand-in for a model: the beginning of each piece."""

    def run(pieces: DataFrame) -> DataFrame:
        return pieces.withColumn("summary", F.left("text", F.lit(chars)))

    return run


#: A sentence of a piece: from its first character that is no blank to its closing marks or the end of its line.
SENTENCE = r"([^.!?\s][^.!?\n]*[.!?]*)"


def central_sentences(chars: int = 2_000) -> Summariser:
    """Every sentence of a piece is read; those that share most words with the others are kept, in order.

    A sentence scores, per thousand of its different words, the other sentences that its words stand in; ties go to the
    earlier one. Sentences are taken by score while all so far have at most ``chars`` characters, with one separator each.
    Where the first of them is longer, its beginning is the summary. A piece without sentences (blanks, closing marks) has
    the empty summary. A piece is a bounded number of characters, so its sentences fit a task however they are spread.
    """

    def run(pieces: DataFrame) -> DataFrame:
        keys = [c for c in pieces.columns if c != "text"]
        found = F.filter(F.transform(F.regexp_extract_all("text", F.lit(SENTENCE)), lambda s: F.trim(s)), lambda s: s != "")
        # One exchange: all windows and groups below are within a piece.
        each = pieces.repartition(*keys).select(*keys, F.posexplode_outer(found).alias("at", "sentence"))
        words = F.array_distinct(F.filter(F.split("sentence", " "), lambda w: w != ""))
        said = each.select(*keys, "at", "sentence", F.size(words).alias("n"), F.explode_outer(words).alias("word"))
        others = said.withColumn("others", F.count("*").over(W.partitionBy(*keys, "word")) - 1)
        scored = others.groupBy(*keys, "at", "sentence").agg(F.floor(F.sum("others") * 1000 / F.max("n")).alias("score"))
        best_first = W.partitionBy(*keys).orderBy(F.desc("score"), "at")
        upto = best_first.rowsBetween(W.unboundedPreceding, W.currentRow)
        taken = scored.withColumn("sum", F.sum(F.length("sentence") + 1).over(upto)).withColumn("rank", F.row_number().over(best_first))
        kept = F.when((F.col("sum") <= chars) | (F.col("rank") == 1), F.struct("at", F.left("sentence", F.lit(chars)).alias("sentence")))
        in_order = F.transform(F.array_sort(F.collect_list(kept)), lambda s: s["sentence"])
        return taken.groupBy(*keys).agg(F.array_join(in_order, " ").alias("summary"))

    return run


def pieces_of(df: DataFrame, key: str, value: Column) -> DataFrame:
    """Consecutive pieces of a fixed number of characters, numbered."""
    starts = F.sequence(F.lit(0), F.length(value) - 1, F.lit(S.SUMMARY_PIECE_CHARS))
    cut = F.transform(starts, lambda i: F.substring(value, i + 1, F.lit(S.SUMMARY_PIECE_CHARS)))
    return df.filter(F.length(value) > 0).select(key, F.posexplode(cut).alias("piece_no", "text"))


def one_level(df: DataFrame, key: str, value: str, summarise: Summariser) -> DataFrame:
    """``key, summary``: summaries of the pieces of every text, in order, one per line; empty ones take no line."""
    parts = summarise(pieces_of(df, key, F.col(value)))
    return folding.ordered_text(parts, [key], ["piece_no"], F.nullif("summary", F.lit("")), "summary")


def condense(df: DataFrame, key: str, value: str, summarise: Summariser) -> DataFrame:
    """``key, summary, levels, truncated, whole``: repeat until each text fits, beyond five levels as long as it shrinks.

    A text that neither fits nor shrinks any more is ``truncated``: its summary is the beginning that fits, and
    ``whole`` is all of it (null for the others).
    """
    ensure_checkpointing(df.sparkSession)
    large = T.estimate_tokens(F.col(value)) > S.SUMMARISE_TOKENS
    none = F.lit(None).cast("string").alias("whole")
    done = df.filter(~large).select(key, F.col(value).alias("summary"), F.lit(0).alias("levels"), F.lit(False).alias("truncated"), none)
    todo = df.filter(large).select(key, F.col(value).alias("text"), F.length(value).alias("before"))
    fits = T.estimate_tokens(F.coalesce("summary", F.lit(""))) <= S.SUMMARISE_TOKENS
    cut = F.left("summary", F.lit(S.SUMMARISE_TOKENS * 4))
    level = 0
    while level == 0 or not todo.isEmpty():
        level += 1
        step = one_level(todo, key, "text", summarise).join(todo.select(key, "before"), key).checkpoint()
        stuck = ~fits & (F.length("summary") >= F.col("before")) if level >= S.SUMMARY_MAX_DEPTH else F.lit(False)
        done = done.unionByName(step.filter(fits).select(key, "summary", F.lit(level).alias("levels"), F.lit(False).alias("truncated"), none))
        done = done.unionByName(
            step.filter(stuck).select(key, cut.alias("summary"), F.lit(level).alias("levels"), F.lit(True).alias("truncated"), F.col("summary").alias("whole"))
        )
        todo = step.filter(~fits & ~stuck).select(key, F.col("summary").alias("text"), F.length("summary").alias("before"))
    return done
