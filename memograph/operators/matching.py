"""Joins between requested scopes and stored scopes.

Every join keeps its equality keys and adds one more: the bin of positions both
sides touch. A long document is thereby split over many join keys, and only
intervals that come close to each other are ever compared.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memograph.functions import entries as E
from memograph.functions.text import search_tokens
from memograph.schema import SCOPE_KEYS

POSITIONS_PER_BIN = 1024


def _bin(position: Column, width: int) -> Column:
    return F.floor(position / width)


def _binned(df: DataFrame, start: str, end: str, width: int) -> DataFrame:
    bins = F.sequence(_bin(F.col(start), width), _bin(F.col(end) - 1, width))
    return df.filter(F.col(end) > F.col(start)).withColumn("bin", F.explode(bins))


def overlapping(
    requests: DataFrame,
    stored: DataFrame,
    keys: Sequence[str] = SCOPE_KEYS,
    width: int = POSITIONS_PER_BIN,
) -> DataFrame:
    """Pairs whose keys agree, whose hashes are compatible and whose intervals overlap.

    ``requests`` carries ``start, end, content_hash``; ``stored`` carries ``scope_start,
    scope_end, content_hash``, returned as ``stored_hash``. A pair meeting in several bins
    is kept in the first one only.
    """
    left = _binned(requests, "start", "end", width)
    right = _binned(
        stored.withColumnRenamed("content_hash", "stored_hash"), "scope_start", "scope_end", width
    )
    first_shared = F.greatest(_bin(F.col("start"), width), _bin(F.col("scope_start"), width))
    return (
        left.join(right, [*keys, "bin"])
        .filter(E.compatible_hash(F.col("content_hash"), F.col("stored_hash")))
        .filter("start < scope_end AND end > scope_start")
        .filter(F.col("bin") == first_shared)
        .drop("bin")
    )


def candidates(
    requests: DataFrame, entries: DataFrame, payload: Sequence[str] = (), same_task: bool = True, asked: Sequence[str] = ()
) -> DataFrame:
    """Live entries overlapping each request, of the same task unless told otherwise.

    Pairs have the ``payload`` columns of the entry and the ``asked`` ones of the request.
    """
    keys = [*SCOPE_KEYS, "task_signature"] if same_task else SCOPE_KEYS
    wanted = requests.select("request_id", *keys, "start", "end", "content_hash", *asked)
    live = entries.filter(~E.is_rejected()).select(
        "entry_id", *keys, "scope_start", "scope_end", "content_hash", *payload
    )
    return overlapping(wanted, live, keys)


def clipped(pairs: DataFrame) -> DataFrame:
    """Stored intervals cut down to the request they were matched with."""
    return pairs.withColumns(
        {
            "clip_start": F.greatest("start", "scope_start"),
            "clip_end": F.least("end", "scope_end"),
        }
    )


def containing(pairs: DataFrame) -> DataFrame:
    """Of overlapping pairs, those where the stored scope holds the whole request."""
    return pairs.filter("scope_start <= start AND scope_end >= end")


def exact_replays(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """``request_id, exact_entry_id``: the oldest live exact answer with the very same scope."""
    keys = [*SCOPE_KEYS, "task_signature"]
    oldest = (
        entries.filter(~E.is_rejected() & E.offers("exact_answer"))
        .groupBy(*keys, F.col("scope_start").alias("start"), F.col("scope_end").alias("end"),
                 F.col("content_hash").alias("stored_hash"))
        .agg(F.min(F.struct("created_at", "entry_id")).alias("oldest"))
    )
    return (
        requests.select("request_id", *keys, "start", "end", "content_hash")
        .join(oldest, [*keys, "start", "end"])
        .filter(E.compatible_hash(F.col("content_hash"), F.col("stored_hash")))
        .groupBy("request_id")
        .agg(F.min("oldest")["entry_id"].alias("exact_entry_id"))
    )


def exact_replays_any_scope(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """Scope-less replay: the oldest live exact answer to the same task, wherever it was found."""
    oldest = (
        entries.filter(~E.is_rejected() & E.offers("exact_answer"))
        .groupBy("task_signature")
        .agg(F.min(F.struct("created_at", "entry_id"))["entry_id"].alias("exact_entry_id"))
    )
    return requests.select("request_id", "task_signature").join(oldest, "task_signature").drop("task_signature")


def context_range(ranges: DataFrame, chunks: DataFrame, width: int = POSITIONS_PER_BIN) -> DataFrame:
    """Raw chunks inside each requested range, compatible hashes only."""
    points = chunks.withColumns(
        {"scope_start": F.col("chunk_index"), "scope_end": F.col("chunk_index") + 1}
    )
    return overlapping(ranges, points, SCOPE_KEYS, width).drop("scope_start", "scope_end")


def ordered_terms(text: Column) -> Column:
    """Distinct search terms, the presumably rarest first: with digits, then longer ones."""
    ranked = F.transform(
        F.array_distinct(search_tokens(text)),
        lambda t: F.struct((~t.rlike("[0-9]")).alias("plain"), (-F.length(t)).alias("size"), t.alias("term")),
    )
    return F.transform(F.array_sort(ranked), lambda r: r["term"])


def similar_text_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_text: str, right_text: str, threshold: float
) -> DataFrame:
    """Pairs with equal keys whose term sets have a Jaccard similarity of at least ``threshold``.

    Exact by prefix filtering: two sets that similar must share one of their first
    ``n - ceil(threshold * n) + 1`` terms in any common order, so only rows sharing such a
    term meet. The pair is kept at its first shared prefix term.
    """

    def prepared(df: DataFrame, text: str, side: str) -> DataFrame:
        terms = f"{side}_terms"
        size = F.size(terms)
        length = size - F.ceil(F.lit(threshold) * size).cast("int") + 1
        return (
            df.withColumn(terms, ordered_terms(F.col(text)))
            .filter(size > 0)
            .withColumn(f"{side}_prefix", F.slice(terms, F.lit(1), length))
            .withColumn("term", F.explode(f"{side}_prefix"))
        )

    shared = F.size(F.array_intersect("left_terms", "right_terms"))
    union = F.size("left_terms") + F.size("right_terms") - shared
    return (
        prepared(left, left_text, "left")
        .join(prepared(right, right_text, "right"), [*keys, "term"])
        .filter(F.col("term") == F.get(F.array_intersect("left_prefix", "right_prefix"), F.lit(0)))
        .withColumn("similarity", F.round(shared / union, 6))
        .filter(shared >= F.lit(threshold) * union)
        .drop("term", "left_terms", "right_terms", "left_prefix", "right_prefix")
    )
