"""Top-k retrieval, lexical and by vector."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memograph import schema as S
from memograph.functions.text import let, overlap_ratio, search_tokens

QUERIES_PER_BLOCK = 1024
VECTORS_PER_BLOCK = 16_384


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` rows per key, numbered; cut down on the map side before the shuffle."""
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def like_hits(text: Column, tokens: Column) -> Column:
    """Number of tokens for which ``text`` is LIKE ``%token%``; repeated tokens count again.

    Only an underscore makes LIKE differ from a plain search, which needs no pattern.
    """

    def hit(bound: Column, t: Column) -> Column:
        wild = F.like(bound, F.concat(F.lit("%"), t, F.lit("%")))
        return F.when(F.contains(t, F.lit("_")), wild).otherwise(F.contains(bound, t))

    return let(text, lambda bound: F.size(F.filter(tokens, lambda t: hit(bound, t))))


def matched(text: Column, tokens: Column) -> Column:
    """The tokens that literally occur in ``text``."""
    return let(text, lambda bound: F.filter(tokens, lambda t: F.contains(bound, t)))


def _scored(pairs: DataFrame, text: str, tokens: str) -> DataFrame:
    score = like_hits(F.lower(F.col(text)), F.col(tokens)).cast("double")
    return pairs.withColumn("score", score).filter("score > 0")


def _with_matched(best: DataFrame, text: str, tokens: str) -> DataFrame:
    return best.withColumn("matched_terms", matched(F.lower(F.col(text)), F.col(tokens))).drop(tokens)


def search_chunks(chunks: DataFrame, queries: Sequence[str], limit: int = 20) -> DataFrame:
    """Corpus-wide lexical search for a handful of query strings in one pass over the chunks."""
    listed = F.array(
        *[F.struct(F.lit(i).alias("query_no"), search_tokens(F.lit(q)).alias("tokens")) for i, q in enumerate(queries)]
    )
    asked = chunks.select("*", F.inline(listed))
    order = [F.desc("score"), F.asc("document_id"), F.asc("chunk_index")]
    return _with_matched(top_k(_scored(asked, "text", "tokens"), ["query_no"], order, limit), "text", "tokens")


def search_scoped_chunks(requests: DataFrame, pairs: DataFrame, query: str, limit: int) -> DataFrame:
    """Lexical search among the chunks already paired with a ``request_id``.

    ``query`` names the text column of ``requests``.
    """
    asked = pairs.join(requests.select("request_id", search_tokens(query).alias("tokens")), "request_id")
    order = [F.desc("score"), F.asc("document_id"), F.asc("chunk_index")]
    return _with_matched(top_k(_scored(asked, "text", "tokens"), ["request_id"], order, limit), "text", "tokens")


def candidate_text() -> Column:
    """Everything about an entry that a lexical query may match."""
    evidence = F.array_join(F.transform("evidence", lambda e: e["text"]), " ")
    metadata = F.when(F.col("metadata_json") != "{}", F.col("metadata_json")).otherwise(F.lit(""))
    return F.concat_ws(
        " ", "prompt", "task_type", "output_contract", "result", F.array_join("reusable_as", " "), evidence, metadata
    )


def rank_entries(pairs: DataFrame, query: str, scoped: bool, limit: int) -> DataFrame:
    """Rank entries matched to requests by shared terms, scope fit and reuse mode.

    ``pairs`` holds the request side, the entry side and ``entry_terms``. Without a scope
    every live entry is a pair and the scope bonus does not apply.
    """
    wanted = F.array_distinct(search_tokens(query))
    terms = F.array_sort(F.array_intersect(wanted, F.col("entry_terms")))
    score = F.size("matched_terms").cast("double")
    if scoped:
        same = (F.col("scope_start") == F.col("start")) & (F.col("scope_end") == F.col("end"))
        score = score + F.when(same, 3.0).otherwise(2.0)
    for mode in (S.EXACT_ANSWER, S.SUPPORTING_FACT):
        score = score + F.when(F.array_contains("reusable_as", mode), 0.25).otherwise(0.0)
    ranked = pairs.withColumn("matched_terms", terms).withColumn("score", score).filter("score > 0")
    order = [F.desc("score"), F.desc("confidence"), F.asc("scope_start"), F.desc("entry_id")]
    return top_k(ranked, ["request_id"], order, limit)


def rerank(
    pairs: DataFrame, key: str, query: str, text: str, tie: str,
    top: int = S.RERANK_TOP, threshold: float = S.RERANK_THRESHOLD, scorer: Column | None = None,
) -> DataFrame:
    """Re-score candidates, keep the best ``top``, then drop those below the gate."""
    default = overlap_ratio(search_tokens(query), search_tokens(text))
    scored = pairs.withColumn("rerank_score", F.round(scorer if scorer is not None else default, 6))
    best = top_k(scored, [key], [F.desc("rerank_score"), F.asc(tie)], top)
    return best.filter(F.col("rerank_score") >= threshold)


def dot(left: Column, right: Column) -> Column:
    """Inner product of two float arrays, accumulated in double."""
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def mean_vectors(vectors: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """Mean vector per key, summed per dimension so that big keys are combined before the shuffle."""
    cells = vectors.select(key, F.posexplode(vector).alias("dim", "x"))
    means = cells.groupBy(key, "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda c: c["x"]).alias(vector)
    )


def nearest(
    queries: DataFrame, vectors: DataFrame, query_id: str, vector_id: str, k: int,
    vector: str = "embedding", per_block: int = QUERIES_PER_BLOCK,
) -> DataFrame:
    """Exact top-k by inner product of every query over all vectors; rows without an id or a vector take no part.

    Queries and vectors are dealt into blocks, and each pair of blocks is one matrix product in a task, of which k rows
    per query are kept. Nothing is gathered on the driver but the two counts that give the number of blocks.
    """
    kind = "ARRAY<DOUBLE>"
    asked = queries.select(F.col(query_id).cast("bigint").alias("q"), F.col(vector).cast(kind).alias("v")).dropna()
    known = vectors.select(F.col(vector_id).cast("bigint").alias("i"), F.col(vector).cast(kind).alias("v")).dropna()
    query_blocks, blocks = (-(-df.count() // n) or 1 for df, n in ((asked, per_block), (known, VECTORS_PER_BLOCK)))

    def dealt(df: DataFrame, key: str, own: str, count: int, other: str, others: int) -> DataFrame:
        copies = F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        return df.select(key, "v", F.pmod(F.xxhash64(key), F.lit(count)).cast("int").alias(own), copies.alias(other))

    left = dealt(asked, "q", "query_block", query_blocks, "block", blocks)
    right = dealt(known, "i", "block", blocks, "query_block", query_blocks)
    schema = pa.schema([(query_id, pa.int64()), (vector_id, pa.int64()), ("score", pa.float64())])

    def matrix(table: pa.Table) -> np.ndarray:
        values = table.column("v").combine_chunks()
        return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)

    def best(asking: pa.Table, given: pa.Table) -> pa.Table:
        made = [[], [], []]
        if len(asking) and len(given):
            names, ids = asking.column("q").to_numpy(), given.column("i").to_numpy()
            scores = np.round(matrix(asking) @ matrix(given).T, 6)
            for name, row in zip(names, scores):
                reach = np.flatnonzero(row >= np.partition(row, -k)[-k]) if len(row) > k else np.arange(len(row))
                keep = reach[np.lexsort((ids[reach], -row[reach]))[:k]]
                for column, values in zip(made, (np.full(keep.size, name), ids[keep], row[keep])):
                    column.append(values)
        columns = [np.concatenate(c) if c else np.empty(0) for c in made]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    keys = ["block", "query_block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, f"{query_id} BIGINT, {vector_id} BIGINT, score DOUBLE")
    return top_k(found, [query_id], [F.desc("score"), F.asc(vector_id)], k)
