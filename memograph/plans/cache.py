"""Question and answer cache: lookup, warming and migration into the memo."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memograph import schema as S
from memograph.functions import entries as E
from memograph.functions import facts
from memograph.functions import identity as I
from memograph.functions import text as T
from memograph.operators import matching, ranking

SEARCH_TASK = ("retrieval_search", "synthesized_answer")
FACT_TASK = ("legacy_knowledge_fact", "fact_triple")


def _plain(query):
    return F.lower(T.strip(query))


def bucket_matches(lookups: DataFrame, cache: DataFrame) -> DataFrame:
    """Cached rows in the bucket of each lookup whose question is the same up to case."""
    return lookups.withColumn("plain", _plain("query")).drop("query").join(
        cache.withColumn("plain", _plain("query")).drop("query"), ["chunk_hash", "plain"]
    )


Judge = Callable[[DataFrame], DataFrame]


def judged(near: DataFrame, judge: Judge, candidates: int = S.TOP_K_CANDIDATES) -> DataFrame:
    """Of the best candidates per lookup, those a judge accepts.

    The judge gets ``wanted`` and ``plain`` questions with their rank and adds a boolean ``hit``.
    """
    best = ranking.top_k(near, ["lookup_id"], [F.desc("similarity"), F.asc("cache_id")], candidates)
    return judge(best).filter("hit")


def in_scope(cache: DataFrame, active_scope: str | None) -> DataFrame:
    """Cached rows made for the active data scope; all of them without one."""
    return cache.filter(E.in_active_scope(F.coalesce("data_scope_hash", F.lit("")), active_scope)) if active_scope else cache


def lookup(
    lookups: DataFrame, cache: DataFrame, threshold: float = 0.8, judge: Judge | None = None, active_scope: str | None = None
) -> DataFrame:
    """Exact hit, else the most similar question in the bucket, else a miss; hits are guarded.

    With an active data scope, rows of other scopes and of none cannot answer.

    Rows with the same question in a bucket are reduced to the first one before matching. With
    a judge, similarity only proposes candidates and the first accepted one counts.
    """
    cache = in_scope(cache, active_scope)
    first = cache.withColumn("plain", _plain("query")).groupBy("chunk_hash", "plain").agg(F.min("cache_id").alias("cache_id"))
    asked = lookups.withColumn("wanted", _plain("query")).drop("query")
    exact = asked.join(first.withColumnRenamed("plain", "wanted"), ["chunk_hash", "wanted"]).select("lookup_id", "cache_id")
    rest = asked.join(exact, "lookup_id", "left_anti")
    near = matching.similar_text_join(rest, first, ["chunk_hash"], "wanted", "plain", threshold)
    if judge is not None:
        near = judged(near, judge)
    best = near.groupBy("lookup_id").agg(
        F.min(F.struct((-F.col("similarity")).alias("distance"), "cache_id"))["cache_id"].alias("cache_id")
    )
    hits = exact.withColumn("outcome", F.lit("exact")).unionByName(best.withColumn("outcome", F.lit("semantic")))
    ground = facts.grounding(F.col("result"), F.col("source_context"))
    stored = cache.select("cache_id", "result", facts.guard(F.col("result")).alias("guard"), ground["grounding"].alias("grounding"))
    return lookups.select("lookup_id").join(hits.join(stored, "cache_id"), "lookup_id", "left").select(
        "lookup_id", F.coalesce("outcome", F.lit("miss")).alias("outcome"), "cache_id", "result", "guard", "grounding"
    )


def to_warm(chunks: DataFrame, queries: Sequence[str], cache: DataFrame | None = None) -> DataFrame:
    """Every query for every non-blank chunk that the cache cannot answer yet."""
    asked = (
        chunks.filter(T.strip("text") != "")
        .withColumn("chunk_hash", I.chunk_hash(F.col("text")))
        .withColumn("query", F.explode(F.array(*map(F.lit, queries))))
    )
    if cache is None:
        return asked
    known = cache.select("chunk_hash", _plain("query").alias("plain")).distinct()
    return asked.withColumn("plain", _plain("query")).join(known, ["chunk_hash", "plain"], "left_anti").drop("plain")


def _scope_of_cache(cache: DataFrame) -> DataFrame:
    """Scope of a cached row: the corpus version it was made for, or its own bucket."""
    versioned = F.col("data_scope_hash") != ""
    return cache.withColumns(
        {
            "corpus_id": F.lit("default"),
            "document_id": F.when(versioned, "active_search_corpus").otherwise(F.concat(F.lit("legacy_cache:"), "chunk_hash")),
            "unit": F.when(versioned, "scope").otherwise("legacy_cache_entry"),
            "content_hash": F.when(versioned, F.col("data_scope_hash")).otherwise(F.col("chunk_hash")),
            "start": F.lit(0).cast("bigint"),
            "end": F.lit(1).cast("bigint"),
        }
    )


def _entries(rows: DataFrame, task: tuple[str, str], mode: str, created_at: str) -> DataFrame:
    from memograph.plans.solve import as_entries

    task_type, contract = task
    prepared = rows.withColumns(
        {
            "task_type": F.lit(task_type), "output_contract": F.lit(contract), "constraints_json": F.lit("{}"),
            "reusable_as": F.array(F.lit(mode)), "not_found": F.lit(False), "confidence": F.lit(1.0),
        }
    )
    signed = prepared.withColumn(
        "task_signature",
        I.task_signature(F.col("prompt"), F.col("task_type"), F.col("output_contract"), F.col("constraints_json")),
    )
    return as_entries(signed, created_at)


def _unknown_only(entries: DataFrame, memo: DataFrame) -> DataFrame:
    """New entries without a stored exact answer for their task and scope, one per identity."""
    keys = ["task_signature", "corpus_id", "document_id", "unit", "content_hash", "scope_start", "scope_end"]
    known = memo.filter(
        F.array_contains("reusable_as", S.EXACT_ANSWER) & (F.col("verifier_status") != S.REJECTED)
    ).select(*keys).distinct()
    return entries.join(known, keys, "left_anti").dropDuplicates(["entry_id"])


def migrate_cache(cache: DataFrame, memo: DataFrame, created_at: str, active_scope: str | None = None) -> DataFrame:
    """Cached answers, of the active data scope if there is one, as exact entries; not those the memo already answers."""
    cache = in_scope(cache, active_scope)
    span = F.struct(
        F.col("document_id"), F.col("start"), F.col("end"), F.col("unit"), F.col("source_context").alias("text")
    )
    none = F.array().cast(S.EVIDENCE)
    rows = _scope_of_cache(cache).withColumns(
        {
            "prompt": F.col("query"),
            "evidence": F.when(F.col("source_context") != "", F.array(span)).otherwise(none),
            "metadata_json": I.json_object(
                source=I.json_string(F.lit("legacy_cache_adapter")), chunk_hash=I.json_string(F.col("chunk_hash"))
            ),
        }
    )
    return _unknown_only(_entries(rows, SEARCH_TASK, S.EXACT_ANSWER, created_at), memo)


def facts_of_cache(cache: DataFrame) -> DataFrame:
    """Triples found in cached results, with the row they came from."""
    return cache.select("cache_id", F.inline(facts.triples(F.col("result"))))


def migrate_facts(
    known_facts: DataFrame, cache: DataFrame, memo: DataFrame, created_at: str, active_scope: str | None = None
) -> DataFrame:
    """Known triples as supporting facts in the scope of their source row, which must be of the active data scope if there is one."""
    cache = in_scope(cache, active_scope)
    text = T.strip(F.concat_ws(" ", "subject", "relation", "object"))
    span = F.struct(
        F.col("document_id"), F.col("start"), F.col("end"), F.col("unit"), F.col("source_context").alias("text")
    )
    rows = (
        known_facts.withColumn("prompt", text).filter("prompt <> ''").join(_scope_of_cache(cache).drop("result"), "cache_id")
        .withColumns(
            {
                "result": F.col("prompt"), "evidence": F.array(span),
                "metadata_json": F.lit('{"source":"legacy_knowledge_adapter"}'),
            }
        )
    )
    return _unknown_only(_entries(rows, FACT_TASK, S.SUPPORTING_FACT, created_at), memo)
