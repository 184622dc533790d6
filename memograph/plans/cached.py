"""Questions answered through the cache: check, route, execute, compare, store, guard.

A batch of questions is looked up at once; what the cache cannot answer is executed, each different question of a bucket
once, and stored as one commit over four tables. Questions of a batch do not see each other's answers, later batches do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memograph import schema as S
from memograph.functions import facts
from memograph.functions import identity as I
from memograph.functions import text as T
from memograph.functions.embedding import hashed_embedding
from memograph.functions.parsing import route_model
from memograph.plans import cache as caching
from memograph.session import ensure_checkpointing
from memograph.sources.batches import Batches

SCHEMAS = {
    "cache": "cache_id STRING, query STRING, result STRING, source_context STRING, chunk_hash STRING, data_scope_hash STRING, model STRING, grounding STRING",
    "facts": "cache_id STRING, subject STRING, relation STRING, object STRING",
    "memo_entries": S.MEMO_ENTRIES,
    "vectors": "cache_id STRING, kind STRING, text STRING, embedding ARRAY<FLOAT>",
}
Executor = Callable[[DataFrame], DataFrame]


class CacheStore:
    """Cached answers with their facts, memo entries and vectors; a batch is visible in all of them or in none."""

    def __init__(self, spark: SparkSession, path: str, embed: Callable[[Column], Column] = hashed_embedding) -> None:
        self.spark, self.embed = spark, embed
        self.batches = Batches(spark, path, SCHEMAS)

    def table(self, name: str) -> DataFrame:
        return self.batches.read(name).drop("commit", "seq")

    def store(self, answers: DataFrame, batch: str, created_at: str) -> None:
        """Add answers: cache_id, query, context, chunk_hash, data_scope_hash, model and result. A stored batch is not repeated.

        Answers should be checkpointed, as they are read once per table. Grounding is judged now and kept with the answer.
        """
        if self.batches.has(batch):
            return
        rows = answers.select(
            "cache_id", "query", F.coalesce("result", F.lit("")).alias("result"), F.coalesce("context", F.lit("")).alias("source_context"),
            "chunk_hash", F.coalesce("data_scope_hash", F.lit("")).alias("data_scope_hash"), "model",
        )
        rows = rows.withColumn("grounding", facts.grounding(F.col("result"), F.col("source_context"))["grounding"])
        known = caching.facts_of_cache(rows)
        spoken = known.select("cache_id", F.lit("fact").alias("kind"), F.concat_ws(" ", "subject", "relation", "object").alias("text"))
        texts = rows.select("cache_id", F.lit("query").alias("kind"), F.col("query").alias("text")).unionByName(spoken)
        commit = self.batches.begin()
        self.batches.write(commit, "cache", rows)
        self.batches.write(commit, "facts", known)
        self.batches.write(commit, "memo_entries", caching.migrate_cache(rows, self.table("memo_entries"), created_at))
        self.batches.write(commit, "vectors", texts.withColumn("embedding", self.embed(F.col("text")).cast("array<float>")))
        self.batches.publish(commit, batch)


def cached_query(
    lookups: DataFrame, store: CacheStore, execute: Executor, batch: str, created_at: str, second_opinion: Executor | None = None,
    threshold: float = 0.8, judge: caching.Judge | None = None, active_scope: str | None = None,
) -> DataFrame:
    """Per lookup: outcome, from_cache, executed, cache_id, result, guard, grounding, model, consensus, divergent.

    ``lookups`` has ``lookup_id, query, context``. ``execute`` gets ``cache_id, query, context, model`` of the questions to
    answer and adds ``result``; ``second_opinion`` does the same to check the figures of the answers. ``executed`` marks
    the lookup whose question was sent to the model; others of the batch with the same question share its answer. The
    report is checkpointed, so it tells of the cache as this batch found it.
    """
    ensure_checkpointing(lookups.sparkSession)
    asked = lookups.select("lookup_id", "query", "context", I.chunk_hash(F.col("context")).alias("chunk_hash"), F.lower(T.strip("query")).alias("plain"))
    cache = store.table("cache")
    found = caching.lookup(asked.select("lookup_id", "query", "chunk_hash"), cache, threshold, judge, active_scope).checkpoint()
    missed = asked.join(found.filter("outcome = 'miss'").select("lookup_id"), "lookup_id", "left_semi")
    once = missed.groupBy("chunk_hash", "plain").agg(F.min(F.struct("lookup_id", "query", "context")).alias("first")).select(
        "chunk_hash", "plain", F.concat(F.lit(f"{batch}:"), F.col("first.lookup_id").cast("string")).alias("cache_id"),
        F.col("first.lookup_id").alias("asked_by"), "first.query", "first.context",
    ).withColumn("model", route_model(F.col("query")))
    answered = execute(once.checkpoint()).checkpoint()
    if second_opinion is None:
        checked = answered.withColumn("second", F.col("result"))
    else:
        other = second_opinion(answered.drop("result")).select("cache_id", F.col("result").alias("second"))
        checked = answered.join(other, "cache_id").checkpoint()
    compared = facts.consensus(F.col("result"), F.col("second"))
    judged = checked.withColumns({"consensus": compared["consensus"], "divergent": compared["divergent"]})
    scope = F.lit(active_scope) if active_scope else F.col("chunk_hash")
    store.store(answered.withColumn("data_scope_hash", scope), batch, created_at)
    fresh = missed.select("lookup_id", "chunk_hash", "plain").join(judged, ["chunk_hash", "plain"]).select(
        "lookup_id", F.lit("miss").alias("outcome"), F.lit(False).alias("from_cache"), (F.col("lookup_id") == F.col("asked_by")).alias("executed"),
        "cache_id", "result", facts.guard(F.col("result")).alias("guard"),
        facts.grounding(F.col("result"), F.coalesce("context", F.lit("")))["grounding"].alias("grounding"), "model", "consensus", "divergent",
    )
    models = cache.select("cache_id", "model")
    hits = found.filter("outcome <> 'miss'").join(models, "cache_id", "left").select(
        "lookup_id", "outcome", F.lit(True).alias("from_cache"), F.lit(False).alias("executed"), "cache_id", "result", "guard", "grounding", "model",
        F.lit(None).cast("string").alias("consensus"), F.lit(None).cast("array<string>").alias("divergent"),
    )
    return hits.unionByName(fresh).checkpoint()
