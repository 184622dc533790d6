"""Rollups over stored entries, model calls, scores and runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memograph import schema as S
from memograph.functions import entries as E


def count_where(test: Column) -> Column:
    return F.coalesce(F.sum(F.when(test, 1).otherwise(0)), F.lit(0)).cast("bigint")


def ratio(part: Column, whole: Column, digits: int = 6) -> Column:
    """``part / whole`` rounded, 0 where there is nothing to divide by."""
    return F.round(F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0)), digits)


def store_totals(entries: DataFrame) -> DataFrame:
    return entries.agg(
        F.count("*").alias("entry_count"),
        F.coalesce(F.sum(F.size("dependencies")), F.lit(0)).cast("bigint").alias("dependency_edge_count"),
        F.coalesce(F.sum(F.size("evidence.start")), F.lit(0)).cast("bigint").alias("evidence_span_count"),
        F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 6).alias("average_confidence"),
    )


def store_counts(entries: DataFrame) -> DataFrame:
    """Entry counts by fragment kind, result type and verifier state in one pass."""
    labelled = entries.select(E.fragment_kind().alias("fragment_kind"), "result_type", "verifier_status")
    sets = [["fragment_kind"], ["result_type"], ["verifier_status"]]
    grouped = labelled.groupingSets(sets, "fragment_kind", "result_type", "verifier_status").agg(
        F.count("*").alias("entries"), F.grouping_id().alias("gid")
    )
    facet = F.when(F.col("gid") == 3, "fragment_kind").when(F.col("gid") == 5, "result_type").otherwise("verifier_status")
    return grouped.select(
        facet.alias("facet"), F.coalesce("fragment_kind", "result_type", "verifier_status").alias("value"), "entries"
    )


def store_modes(entries: DataFrame) -> DataFrame:
    return entries.select(F.explode("reusable_as").alias("mode")).groupBy("mode").agg(F.count("*").alias("entries"))


def call_cost(model: Column, input_tokens: Column, output_tokens: Column) -> Column:
    """Price of a call; unknown model families are free."""
    cost = F.lit(0.0)
    for family, (price_in, price_out) in S.PRICES_PER_1K.items():
        price = input_tokens * F.lit(price_in) / 1000 + output_tokens * F.lit(price_out) / 1000
        cost = F.when(F.contains(F.lower(model), F.lit(family)), price).otherwise(cost)
    return cost


def ledger_by_model(calls: DataFrame) -> DataFrame:
    cost = call_cost(F.col("model"), F.col("input_tokens"), F.col("output_tokens"))
    return calls.groupBy("model").agg(
        F.count("*").alias("calls"),
        F.sum("input_tokens").cast("bigint").alias("input_tokens"),
        F.sum("output_tokens").cast("bigint").alias("output_tokens"),
        F.round(F.sum(cost), 6).alias("cost_usd"),
    )


def accuracy_report(scored: DataFrame, score: str) -> DataFrame:
    """Samples and mean score per length, per task, per both, and overall."""
    sets = [["length"], ["task"], ["task", "length"], []]
    return scored.groupingSets(sets, "task", "length").agg(
        F.grouping_id().cast("bigint").alias("level"),
        F.count("*").alias("samples"),
        F.round(F.avg(score), 6).alias("accuracy"),
    )


def counter_deltas(snapshots: DataFrame, earlier: DataFrame, keys: Sequence[str], counters: Sequence[str]) -> DataFrame:
    """Change of every counter between two snapshots of the same keys."""
    before = earlier.select(*keys, *[F.col(c).alias(f"{c}_before") for c in counters])
    return snapshots.join(before, list(keys), "left").select(
        *keys, *[(F.col(c) - F.coalesce(f"{c}_before", F.lit(0))).alias(f"delta_{c}") for c in counters]
    )


def cost_projection(rows: DataFrame, cost: Column, project_samples: int) -> DataFrame:
    totals = rows.agg(
        F.count("*").alias("samples"), F.sum(cost).alias("cost"), F.sum("latency_ms").alias("latency"),
        count_where(F.col("from_cache")).alias("hits"),
    )
    mean = F.col("cost") / F.col("samples")
    return totals.filter("samples > 0").select(
        "samples",
        F.round("cost", 8).alias("total_cost_usd"),
        F.round(mean, 8).alias("avg_cost_usd_per_sample"),
        F.round(mean * F.lit(max(0, project_samples)), 4).alias("projected_cost_usd"),
        F.round(F.col("latency") / F.col("samples"), 3).alias("avg_latency_ms"),
        ratio(F.col("hits"), F.col("samples")).alias("cache_hit_rate"),
    )


MANIFEST = """
    benchmark STRING, data_kind STRING, corpus_id STRING, model STRING, memo_entries BIGINT,
    settings STRUCT<lengths: ARRAY<BIGINT>, solver_mode: STRING>,
    totals STRUCT<samples: BIGINT, questions: BIGINT, accuracy_contains: DOUBLE, model_calls: BIGINT,
        aggregate_calls: BIGINT, avg_latency_ms: DOUBLE, initial_coverage_ratio: DOUBLE,
        fact_initial_coverage_ratio: DOUBLE, final_coverage_ratio: DOUBLE, fact_final_coverage_ratio: DOUBLE,
        exact_replay_checks: BIGINT, exact_replays: BIGINT, v1_model_calls: BIGINT, invalidated_entries: BIGINT,
        v2_model_calls: BIGINT, v2_initial_coverage_ratio: DOUBLE, v2_reused_windows: BIGINT,
        v2_missing_windows: BIGINT, warm_model_calls: BIGINT>,
    memo_stats STRUCT<entry_count: BIGINT, by_fragment_kind: MAP<STRING, BIGINT>,
        dependency_edge_count: BIGINT, evidence_span_count: BIGINT>
"""


def summarize_manifests(manifests: DataFrame) -> DataFrame:
    """One flat row per manifest; ``manifests`` has ``manifest`` (its path) and ``body``."""
    m = manifests.select("manifest", F.from_json("body", MANIFEST).alias("m"))
    plain = "accuracy_contains model_calls aggregate_calls avg_latency_ms".split()
    replay = (
        "v1_model_calls invalidated_entries v2_model_calls v2_initial_coverage_ratio "
        "v2_reused_windows v2_missing_windows warm_model_calls"
    ).split()
    return m.select(
        "manifest", "m.benchmark", "m.data_kind", "m.corpus_id", "m.model",
        F.col("m.settings.lengths").alias("lengths"), F.col("m.settings.solver_mode").alias("solver_mode"),
        F.coalesce("m.totals.samples", "m.totals.questions").alias("samples"),
        *[F.col(f"m.totals.{name}") for name in plain],
        F.coalesce("m.totals.initial_coverage_ratio", "m.totals.fact_initial_coverage_ratio").alias("initial_coverage_ratio"),
        F.coalesce("m.totals.final_coverage_ratio", "m.totals.fact_final_coverage_ratio").alias("final_coverage_ratio"),
        F.coalesce("m.totals.exact_replay_checks", "m.totals.exact_replays").alias("exact_replay_checks"),
        F.coalesce("m.memo_entries", "m.memo_stats.entry_count").alias("memo_entries"),
        F.coalesce("m.memo_stats.by_fragment_kind", F.create_map().cast("map<string,bigint>")).alias("fragment_mix"),
        F.col("m.memo_stats.dependency_edge_count").alias("dependency_edge_count"),
        F.col("m.memo_stats.evidence_span_count").alias("evidence_span_count"),
        *[F.col(f"m.totals.{name}") for name in replay],
    )


def without_nulls(df: DataFrame) -> DataFrame:
    """Rows as JSON objects that leave out missing values."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "true"}).alias("row"))
