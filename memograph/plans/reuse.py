"""Reuse planning for many requests at once.

Stored entries are first condensed to one row per task and exact scope: the best entry
that may be reused there, and counts of the others. Whether an entry is a candidate
depends on nothing else, so copies collapse before they meet the requests.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memograph import schema as S
from memograph.functions import entries as E
from memograph.operators import matching, spans
from memograph.operators.reports import count_where

TASK_SCOPE = [*S.SCOPE_KEYS, "task_signature"]
KINDS = ["ruled_out_region", "search_hint", "supporting_fact", "aggregation_component", "exact_answer"]


def condensed(entries: DataFrame, payload: Sequence[str] = ()) -> DataFrame:
    """Live entries per task and exact scope.

    ``best`` is the entry to reuse: exact answers first, then more dependencies, then higher
    confidence, then the smaller id. Negatives and hints are only counted. Spans are counted
    by one of their small fields, so that evidence texts are never read.
    """
    negative, covers, hint = E.is_negative(), E.can_cover(), E.offers(S.SEARCH_HINT)
    best = F.struct(
        (~E.offers(S.EXACT_ANSWER)).alias("not_exact"),
        (-F.size("dependencies")).alias("fewer_dependencies"),
        (-F.col("confidence")).alias("less_confidence"),
        "entry_id",
        E.fragment_kind().alias("kind"),
        F.size("evidence.start").alias("evidence_spans"),
        *payload,
    )
    return (
        entries.filter(~E.is_rejected())
        .groupBy(*TASK_SCOPE, "scope_start", "scope_end", "content_hash")
        .agg(
            F.min(F.when(~negative & covers, best)).alias("best"),
            F.max(covers).alias("covers"),
            count_where(negative).alias("negatives"),
            count_where(negative & covers).alias("covering_negatives"),
            count_where(hint).alias("hints"),
            count_where(hint & negative).alias("negative_hints"),
            F.sum(F.when(negative, F.size("evidence.start")).otherwise(0) + F.when(hint, F.size("evidence.start")).otherwise(0)).alias("other_evidence"),
            F.sum(F.when(negative, F.size("dependencies")).otherwise(0) + F.when(hint, F.size("dependencies")).otherwise(0)).alias("other_dependencies"),
        )
    )


@dataclass
class ReusePlan:
    """What is known about every request; each part is a DataFrame keyed by ``request_id``."""

    requests: DataFrame
    entries: DataFrame
    payload: Sequence[str] = ()
    exact_among: DataFrame | None = None  # where a replay can come from, if not any entry

    @cached_property
    def exact(self) -> DataFrame:
        known = self.entries if self.exact_among is None else self.exact_among
        return matching.exact_replays(self.requests, known)

    @cached_property
    def pending(self) -> DataFrame:
        """Requests that cannot be replayed as a whole."""
        return self.requests.join(self.exact, "request_id", "left_anti")

    @cached_property
    def matches(self) -> DataFrame:
        """Pending requests with the condensed entries they overlap."""
        wanted = self.pending.select("request_id", *TASK_SCOPE, "start", "end", "content_hash")
        return matching.clipped(matching.overlapping(wanted, condensed(self.entries, self.payload), TASK_SCOPE))

    @cached_property
    def runs(self) -> DataFrame:
        """Covered and missing stretches that tile each pending request."""
        held = self.matches.filter("covers").select(
            "request_id", F.col("clip_start").alias("start"), F.col("clip_end").alias("end")
        )
        return spans.coverage_runs(held, ["request_id"], self.pending.select("request_id", "start", "end"))

    @property
    def covered(self) -> DataFrame:
        """Merged covered intervals; a replayed request is covered as a whole."""
        whole = self.requests.join(self.exact, "request_id", "left_semi").filter("end > start")
        return self.runs.filter("covered").drop("covered").unionByName(whole.select("request_id", "start", "end"))

    @property
    def missing(self) -> DataFrame:
        return self.runs.filter("NOT covered").drop("covered")

    @property
    def reusable(self) -> DataFrame:
        """The entry to reuse for each scope a pending request overlaps."""
        return self.matches.filter("best IS NOT NULL").select(
            "request_id", "scope_start", "scope_end", "stored_hash", "best.entry_id", "best.kind",
            *[f"best.{name}" for name in self.payload],
        )

    def _role(self, test) -> DataFrame:
        found = matching.candidates(self.pending, self.entries.filter(test).withColumn("kind", E.fragment_kind()), ["kind"])
        return found.select("request_id", "scope_start", "scope_end", "stored_hash", "entry_id", "kind")

    @property
    def negatives(self) -> DataFrame:
        return self._role(E.is_negative())

    @property
    def hints(self) -> DataFrame:
        return self._role(E.offers(S.SEARCH_HINT))

    @cached_property
    def coverage(self) -> DataFrame:
        """Lengths and interval counts of pending requests."""
        length = F.col("end") - F.col("start")
        return self.runs.groupBy("request_id").agg(
            F.sum(F.when(F.col("covered"), length).otherwise(0)).alias("covered_length"),
            F.sum(F.when(F.col("covered"), 0).otherwise(length)).alias("missing_length"),
            count_where(F.col("covered")).alias("covered_intervals"),
            count_where(~F.col("covered")).alias("missing_scopes"),
        )

    @cached_property
    def telemetry(self) -> DataFrame:
        """One row per request with everything the planner reports about it."""
        kind = F.col("best.kind")
        chosen = F.col("best").isNotNull()
        by_kind = {
            "ruled_out_region": F.col("negatives") + F.col("negative_hints"),
            "search_hint": F.col("hints") - F.col("negative_hints") + F.when(kind == S.SEARCH_HINT, 1).otherwise(0),
        }
        covering = {"ruled_out_region": F.col("covering_negatives")}
        counts = self.matches.groupBy("request_id").agg(
            count_where(chosen).alias("reusable"),
            F.sum("negatives").alias("negative"),
            F.sum("hints").alias("hint"),
            F.sum(F.col("other_evidence") + F.coalesce("best.evidence_spans", F.lit(0))).alias("evidence_spans"),
            F.sum(F.col("other_dependencies") - F.coalesce("best.fewer_dependencies", F.lit(0))).alias("dependency_edges"),
            *[
                F.sum(by_kind.get(name, F.when(kind == name, 1).otherwise(0))).alias(f"kind_{name}")
                for name in KINDS
            ],
            *[
                F.sum(covering.get(name, F.when(kind == name, 1).otherwise(0))).alias(f"covering_{name}")
                for name in KINDS
            ],
        )
        own = self.entries.select(
            F.col("entry_id").alias("exact_entry_id"),
            E.fragment_kind().alias("exact_kind"),
            F.size("evidence.start").alias("exact_evidence"),
            F.size("dependencies").alias("exact_dependencies"),
        )
        exact = self.exact.join(own, "exact_entry_id")
        replayed = F.col("exact_entry_id").isNotNull()
        length = F.col("end") - F.col("start")
        covered = F.when(replayed, length).otherwise(F.coalesce("covered_length", F.lit(0)))
        missing = F.when(replayed, F.lit(0)).otherwise(F.coalesce("missing_length", F.lit(0)))
        share = F.when(length <= 0, F.lit(1.0)).otherwise(covered / F.nullif(length, F.lit(0)))

        def count(name: str, when_exact) -> object:
            return F.when(replayed, when_exact).otherwise(F.coalesce(name, F.lit(0))).cast("bigint").alias(name)

        own_kind = {name: F.when(F.col("exact_kind") == name, 1).otherwise(0) for name in KINDS}
        return (
            self.requests.select("request_id", "task_signature", "document_id", "start", "end")
            .join(exact, "request_id", "left")
            .join(self.coverage, "request_id", "left")
            .join(counts, "request_id", "left")
            .select(
                "request_id", "task_signature", "document_id", "start", "end",
                length.alias("scope_length"),
                replayed.alias("has_exact_replay"),
                (missing == 0).alias("is_complete"),
                F.round(share, 6).alias("coverage_ratio"),
                covered.cast("bigint").alias("covered_length"),
                missing.cast("bigint").alias("missing_length"),
                count("covered_intervals", F.when(length > 0, 1).otherwise(0)),
                count("missing_scopes", F.lit(0)),
                "exact_entry_id",
                count("reusable", F.lit(1)),
                count("negative", F.lit(0)),
                count("hint", F.lit(0)),
                count("evidence_spans", F.col("exact_evidence")),
                count("dependency_edges", F.col("exact_dependencies")),
                *[count(f"kind_{name}", own_kind[name]) for name in KINDS],
                *[count(f"covering_{name}", own_kind[name]) for name in KINDS],
            )
        )


def plan_reuse(requests: DataFrame, entries: DataFrame, payload: Sequence[str] = ()) -> ReusePlan:
    return ReusePlan(requests, entries, payload)
