"""Solving with answers of equivalent tasks, where each pair of tasks is judged once.

A verifier is dear. What it said about two tasks is stored, so a pair is asked once in the life of a store, whatever
the number of documents, requests and runs in which it comes up.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memograph import schema as S
from memograph.functions import entries as E
from memograph.functions import identity as I
from memograph.plans import solve
from memograph.plans.aggregate import Aggregate
from memograph.sources.batches import Batches

PAIR = ["task_signature", "stored_signature"]
VERDICTS = "task_signature STRING, stored_signature STRING, reuse_as STRING, confidence STRING, reason STRING"
ACCEPTED = ("exact", "exact_answer", "replay")


class Verdicts:
    """What a verifier said about pairs of tasks (asked, stored); of a pair judged twice the earlier verdict counts."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.batches = Batches(spark, path, {"verdicts": VERDICTS})

    def known(self) -> DataFrame:
        first = F.min(F.struct("seq", "reuse_as", "confidence", "reason")).alias("v")
        return self.batches.read("verdicts").groupBy(*PAIR).agg(first).select(*PAIR, "v.reuse_as", "v.confidence", "v.reason")

    def judge(self, pairs: DataFrame, verifier: solve.Verifier, batch: str) -> int:
        """Ask about the pairs not judged yet and store the answers under ``batch``; how many were asked.

        The verifier gets ``prompt`` and ``stored_prompt`` of each pair and adds ``reuse_as`` and, if it likes, ``confidence``
        and ``reason``.
        """
        once = pairs.groupBy(*PAIR).agg(F.min("prompt").alias("prompt"), F.min("stored_prompt").alias("stored_prompt"))
        asked = once.join(self.known().select(*PAIR), PAIR, "left_anti").checkpoint()
        if asked.isEmpty() or self.batches.has(batch):
            return 0
        said = verifier(asked)
        extra = [F.col(c).cast("string").alias(c) if c in said.columns else F.lit(None).cast("string").alias(c) for c in ("confidence", "reason")]
        commit = self.batches.begin()
        self.batches.write(commit, "verdicts", said.select(*PAIR, F.lower("reuse_as").alias("reuse_as"), *extra))
        self.batches.publish(commit, batch)
        return self.batches.written(commit, "verdicts").count()


@dataclass
class VerifiedSolution:
    """Requests answered by an equivalent task, the solution of the others, and how many pairs the verifier was asked about."""

    adopted: DataFrame
    rest: solve.Solution
    report: DataFrame
    calls: int


def solve_verified(
    requests: DataFrame, entries: DataFrame, size: int, solver: solve.Solver, created_at: str, verifier: solve.Verifier, verdicts: Verdicts,
    batch: str, aggregate: Aggregate | None = None,
) -> VerifiedSolution:
    """Answer requests by replay, else by an equivalent task's exact answer for the same scope, else by windows.

    ``adopted`` are the entries to store for the second kind: the stored result and evidence under the asked task, resting on
    the entry they came from. Of several accepted entries the smallest id counts. A repeated batch asks nothing.
    """
    keys = [*S.SCOPE_KEYS, "start", "end"]
    plan = solve.first_plan(requests, entries)
    plan.pending = pending = plan.pending.checkpoint()
    wanted = pending.select("request_id", "prompt", "task_signature", "content_hash", *keys)
    pairs = wanted.join(solve.reworded_candidates(pending, entries), keys).filter(
        (F.col("task_signature") != F.col("stored_signature")) & E.compatible_hash(F.col("content_hash"), F.col("stored_hash"))
    ).checkpoint()
    calls = verdicts.judge(pairs, verifier, batch)
    said = verdicts.known().filter(F.col("reuse_as").isin(*ACCEPTED)).withColumnRenamed("confidence", "stated")
    confidence = F.when(F.col("stated").isNull(), F.col("confidence")).otherwise(E.coerce_confidence(F.col("stated")))
    hit = F.min(F.struct("entry_id", "stored_prompt", "result", confidence.alias("confidence"), "reason"))
    accepted = pairs.join(said, PAIR).groupBy("request_id").agg(hit.alias("hit")).select(
        "request_id", F.col("hit.entry_id").alias("source_entry_id"), "hit.stored_prompt", "hit.result", "hit.confidence", "hit.reason"
    ).checkpoint()
    evidence = entries.select(F.col("entry_id").alias("source_entry_id"), "evidence")
    note = I.json_object(
        derived_from=I.json_string(F.lit("semantic_reuse_verifier")), source_entry_id=I.json_string(F.col("source_entry_id")),
        source_prompt=I.json_string(F.col("stored_prompt")), verifier_reason=I.json_string(F.col("reason")),
    )
    adopted = solve.as_entries(
        pending.join(accepted, "request_id").join(evidence, "source_entry_id", "left").withColumns(
            {
                "not_found": F.lit(False), "reusable_as": F.array(F.lit(S.EXACT_ANSWER)), "dependencies": F.array("source_entry_id"),
                "evidence": F.coalesce("evidence", F.array().cast(S.EVIDENCE)), "metadata_json": note,
            }
        ),
        created_at,
    )
    done = accepted.select("request_id")
    # Replays are known, and of the adopted requests alone it is asked how much of them was covered.
    others = solve.plan_reuse(requests.join(done, "request_id", "left_anti"), entries)
    others.exact, others.pending = plan.exact, pending.join(done, "request_id", "left_anti").checkpoint()
    rest = solve.solve_windows(others.requests, entries, size, solver, created_at, aggregate, others)
    length = F.col("covered_length") + F.col("missing_length")
    taken = solve.plan_reuse(pending.join(done, "request_id", "left_semi"), entries)
    taken.pending = taken.requests
    held = taken.coverage.join(accepted, "request_id").select(
        "request_id", F.lit("semantic_exact").alias("memo_type"), *[F.lit(0).cast("bigint").alias(c) for c in ("windows", "reused_windows", "missing_windows")],
        F.round(F.coalesce(F.try_divide("covered_length", length), F.lit(1.0)), 6).alias("initial_ratio"), F.lit(1.0).alias("final_ratio"),
        F.col("result").alias("answer"),
    )
    return VerifiedSolution(adopted, rest, rest.report.unionByName(held), calls)
