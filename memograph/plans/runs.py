"""Benchmark runs: all samples of a run are solved, scored and accounted in one batch.

A warm run is the same call over the entries a cold run left behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memograph.functions import identity as I
from memograph.functions import scoring
from memograph.functions import text as T
from memograph.plans import solve

TASK_TYPE = "memoized_document_qa"
CONTRACT = "supported_answer"


def sample_requests(samples: DataFrame, corpus_id: str, chunk_words: int, window: int) -> DataFrame:
    """One request per sample over its chunked context.

    ``samples`` has ``sample_id`` (a number), ``question``, ``context``, ``document_id`` and
    ``content_hash``; the window size is part of the task.
    """
    chunks = F.ceil(F.greatest(F.size(T.words("context")), F.lit(1)) / chunk_words).cast("bigint")
    named = samples.select(
        F.col("sample_id").alias("request_id"), F.col("question").alias("prompt"), F.lit(TASK_TYPE).alias("task_type"),
        F.lit(CONTRACT).alias("output_contract"), F.lit(f'{{"chunk_size":{window}}}').alias("constraints_json"),
        F.lit(corpus_id).alias("corpus_id"), "document_id", F.lit(0).cast("bigint").alias("start"), chunks.alias("end"),
        F.lit("chunk").alias("unit"), "content_hash",
    )
    task = I.task_signature(*[F.col(c) for c in ("prompt", "task_type", "output_contract", "constraints_json")])
    return named.withColumn("task_signature", task)


def run_samples(
    samples: DataFrame, entries: DataFrame, solver: solve.Solver, corpus_id: str, chunk_words: int, window: int,
    created_at: str, metric: str = "contains",
) -> tuple[DataFrame, DataFrame]:
    """Scored rows of a run, and the entries to store for the next one.

    ``samples`` also has ``task``, ``length`` and ``gold``.
    """
    done = solve.solve_windows(sample_requests(samples, corpus_id, chunk_words, window), entries, window, solver, created_at)
    score = scoring.METRICS[metric](F.col("answer"), F.col("gold"))
    rows = (
        done.report.withColumnRenamed("request_id", "sample_id")
        .join(samples.select("sample_id", "task", "length", "gold"), "sample_id")
        .select(
            "sample_id", "task", "length", F.col("answer").alias("prediction"),
            F.col("missing_windows").alias("delta_calls"), (F.col("missing_windows") == 0).alias("from_cache"),
            F.col("memo_type").alias("cache_type"), "initial_ratio", score.alias("is_correct"),
        )
    )
    return rows, done.solved.unionByName(done.composites())
