"""Structured Streaming writers.

Every micro-batch replaces the partition of its own batch id, so a batch repeated after a
failure leaves the tables as they were.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from memograph.operators import graph, reports
from memograph.sources.tables import MemoTables


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder, one file or a folder of files, as a file stream; an error if it is not there."""
    path = f"{folder}/{name}.parquet"
    table = spark.read.parquet(path)
    found = table.select("_metadata.file_path").first()
    reader = spark.readStream.schema(table.schema)
    if found and found["file_path"].endswith(f"/{name}.parquet"):
        # Streams read folders, so a table of one file is picked out of its own.
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return reader.parquet(path)


def _start(stream: DataFrame, write, checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )


def ingest_entries(entries: DataFrame, tables: MemoTables, checkpoint: str, name: str = "entries") -> StreamingQuery:
    """Store arriving entries; the version committed last wins."""
    return _start(entries, lambda rows, batch: tables.add_entries(rows, tables.commit("memo_entries", name, batch)), checkpoint)


def ingest_chunks(chunks: DataFrame, tables: MemoTables, checkpoint: str, name: str = "chunks") -> StreamingQuery:
    return _start(chunks, lambda rows, batch: tables.append("context_chunks", rows, tables.commit("context_chunks", name, batch)), checkpoint)


def apply_changes(
    changes: DataFrame, tables: MemoTables, checkpoint: str, reason: str, as_of: str, name: str = "changes"
) -> StreamingQuery:
    """Reject what arriving scope changes make stale, together with everything built on it.

    An entry that is solved and stored again after that is live again.
    """

    def write(changed: DataFrame, batch: int) -> None:
        entries = tables.read("memo_entries")
        stale = graph.invalidated(changed, entries, tables.edges())
        hit = entries.join(stale.select("entry_id"), "entry_id", "left_semi")
        tables.add_entries(graph.reject(hit, stale, reason, as_of), tables.commit("memo_entries", name, batch))

    return _start(changes, write, checkpoint)


def ingest_calls(calls: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep one small ledger row per model and micro-batch."""

    def write(rows: DataFrame, batch: int) -> None:
        cost = reports.call_cost(F.col("model"), F.col("input_tokens"), F.col("output_tokens"))
        sums = rows.groupBy("model").agg(
            F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"),
            F.sum("output_tokens").alias("output_tokens"), F.sum(cost).alias("cost_usd"),
        )
        sums.withColumn("batch", F.lit(batch)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("batch").parquet(path)

    return _start(calls, write, checkpoint)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """Ledger totals over all micro-batches so far."""
    return spark.read.parquet(path).groupBy("model").agg(
        F.sum("calls").alias("calls"), F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"), F.round(F.sum("cost_usd"), 6).alias("cost_usd"),
    )
