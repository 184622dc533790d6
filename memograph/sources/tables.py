"""Memo tables on plain Parquet.

Writes append one partition per batch; reading a table keeps the newest row of each
key. Repeating a batch replaces exactly its own partition, so a retried job or a
restarted stream never counts twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memograph import schema as S

KEYS = {
    "memo_entries": ["entry_id"],
    "memo_edges": ["parent_entry_id", "child_entry_id", "edge_type"],
    "context_chunks": ["corpus_id", "document_id", "unit", "content_hash", "chunk_index"],
}
SCHEMAS = {
    "memo_entries": S.MEMO_ENTRIES,
    "memo_edges": S.MEMO_EDGES,
    "context_chunks": S.CONTEXT_CHUNKS,
}


def _missing(error: AnalysisException) -> bool:
    """Whether a read failed for want of the path; anything else is no empty table."""
    return error.getCondition() == "PATH_NOT_FOUND"


def newest(df: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """The row with the highest version per key; older ones are dropped before the shuffle.

    Of several rows of one version that with the greatest content hash counts, whatever the order of rows.
    """
    window = W.partitionBy(*keys).orderBy(F.desc(version), F.desc(F.xxhash64(*df.columns)))
    return df.withColumn("age", F.row_number().over(window)).filter("age = 1").drop("age")


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``existing`` with ``incoming`` rows replacing those of equal key."""
    both = existing.withColumn("batch", F.lit(0)).unionByName(incoming.withColumn("batch", F.lit(1)))
    return newest(both, keys, "batch").drop("batch")


def dependency_edges(entries: DataFrame, edges: DataFrame, incoming: DataFrame) -> DataFrame:
    """Edges after an entry upsert: dependency edges of the incoming parents are rewritten."""
    from memograph.operators.graph import depends_on

    touched = incoming.select(F.col("entry_id").alias("parent_entry_id")).distinct()
    stale = edges.filter("edge_type = 'depends_on'").join(touched, "parent_entry_id", "left_semi")
    kept = edges.join(stale, KEYS["memo_edges"], "left_anti")
    return kept.unionByName(depends_on(incoming))


class MemoTables:
    """The persisted entries, edges and chunks of one corpus folder."""

    def __init__(self, spark: SparkSession, path: str, corpus_id: str | None = None) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        if corpus_id is not None:
            self._check_corpus(corpus_id)

    def _check_corpus(self, corpus_id: str) -> None:
        """Refuse a folder that belongs to another corpus; claim an empty one."""
        where = f"{self.path}/corpus_config"
        try:
            stored = self.spark.read.schema("corpus_id STRING").json(where).first()
        except AnalysisException as error:
            if not _missing(error):
                raise
            stored = None
        if stored is None:
            self.spark.createDataFrame([(corpus_id,)], "corpus_id STRING").coalesce(1).write.mode(
                "overwrite"
            ).json(where)
        elif stored["corpus_id"] != corpus_id:
            raise ValueError(f"{self.path} holds corpus {stored['corpus_id']!r}, not {corpus_id!r}")

    def commit(self, table: str, writer: str, batch: int) -> int:
        """The table's commit number of a writer's batch: the next one, or for a repeated batch the one it has.

        All writers of a table share one sequence, so the version written last wins whoever wrote it. One process writes
        a table at a time.
        """
        where, fields = f"{self.path}/commits/{table}", "writer STRING, writer_batch BIGINT, batch BIGINT"
        try:
            known = self.spark.read.schema(fields).parquet(where)
            mine = F.max(F.when((F.col("writer") == writer) & (F.col("writer_batch") == batch), F.col("batch")))
            own, last = known.agg(mine, F.max("batch")).first()
        except AnalysisException as error:
            if not _missing(error):
                raise
            own = last = None
        if own is not None:
            return own
        number = 1 + max(-1 if last is None else last, self.history(table).agg(F.max("batch")).first()[0] or 0)
        self.spark.createDataFrame([(writer, batch, number)], fields).coalesce(1).write.mode("append").parquet(where)
        return number

    def append(self, table: str, rows: DataFrame, batch: int) -> None:
        (
            rows.select(*S.column_names(SCHEMAS[table]))
            .withColumn("batch", F.lit(batch).cast("bigint"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch")
            .parquet(f"{self.path}/{table}")
        )

    def history(self, table: str) -> DataFrame:
        schema = f"{SCHEMAS[table]}, batch BIGINT"
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{table}")
        except AnalysisException as error:
            if not _missing(error):
                raise
            return self.spark.createDataFrame([], schema)

    def read(self, table: str) -> DataFrame:
        return newest(self.history(table), KEYS[table], "batch").drop("batch")

    def add_entries(self, entries: DataFrame, batch: int) -> None:
        """Store entries; the newest version of an id wins, also over an earlier rejection."""
        self.append("memo_entries", entries, batch)

    def edges(self) -> DataFrame:
        """Explicit edges plus those implied by the current dependency lists."""
        from memograph.operators.graph import depends_on

        implied = depends_on(self.read("memo_entries"))
        return newest(
            self.read("memo_edges").withColumn("source", F.lit(0)).unionByName(implied.withColumn("source", F.lit(1))),
            KEYS["memo_edges"],
            "source",
        ).drop("source")

    def compact(self, table: str, target: str) -> None:
        """Write the current rows of a table, laid out for scope lookups, to another folder."""
        order = ["document_id", "unit", "scope_start"] if table == "memo_entries" else KEYS[table]
        current = self.read(table).withColumn("batch", F.lit(0).cast("bigint"))
        current.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").partitionBy(
            "batch"
        ).parquet(f"{target}/{table}")
