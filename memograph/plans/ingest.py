"""Ingest of a folder of texts: compare with the stored corpus, cut, embed and store what changed, invalidate what it held up.

A batch is compared with the newest stored version of every file by content hash. Only windows of added and changed files
are cut and embedded; they are stored with the versions of the files in one commit, so readers see both or neither.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memograph import schema as S
from memograph.functions.embedding import hashed_embedding
from memograph.functions.text import char_windows
from memograph.operators import graph
from memograph.session import ensure_checkpointing
from memograph.sources.batches import Batches

ADDED, CHANGED, REMOVED, SAME = "added", "changed", "removed", "same"
SCHEMAS = {
    "files": "filename STRING, content_hash STRING, total_chars BIGINT, windows INT, state STRING",
    "windows": "filename STRING, char_start BIGINT, text STRING, embedding ARRAY<FLOAT>",
}


class Corpus:
    """Versions of files and the windows of each version; the newest version of a file counts."""

    def __init__(self, spark: SparkSession, path: str, embed: Callable[[Column], Column] = hashed_embedding) -> None:
        self.spark, self.embed = spark, embed
        self.batches = Batches(spark, path, SCHEMAS)

    def _newest(self) -> DataFrame:
        newest = self.batches.read("files").groupBy("filename").agg(F.max_by(F.struct("*"), "seq").alias("file"))
        return newest.select("file.*").filter(F.col("state") != REMOVED)

    def files(self) -> DataFrame:
        """``filename, content_hash, total_chars, windows`` of the files that are there now."""
        return self._newest().select("filename", "content_hash", "total_chars", "windows")

    def windows(self) -> DataFrame:
        """``filename, char_start, text, embedding`` of the files that are there now; earlier versions stay unread."""
        current = self._newest().select("filename", "commit")
        return self.batches.read("windows").drop("seq").join(current, ["filename", "commit"], "left_semi").drop("commit")


def compared(found: DataFrame, corpus: Corpus, whole: bool = True) -> DataFrame:
    """Per file: state (added, changed, removed or same), its text and hash as found, and the hash that was stored.

    ``found`` has ``filename, text, content_hash, total_chars``. Files that are not found count as removed if ``found`` is the
    ``whole`` corpus, else they stay as they are. Of several rows of one name the one of the smallest hash counts; rows
    without a name or a hash take no part.
    """
    once = found.filter("filename IS NOT NULL AND content_hash IS NOT NULL").groupBy("filename").agg(
        F.min_by(F.struct(F.coalesce("text", F.lit("")).alias("text"), "content_hash", "total_chars"), "content_hash").alias("file")
    )
    stored = corpus.files().select("filename", F.col("content_hash").alias("stored_hash"), F.col("total_chars").alias("stored_chars"))
    both = once.select("filename", "file.*").join(stored, "filename", "full" if whole else "left")
    state = (
        F.when(F.col("stored_hash").isNull(), ADDED).when(F.col("content_hash").isNull(), REMOVED)
        .when(F.col("content_hash") != F.col("stored_hash"), CHANGED).otherwise(SAME)
    )
    return both.withColumn("state", state)


def ingest(found: DataFrame, corpus: Corpus, batch: str, whole: bool = True) -> DataFrame:
    """Bring the corpus up to date. Per file: filename, state, windows, embedded, stored_hash, stored_chars; checkpointed.

    ``windows`` counts the windows of the file as it is now, ``embedded`` those that were made for it by this batch. A
    file whose text is too short for a window is kept as a file of no windows. Under the name of a batch
    that is stored already nothing is stored again; files that differ from it are reported, and wait for a batch of a new name.
    """
    ensure_checkpointing(corpus.spark)
    known = corpus.files().select("filename", F.col("windows").alias("known"))
    judged = compared(found, corpus, whole).withColumn(
        "pieces", F.when(F.col("state").isin(ADDED, CHANGED), F.coalesce(char_windows(F.col("text")), F.array()))
    ).withColumn("made", F.when(F.col("pieces").isNotNull(), F.size("pieces")).otherwise(0)).drop("text").checkpoint()
    if not corpus.batches.has(batch):
        moved = judged.filter(F.col("state") != SAME)
        versions = moved.select(
            "filename", F.coalesce("content_hash", "stored_hash").alias("content_hash"),
            F.coalesce("total_chars", "stored_chars").alias("total_chars"), F.col("made").alias("windows"), "state",
        )
        pieces = moved.select("filename", F.inline("pieces")).withColumn("embedding", corpus.embed(F.col("text")).cast("array<float>"))
        commit = corpus.batches.begin()
        corpus.batches.write(commit, "windows", pieces)
        corpus.batches.write(commit, "files", versions)
        corpus.batches.publish(commit, batch)
    windows = F.when(F.col("state") == SAME, F.col("known")).otherwise(F.col("made"))
    return judged.join(known, "filename", "left").select(
        "filename", "state", windows.alias("windows"), F.col("made").alias("embedded"), "stored_hash", "stored_chars"
    ).checkpoint()


def changed_scopes(report: DataFrame, corpus_id: str, unit: str = "char") -> DataFrame:
    """The whole of every changed or removed file, as the scopes that entries were stored for, with the hash of then."""
    gone = report.filter(F.col("state").isin(CHANGED, REMOVED))
    return gone.select(
        F.col("filename").alias("request_id"), F.lit(corpus_id).alias("corpus_id"), F.col("filename").alias("document_id"),
        F.lit(unit).alias("unit"), F.lit(0).cast("bigint").alias("start"), F.greatest("stored_chars", F.lit(1)).cast("bigint").alias("end"),
        F.col("stored_hash").alias("content_hash"),
    )


def stale_entries(report: DataFrame, entries: DataFrame, edges: DataFrame, corpus_id: str, unit: str = "char") -> DataFrame:
    """``entry_id, depth`` of live entries on changed or removed files, and of all that is built on them."""
    return graph.invalidated(changed_scopes(report, corpus_id, unit), entries, edges)


def marked_stale(stale: DataFrame, entries: DataFrame, as_of: str) -> DataFrame:
    """The stale entries as rejected rows, to be stored like any other entries."""
    hit = entries.join(stale.select("entry_id"), "entry_id", "left_semi")
    return graph.reject(hit, stale, "source changed", as_of).select(*S.column_names(S.MEMO_ENTRIES))
