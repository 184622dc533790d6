"""Helpers that the operators share: stored intermediate tables, folds of labels, lookups with a bounded memory."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memograph.session import ensure_checkpointing, shared_dir

#: What separates words: the space and the five control characters from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
FOLDS = 5


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows read from a Parquet table in the shared folder: computed once, safe from lost executors."""
    path = f"{shared_dir(df.sparkSession)}/memograph-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, column: str, name: str) -> DataFrame:
    """Stored rows with a gapless number from 0 in ``column``, in no stated order.

    Spark's row numbers count within a partition; one row per partition is added up to close the gaps.
    """
    place = F.monotonically_increasing_id()
    kept = stored(df.select(F.struct("*").alias("row"), F.spark_partition_id().alias("part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("pos")), name)
    sizes = kept.groupBy("part").agg(F.count("*").alias("own"))
    shifts = sizes.select("part", (F.sum("own").over(Window.orderBy("part")) - F.col("own")).alias("shift"))
    return kept.join(F.broadcast(shifts), "part").select("row.*", (F.col("pos") + F.col("shift")).alias(column))


def checkpointed(df: DataFrame) -> DataFrame:
    ensure_checkpointing(df.sparkSession)
    return df.checkpoint()


def fold(doc_id: str | Column) -> Column:
    """Remainder of the id's checksum; null ids belong to no fold."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string").cast("binary")) % FOLDS


def held_out(doc_id: str | Column) -> Column:
    return F.coalesce(fold(doc_id) == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, most: int) -> DataFrame:
    """doc_id, label and text of at most ``most`` labelled documents outside the evaluation fold.

    The ids are drawn by their hash from the labels, so their number is bounded before they are sent to the texts.
    Of several labels of an id the largest counts, of several texts the largest; null labels and texts don't.
    """
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("label"))
    drawn = marked.dropna().filter(fold("doc_id") != 0).groupBy("doc_id").agg(F.max("label").alias("label"))
    drawn = drawn.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "label").agg(F.max("text").alias("text")).dropna()


def text_slices(texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive rows holding about ``limit`` bytes of text."""
    start = size = 0
    for i, n in enumerate(pa.compute.binary_length(texts).to_pylist()):
        size += n or 0
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones themselves, others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Known(dict):
    """Answers of a function by argument; the first ``size`` arguments are remembered, frequent ones come early."""

    def __init__(self, function: Callable, size: int):
        super().__init__()
        self.function, self.size = function, size

    def __missing__(self, key):
        value = self.function(key)
        if len(self) < self.size:
            self[key] = value
        return value
