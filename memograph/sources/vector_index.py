"""A stored vector index: inverted lists around coarse centroids, exact top-k by skipping lists.

Every vector lies in the list of its nearest centroid, and every list knows how far its members lie from the centroid.
By Cauchy-Schwarz no member x of a list can score above ``q . c + |q| * radius`` with a query q, so once k scores are
known, lists whose bound stays below the k-th are never read. Lists are folders, so skipping one skips its files.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memograph.operators.ranking import QUERIES_PER_BLOCK, VECTORS_PER_BLOCK, top_k
from memograph.session import ensure_checkpointing
from memograph.sources.batches import Batches

#: Largest number of lists, and the rows per list that centroids are fitted on.
MOST_LISTS, SAMPLE_PER_LIST = 4096, 64
#: Scores are rounded to six digits; a list is skipped only if it cannot reach the k-th score by this much.
ROUNDING = 2e-6
SCHEMAS = {
    "centroids": "list INT, centroid ARRAY<DOUBLE>",
    "vectors": "vec_id BIGINT, vec ARRAY<DOUBLE>, gap DOUBLE, list INT",
    "lists": "list INT, rows BIGINT, radius DOUBLE",
}


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


@dataclass
class Lists:
    """What the driver and every task know of the lists: at most ``MOST_LISTS`` centroids with rows and radius."""

    numbers: np.ndarray
    centroids: np.ndarray
    rows: np.ndarray
    radius: np.ndarray

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Per query and list, a score that no member exceeds."""
        length = np.sqrt((queries * queries).sum(axis=1))[:, None]
        return queries @ self.centroids.T + length * (self.radius * (1 + 1e-9))[None] + 1e-9 * (1 + length)

    def first(self, bounds: np.ndarray, k: int) -> np.ndarray:
        """Per query, the lists of the highest bounds that together hold k rows."""
        order = np.argsort(-bounds, axis=1, kind="stable")
        before = np.cumsum(self.rows[order], axis=1) - self.rows[order]
        chosen = np.zeros(bounds.shape, dtype=bool)
        np.put_along_axis(chosen, order, before < k, axis=1)
        return chosen


@dataclass
class Search:
    """Hits (query id, vector id, score, rank) and the numbers of the lists that were read for them."""

    hits: DataFrame
    lists: set[int]


class VectorIndex:
    """Vectors by id in a folder. Batches are appended and never rewritten; centroids stay those of the first batch with rows.

    Rows without an id or a vector, and vectors that hold nulls or non-finite numbers, take no part. All vectors and queries
    must be of one width. A repeated batch changes nothing; a repeated id is a row of its own.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.batches = Batches(spark, path, SCHEMAS)

    @staticmethod
    def _usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
        finite = F.forall("vec", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
        named = rows.select(F.col(key).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("vec"))
        return named.dropna().filter(finite & (F.size("vec") > 0))

    def _same_width(self, rows: DataFrame, width: int | None) -> int | None:
        """The one width of all vectors; anything else is an error, not a wrong product."""
        found = {r["width"] for r in rows.select(F.size("vec").alias("width")).distinct().limit(2).collect()}
        if width is not None:
            found.add(width)
        if len(found) > 1:
            raise ValueError(f"vectors of different widths: {sorted(found)}")
        return found.pop() if found else None

    def _centroids(self) -> np.ndarray:
        rows = sorted((r["list"], r["centroid"]) for r in self.batches.read("centroids").collect())
        return np.array([c for _, c in rows])

    def _fitted(self, rows: DataFrame) -> np.ndarray:
        count = rows.count()
        lists = min(MOST_LISTS, max(2, round(count**0.5)))
        sample = rows.orderBy(F.xxhash64("vec"), "vec_id").limit(lists * SAMPLE_PER_LIST).select("vec").distinct().checkpoint()
        lists = min(lists, sample.count())
        if lists < 2:
            return np.array([r["vec"] for r in sample.collect()])
        # Started from different points, as fewer of them than asked for is an error of the library.
        model = KMeans(k=lists, seed=7, maxIter=5, initMode="random").fit(sample.select(array_to_vector("vec").alias("features")))
        return np.array(model.clusterCenters())

    def add(self, vectors: DataFrame, batch: str, key: str = "vec_id", vector: str = "embedding") -> None:
        """Append a batch under its name; its files are new ones."""
        if self.batches.has(batch):
            return
        ensure_checkpointing(self.spark)
        rows = self._usable(vectors, key, vector).checkpoint()
        centroids = self._centroids()
        width = self._same_width(rows, centroids.shape[1] if len(centroids) else None)
        commit, fresh = self.batches.begin(), []
        if not len(centroids) and width:
            centroids = self._fitted(rows)
            fresh = [(i, c.tolist()) for i, c in enumerate(centroids)]
        self.batches.write(commit, "centroids", self.spark.createDataFrame(fresh, SCHEMAS["centroids"]))
        known = self.spark.sparkContext.broadcast(centroids)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, len(batch), 1024):
                    part = batch.slice(start, 1024)
                    own = matrix(part.column("vec"))
                    centres = known.value
                    at = ((centres * centres).sum(axis=1)[None] - 2 * own @ centres.T).argmin(axis=1)
                    gap = np.sqrt(((own - centres[at]) ** 2).sum(axis=1))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(gap), pa.array(at.astype(np.int32))], ["vec_id", "vec", "gap", "list"])

        # Rows of a list come together, but a list of many rows is still dealt to several tasks.
        placed = rows.mapInArrow(place, SCHEMAS["vectors"]).hint("rebalance", "list")
        self.batches.write(commit, "vectors", placed, ["list"])
        sizes = self.spark.createDataFrame([], SCHEMAS["lists"])
        if width:
            kept = self.batches.written(commit, "vectors")
            sizes = kept.groupBy("list").agg(F.count("*").alias("rows"), F.max("gap").alias("radius"))
        self.batches.write(commit, "lists", sizes)
        self.batches.publish(commit, batch)

    @property
    def total(self) -> int:
        return self.batches.read("lists").agg(F.sum("rows")).first()[0] or 0

    def vectors(self) -> DataFrame:
        return self.batches.read("vectors").select("vec_id", F.col("vec").alias("embedding"), "list")

    def _lists(self) -> Lists:
        sizes = self.batches.read("lists").groupBy("list").agg(F.sum("rows").alias("rows"), F.max("radius").alias("radius"))
        rows = sorted((r["list"], r["rows"], r["radius"]) for r in sizes.collect())
        numbers = np.array([n for n, *_ in rows], dtype=np.int64)
        centroids = self._centroids()
        return Lists(numbers, centroids[numbers] if len(numbers) else centroids, *(np.array([r[i] for r in rows]) for i in (1, 2)))

    def search(self, queries: DataFrame, k: int, query_id: str = "query_id", vector: str = "embedding") -> Search:
        """Exact top-k by inner product, ties to the smaller id; queries with fewer than k vectors get all of them."""
        ensure_checkpointing(self.spark)
        known = self._lists()
        asked = self._usable(queries, query_id, vector).withColumnsRenamed({"vec_id": "q"}).checkpoint()
        if not len(known.numbers) or asked.isEmpty():
            return Search(self.spark.createDataFrame([], f"{query_id} BIGINT, vec_id BIGINT, score DOUBLE, rank INT"), set())
        self._same_width(asked, known.centroids.shape[1])
        start = self._scored(self._sent(asked.withColumn("bound", F.lit(None).cast("double")), known, k, True), known, k)
        # What is known after the first lists bounds the rest.
        bound = top_k(start.hits, ["q"], [F.desc("score"), F.asc("vec_id")], k).filter(F.col("rank") == k).select("q", F.col("score").alias("bound"))
        rest = self._scored(self._sent(asked.join(bound, "q", "left"), known, k, False), known, k)
        hits = top_k(start.hits.unionByName(rest.hits), ["q"], [F.desc("score"), F.asc("vec_id")], k)
        return Search(hits.withColumnRenamed("q", query_id), start.lists | rest.lists)

    def nearest(self, queries: DataFrame, k: int, query_id: str = "query_id", vector: str = "embedding") -> DataFrame:
        return self.search(queries, k, query_id, vector).hits

    def _sent(self, asked: DataFrame, known: Lists, k: int, first: bool) -> DataFrame:
        """A row per query and list to read: the first ones, or all others that can still reach its bound."""
        shared = self.spark.sparkContext.broadcast(known)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lists = shared.value
            for batch in batches:
                for start in range(0, len(batch), 256):
                    part = batch.slice(start, 256)
                    bounds = lists.bounds(matrix(part.column("vec")))
                    chosen = lists.first(bounds, k)
                    if not first:
                        reach = np.nan_to_num(part.column("bound").to_numpy(zero_copy_only=False).astype(float), nan=-np.inf)
                        chosen = ~chosen & (bounds >= reach[:, None] - ROUNDING)
                    at, number = np.nonzero(chosen)
                    yield pa.RecordBatch.from_arrays(
                        [*part.select(["q", "vec"]).take(pa.array(at)).columns, pa.array(lists.numbers[number].astype(np.int32))], ["q", "vec", "list"]
                    )

        return asked.select("q", "vec", "bound").mapInArrow(run, "q BIGINT, vec ARRAY<DOUBLE>, list INT").checkpoint()

    def _scored(self, sent: DataFrame, known: Lists, k: int) -> Search:
        """The k best vectors of each list for each query that was sent to it; only those lists are read."""
        counts = {r["list"]: r["count"] for r in sent.groupBy("list").count().collect()}
        schema = pa.schema([("q", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not counts:
            return Search(self.spark.createDataFrame([], "q BIGINT, vec_id BIGINT, score DOUBLE"), set())
        rows = dict(zip(known.numbers.tolist(), known.rows.tolist()))
        shape = [(n, -(-rows[n] // VECTORS_PER_BLOCK), -(-asked // QUERIES_PER_BLOCK)) for n, asked in counts.items()]
        cut = F.broadcast(self.spark.createDataFrame(shape, "list INT, blocks INT, parts INT"))
        copies = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        dealt = lambda n, *by: F.pmod(F.xxhash64(*by), F.col(n)).cast("int")
        asked = sent.join(cut, "list").select("list", "q", "vec", dealt("parts", "q").alias("part"), copies("blocks").alias("block"))
        given = self.batches.read("vectors").filter(F.col("list").isin(list(counts))).join(cut, "list").select(
            "list", "vec_id", "vec", dealt("blocks", "vec_id", "vec").alias("block"), copies("parts").alias("part")
        )

        def best(asking: pa.Table, held: pa.Table) -> pa.Table:
            made: list[list[np.ndarray]] = [[], [], []]
            if len(asking) and len(held):
                names, ids = asking.column("q").to_numpy(), held.column("vec_id").to_numpy()
                scores = np.round(matrix(asking.column("vec")) @ matrix(held.column("vec")).T, 6)
                for name, row in zip(names, scores):
                    reach = np.flatnonzero(row >= np.partition(row, -k)[-k]) if len(row) > k else np.arange(len(row))
                    keep = reach[np.lexsort((ids[reach], -row[reach]))[:k]]
                    for column, values in zip(made, (np.full(keep.size, name), ids[keep], row[keep])):
                        column.append(values)
            return pa.table([pa.array(np.concatenate(c) if c else [], f.type) for c, f in zip(made, schema)], schema=schema)

        keys = ["list", "block", "part"]
        found = asked.groupBy(*keys).cogroup(given.groupBy(*keys)).applyInArrow(best, "q BIGINT, vec_id BIGINT, score DOUBLE")
        return Search(found, set(counts))
