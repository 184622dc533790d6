"""Approximate nearest neighbours by cross-polytope hashing.

A table turns unit vectors by three rounds of random signs and a fast Hadamard transform and files each under the
signed axis it lies nearest to. Queries look into the cells of their nearest axes in every table (multiprobe). Cells
are met in blocks of bounded size, and each block gives at most k rows per query, ranked by exact distance, so the
candidates themselves are never rows of a table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from memograph.llm.common import stored

TABLES, PROBES = 8, 16
#: Rows of a block of candidates and of queries that one task compares at a time.
CANDIDATES, QUERIES = 4096, 1024
KEY = ["dim", "table", "cell", "block", "query_block"]
CELL_FIELDS = "vec_id long, vec binary, dim int, table int, cell int"
SEED = 11


def turned(rows: np.ndarray, table: int) -> np.ndarray:
    """Pseudo-rotation of the rows; their width becomes the next power of two."""
    width = 1 << (rows.shape[1] - 1).bit_length()
    signs = np.random.default_rng([SEED, table, width]).choice([-1.0, 1.0], (3, width))
    made = np.zeros((len(rows), width))
    made[:, : rows.shape[1]] = rows
    for sign in signs:
        made *= sign
        half = 1
        while half < width:
            pairs = made.reshape(len(rows), width // (2 * half), 2, half)
            made = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(rows), width)
            half *= 2
        made /= np.sqrt(width)
    return made


def nearest_axes(rows: np.ndarray, table: int, probes: int) -> np.ndarray:
    """The cells of the nearest signed axes of every row, nearest first; ties to the smaller cell."""
    spread = turned(rows, table)
    both = np.concatenate([spread, -spread], axis=1)
    probes = min(probes, both.shape[1])
    return np.argsort(-both, axis=1, kind="stable")[:, :probes]


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id and vector of the rows that take part: with an id, not null or zero, all components finite."""
    kind = embeddings.schema["embedding"].dataType.elementType
    kind = kind if isinstance(kind, (T.FloatType, T.DoubleType)) else T.DoubleType()
    chosen = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(T.ArrayType(kind)).alias("vec"))
    vec = F.col("vec")
    finite = F.forall(vec, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return chosen.filter(F.col("vec_id").isNotNull() & vec.isNotNull() & finite & F.exists(vec, lambda x: x != 0))


def _dtype(vectors: DataFrame) -> str:
    return "<f4" if isinstance(vectors.schema["vec"].dataType.elementType, T.FloatType) else "<f8"


def filed(vectors: DataFrame, tables: int, probes: int) -> DataFrame:
    """A row per table and cell of each vector; table -1 and cell 0 with ``tables`` of 0."""
    dtype = _dtype(vectors)
    schema = pa.schema([("vec_id", pa.int64()), ("vec", pa.binary()), ("dim", pa.int32()), ("table", pa.int32()), ("cell", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array(pa.compute.list_value_length(batch.column(1)).to_pylist(), dtype=np.int64)
            for dim in np.unique(sizes):
                part = batch.filter(pa.array(sizes == dim))
                rows = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(-1, dim)
                raw = pa.array([r.tobytes() for r in rows], pa.binary())
                unit = _unit(rows.astype(np.float64))
                for table in range(tables) or [-1]:
                    axes = nearest_axes(unit, table, probes) if tables else np.zeros((len(rows), 1), dtype=np.int64)
                    for place in range(axes.shape[1]):
                        same = [pa.array(np.full(len(rows), x), pa.int32()) for x in (dim, table)]
                        yield pa.RecordBatch.from_arrays([part.column(0), raw, *same, pa.array(axes[:, place], pa.int32())], schema=schema)

    return vectors.mapInArrow(run, CELL_FIELDS)


def closest(queries: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, k: int):
    """(query, candidate, distance) of each query's k nearest other ids, by the nearest row of an id; ties to the smaller id."""
    by_id = np.argsort(ids, kind="stable")
    rows, ids = rows[by_id], ids[by_id]
    starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    rough = (queries * queries).sum(axis=1)[:, None] + (rows * rows).sum(axis=1)[None] - 2 * queries @ rows.T
    slack = 1e-9 * (1 + np.abs((queries * queries).sum(axis=1)) + (rows * rows).sum(axis=1).max())
    for i in range(len(queries)):
        others = np.flatnonzero(ids != query_ids[i])
        near = np.minimum.reduceat(rough[i], starts)
        near = near[ids[starts] != query_ids[i]]
        if len(near) > k:
            # Within the k-th smallest distance of an id, so that copies of one id take no other's place.
            others = others[rough[i, others] <= np.partition(near, k - 1)[k - 1] + slack[i]]
        distance = np.sqrt(((rows[others] - queries[i]) ** 2).sum(axis=1))
        order = np.lexsort((ids[others], distance))
        _, first = np.unique(ids[others][order], return_index=True)
        for j in order[np.sort(first)[:k]]:
            yield query_ids[i], ids[others[j]], distance[j]


def met(candidates: DataFrame, queries: DataFrame, k: int, dtype: str) -> DataFrame:
    """Per cell in common, each query's k nearest candidates: query_id, vec_id, score."""
    cell = KEY[:3]
    sizes = candidates.groupBy(*cell).agg(F.ceil(F.count("*") / CANDIDATES).alias("blocks"))
    asked = queries.groupBy(*cell).agg(F.ceil(F.count("*") / QUERIES).alias("query_blocks"))
    spread = lambda n: F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int")))
    pick = lambda n: F.pmod(F.xxhash64("vec_id", "vec"), F.col(n)).cast("int")
    shape = sizes.join(asked, cell)
    left = candidates.join(shape, cell).select(*cell, "vec_id", "vec", pick("blocks").alias("block"), spread("query_blocks").alias("query_block"))
    right = queries.join(shape, cell).select(*cell, "vec_id", "vec", pick("query_blocks").alias("query_block"), spread("blocks").alias("block"))

    def search(rows: pa.Table, asking: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        made = []
        if len(rows) and len(asking):
            dim = rows.column("dim")[0].as_py()
            unpack = lambda t: np.frombuffer(b"".join(t.column("vec").to_pylist()), dtype=dtype).reshape(-1, dim).astype(np.float64)
            ids = lambda t: t.column("vec_id").to_numpy()
            made = list(closest(unpack(asking), unpack(rows), ids(asking), ids(rows), k))
        columns = list(zip(*made)) or [[]] * 3
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return left.groupBy(*KEY).cogroup(right.groupBy(*KEY)).applyInArrow(search, "query_id long, vec_id long, score double")


def nearest(embeddings: DataFrame, queries: DataFrame, k: int = 10, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """Each query's k nearest found among ``embeddings``: query_id, rank from 1, vec_id, score (Euclidean distance).

    Rows that are null, zero or hold null or non-finite components take no part, nor do rows without an id. Vectors
    are compared with those of their own length. A row with the query's own id is no candidate of it; repeated rows
    of an id count once, by the smallest distance. Ties go to the smaller vec_id. A query for which the tables give
    fewer than k is compared with all vectors, so that small inputs give all they have. Hashing is by direction: of
    vectors of very unequal length near ones may be missed; recall is measured by the tests.
    """
    vectors, asking = usable(embeddings).dropDuplicates(["vec_id", "vec"]), usable(queries).dropDuplicates(["vec_id", "vec"])
    dtype = _dtype(vectors)
    found = stored(met(filed(vectors, tables, 1), filed(asking, tables, probes), k, dtype), "found")
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    enough = best.groupBy("query_id").count().filter(F.col("count") >= k).select(F.col("query_id").alias("vec_id"))
    short = stored(asking.join(enough, "vec_id", "left_anti"), "short")
    if not short.isEmpty():
        rest = met(filed(vectors, 0, 1), filed(short, 0, 1), k, dtype)
        best = best.join(short.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(
            rest.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
