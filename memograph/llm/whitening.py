"""Whitening of embeddings with Spark MLlib's block matrices.

Rows are moved to whole numbers, centred by the exact mean of the distinct ones and indexed into a ``BlockMatrix``. Its
transpose times itself is the scatter matrix, whose eigenvectors a driver finds locally, as it has only as many rows as
a vector has entries. A second block product with the whitening matrix projects all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memograph.llm.common import numbered

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
ROWS_PER_BLOCK = 1024
#: Largest size of a scaled entry that is surely a whole number of a long.
LARGEST = 2.0**53
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole_numbers(embeddings: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """vec_id and ``x = floor(scale * entry) + shift`` of the rows whose vectors have entries, none null or not finite."""
    vectors = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"))
    sound = F.forall("vec", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c * scale) < LARGEST), F.lit(False)))
    return vectors.filter(F.col("vec").isNotNull() & (F.size("vec") > 0) & sound).select(
        "vec_id", F.transform("vec", lambda c: F.floor(c * scale) + shift).alias("x")
    )


class Mean:
    """Exact mean of the fit list, as its number of vectors and the sum of each entry."""

    def __init__(self, fit: DataFrame):
        entries = fit.select(F.posexplode("x").alias("dim", "value")).groupBy("dim").agg(
            F.sum(F.col("value").cast("decimal(19,0)")).alias("total"), F.count("*").alias("n")
        )
        rows = sorted((r["dim"], int(r["total"]), r["n"]) for r in entries.collect())
        self.sums, self.n = [total for _, total, _ in rows], rows[0][2] if rows else 0

    def _entries(self, step) -> Column:
        """``step(x, n * x - sum, mean)`` of each entry; the second is null where it does not fit a long."""
        known = [
            F.struct((F.lit(s) if abs(s) < 2**63 else F.lit(None)).cast("long").alias("sum"), F.lit(s / self.n).alias("mean")) for s in self.sums
        ]
        exact = lambda x, s: F.try_subtract(F.try_multiply(F.lit(self.n).cast("long"), x), s["sum"])
        return F.zip_with("x", F.array(*known), lambda x, s: step(x, exact(x, s), s["mean"]))

    def centred(self) -> Column:
        """Entries without their mean; taken from whole numbers, so that no digits cancel."""
        return self._entries(lambda x, exact, mean: F.coalesce(exact.cast("double") / self.n, x.cast("double") - mean))

    def deviation(self) -> Column:
        """Sum of ``(n * x - sum) ** 2``, exact; null beyond a long."""
        squares = self._entries(lambda x, exact, mean: F.try_multiply(exact, exact))
        return F.aggregate(squares, F.lit(0).cast("long"), lambda total, square: F.try_add(total, square))


def block_matrix(rows: DataFrame, index: str, entries: Column, width: int, count: int) -> BlockMatrix:
    """Rows of doubles as a block matrix of full-width blocks; ``index`` numbers them from 0 to ``count``."""
    indexed = rows.select(F.col(index).cast("long").alias("index"), array_to_vector(entries).alias("vector"))
    return IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(indexed, "vector"), count, width).toBlockMatrix(ROWS_PER_BLOCK, width)


def scatter(blocks: BlockMatrix, width: int) -> np.ndarray:
    """``blocks.transpose() * blocks``, ``width`` by ``width``.

    The product has one block, so MLlib is told to split the dimension that is summed over into as many parts as there
    are row blocks or cores; each part is one task that multiplies the blocks it was dealt, and only sums are gathered.
    """
    context = blocks.blocks.context
    parts = max(1, min(blocks.numRowBlocks, 4 * context.defaultParallelism))
    # The Python method lacks the second parameter of the one it calls.
    made = blocks.transpose()._java_matrix_wrapper.call("multiply", blocks._java_matrix_wrapper._java_model, parts)
    return BlockMatrix(made, width, width).toLocalMatrix().toArray()


def components(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors as columns; those that are zero but for rounding are left out."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    sound = values > max(values[0], 0) * len(covariance) * np.finfo(float).eps
    return values[sound], vectors[:, sound]


def projected(blocks: BlockMatrix, weights: np.ndarray) -> BlockMatrix:
    """``blocks * weights`` as a product of block matrices."""
    right = blocks.blocks.context.parallelize([((0, 0), Matrices.dense(*weights.shape, weights.ravel(order="F").tolist()))], 1)
    return blocks.multiply(BlockMatrix(right, *weights.shape))


def rows_of(blocks: BlockMatrix, index: str, name: str, spark) -> DataFrame:
    """The rows of a matrix of full-width blocks: their number and an array of doubles."""
    height = blocks.rowsPerBlock

    def run(block) -> Iterator[tuple[int, list[float]]]:
        (at, _), matrix = block
        return enumerate(matrix.toArray().tolist(), at * height)

    return spark.createDataFrame(blocks.blocks.flatMap(run), f"{index} long, {name} array<double>", verifySchema=False)


def whiten(embeddings: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """Per usable row and component: vec_id, component, n, deviation, whitened, explained and identity_error.

    A row is usable if its vector has entries, none null or not finite (or so large, from 2 ** 47 on, that it would be no exact
    whole number); others give nothing. Usable vectors must be of one width, else it is an error. The fit list holds
    each distinct x vector once; mean, scatter and identity_error come from it alone. Rows keep their vec_id, null ones
    too; repeated rows are projected each. Components are numbered by falling eigenvalue; those without variance cannot
    be whitened and give no row, so a table with one distinct vector, or without rows, gives none. ``deviation`` is null
    where it exceeds a long.
    """
    spark = embeddings.sparkSession
    rows = numbered(whole_numbers(embeddings), "ordinal", "whole")
    widths = [r["width"] for r in rows.select(F.size("x").alias("width")).distinct().limit(2).collect()]
    if len(widths) > 1:
        raise ValueError(f"vectors of different widths: {widths}")
    if not widths:
        return spark.createDataFrame([], RESULT)
    width = widths[0]
    fit = numbered(rows.select("x").distinct(), "ordinal", "fit")
    mean = Mean(fit)
    blocks = block_matrix(fit, "ordinal", mean.centred(), width, mean.n)
    covariance = scatter(blocks, width) / mean.n
    values, vectors = components(covariance, most)
    if not len(values):
        return spark.createDataFrame([], RESULT)
    weights = vectors / np.sqrt(values)
    error = np.abs(scatter(projected(blocks, weights), len(values)) / mean.n - np.eye(len(values))).max()
    explained = F.array(*[F.lit(float(v)) for v in values / np.trace(covariance)])
    everything = projected(block_matrix(rows, "ordinal", mean.centred(), width, rows.count()), weights)
    made = rows_of(everything, "ordinal", "values", spark)
    named = rows.select("ordinal", "vec_id", mean.deviation().alias("deviation")).join(made, "ordinal")
    spread = named.select("vec_id", "deviation", F.posexplode("values").alias("at", "whitened"))
    return spread.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(mean.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(float(error)).alias("identity_error"),
    )
