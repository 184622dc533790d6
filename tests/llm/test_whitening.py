"""Whitening against plain arrays and exact whole numbers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from memograph.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(vectors, most):
    """vec_id to deviation and whitened values up to the sign, with explained shares, by numpy over all rows."""
    sound = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in sound})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centre = lambda x: np.array([(n * a - s) / n for a, s in zip(x, sums)])
    matrix = np.array([centre(x) for x in fit])
    values, axes = np.linalg.eigh(matrix.T @ matrix / n)
    values, axes = values[::-1][:most], axes[:, ::-1][:, :most]
    share = values / np.trace(matrix.T @ matrix / n)
    return n, share, [(i, sum((n * a - s) ** 2 for a, s in zip(x, sums)), centre(x) @ axes / np.sqrt(values)) for i, x in sound]


def compare(made, vectors, most):
    n, share, rows = plain(vectors, most)
    assert len(made) == len(rows) * len(share)
    by_id = {}
    for r in made:
        assert r["n"] == n and r["identity_error"] <= 1e-9 and r["explained"] == pytest.approx(share[r["component"] - 1], rel=1e-9)
        by_id.setdefault(r["vec_id"], []).append(r)
    signs = {}
    for i, deviation, values in rows:
        own = sorted((r["component"], r["deviation"], r["whitened"]) for r in by_id[i])
        assert {d for _, d, _ in own} == {deviation}
        for c, _, w in own:
            if abs(values[c - 1]) > 1e-3:
                signs.setdefault(c, []).append(round(w / values[c - 1], 6))
    assert all(set(s) in ({1.0}, {-1.0}) for s in signs.values()) and len(signs) == len(share)


def test_whitened_rows_equal_plain_ones(spark):
    draw = np.random.default_rng(3)
    base = draw.normal(size=(2500, 20)) * np.linspace(3, 0.5, 20) + draw.normal(size=20)
    vectors = [(i, v.tolist()) for i, v in enumerate(base.astype(np.float32))]
    vectors += [(5000 + i, vectors[7][1]) for i in range(900)] + [(None, vectors[8][1])]
    odd = [(9001, None), (9002, [None] * 20), (9003, [math.nan] * 20), (9004, [math.inf] * 20), (9005, []), (9006, [1.0] * 19 + [None])]
    df = spark.createDataFrame([(i, v, 1) for i, v in vectors + odd], SCHEMA).withColumn("ordinal", F.lit(1)).withColumn("x", F.lit(2))
    compare(whitening.whiten(df.repartition(5)).collect(), vectors, 16)


def test_fewer_entries_than_components_and_flat_directions(spark):
    draw = np.random.default_rng(4)
    vectors = [(i, [*v.tolist(), 2.0]) for i, v in enumerate(draw.normal(size=(60, 4)).astype(np.float32))]
    made = whitening.whiten(spark.createDataFrame([(i, v, 0) for i, v in vectors], SCHEMA)).collect()
    assert {r["component"] for r in made} == {1, 2, 3, 4}
    compare([r for r in made], vectors, 4)


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, None, 0)], [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 1)]):
        assert whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect() == []
    with pytest.raises(ValueError):
        whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0], 1)], SCHEMA))


def test_deviations_beyond_a_long_are_null(spark):
    rows = [(1, [1e9, 1.0], 0), (2, [-1e9, 2.0], 0), (3, [0.0, 5.0], 0)]
    made = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {r["vec_id"]: r["deviation"] is None for r in made} == {1: True, 2: True, 3: False}
    assert all(math.isfinite(r["whitened"]) for r in made)


def test_the_matrix_is_cut_into_blocks(spark, monkeypatch):
    """The same scatter whatever the size of a block, and it is multiplied in several tasks."""
    draw = np.random.default_rng(5)
    matrix = draw.normal(size=(500, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(matrix)], "ordinal long, v array<double>")
    for size in (7, 100, 1024):
        monkeypatch.setattr(whitening, "ROWS_PER_BLOCK", size)
        blocks = whitening.block_matrix(df, "ordinal", F.col("v"), 6, 500)
        assert blocks.numRowBlocks == -(-500 // size) and np.allclose(whitening.scatter(blocks, 6), matrix.T @ matrix)
        back = whitening.rows_of(whitening.projected(blocks, np.eye(6)[:, :3]), "at", "values", spark).orderBy("at").collect()
        assert [r["at"] for r in back] == list(range(500)) and np.allclose([r["values"] for r in back], matrix[:, :3])
