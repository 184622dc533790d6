"""The stored vector index: equal to the search over all vectors, appended to, and read in part."""

import os
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from memograph.operators import ranking
from memograph.sources.vector_index import VectorIndex

SCHEMA = "vec_id BIGINT, embedding ARRAY<DOUBLE>"


def clustered(draw, n, clusters, width=16, spread=0.02):
    centres = draw.normal(size=(clusters, width))
    made = centres[np.arange(n) % clusters] + spread * draw.normal(size=(n, width))
    return made / np.linalg.norm(made, axis=1, keepdims=True)


def frame(spark, rows, first=0):
    return spark.createDataFrame([(first + i, r.tolist()) for i, r in enumerate(rows)], SCHEMA)


def files(path):
    return {str(p): os.stat(p).st_mtime_ns for p in Path(path).rglob("*.parquet")}


def same(index, vectors, queries, k):
    found = index.search(queries, k)
    made = sorted(map(tuple, found.hits.select("query_id", "vec_id", "score", "rank").collect()))
    expected = sorted(map(tuple, ranking.nearest(queries, vectors, "query_id", "vec_id", k).select("query_id", "vec_id", "score", "rank").collect()))
    assert made == expected
    return found


def test_exact_with_a_part_of_the_lists(spark, tmp_path):
    draw = np.random.default_rng(1)
    rows = clustered(draw, 1600, 40)
    vectors = frame(spark, rows)
    odd = spark.createDataFrame([(None, [1.0] * 16), (7000, None), (7001, [float("nan")] * 16), (7002, []), (7003, [1.0] * 15 + [None])], SCHEMA)
    index = VectorIndex(spark, str(tmp_path))
    index.add(vectors.unionByName(odd), "first")
    assert index.total == 1600
    queries = frame(spark, rows[:4]).withColumnRenamed("vec_id", "query_id")
    found = same(index, vectors, queries, 5)
    lists = index.batches.read("lists").count()
    assert lists > 20 and len(found.lists) <= lists / 3
    # The files of the other lists are not opened.
    read = {int(f.split("list=")[1].split("/")[0]) for f in index.batches.read("vectors").filter(F.col("list").isin(list(found.lists))).inputFiles()}
    assert read >= found.lists


def test_appending_leaves_earlier_files_alone(spark, tmp_path):
    draw = np.random.default_rng(2)
    rows = clustered(draw, 900, 12)
    index = VectorIndex(spark, str(tmp_path))
    index.add(frame(spark, rows[:500]), "a")
    before = files(tmp_path)
    index.add(frame(spark, rows[500:], 500), "b")
    after = files(tmp_path)
    assert before.items() <= after.items() and len(after) > len(before)
    index.add(frame(spark, rows[:500]), "a")
    assert files(tmp_path) == after and index.total == 900
    same(VectorIndex(spark, str(tmp_path)), frame(spark, rows), frame(spark, rows[::150]).withColumnRenamed("vec_id", "query_id"), 12)


def test_one_list_may_hold_nearly_all(spark, tmp_path, monkeypatch):
    from memograph.sources import vector_index

    monkeypatch.setattr(vector_index, "VECTORS_PER_BLOCK", 50)
    monkeypatch.setattr(vector_index, "QUERIES_PER_BLOCK", 3)
    draw = np.random.default_rng(3)
    rows = np.vstack([clustered(draw, 60, 6), np.repeat(clustered(draw, 1, 1), 400, axis=0)])
    index = VectorIndex(spark, str(tmp_path))
    index.add(frame(spark, rows), "only")
    same(index, frame(spark, rows), frame(spark, rows[-10:]).withColumnRenamed("vec_id", "query_id"), 7)
    same(index, frame(spark, rows), frame(spark, rows[:3]).withColumnRenamed("vec_id", "query_id"), 1000)


def test_a_broken_batch_is_not_seen(spark, tmp_path, monkeypatch):
    draw = np.random.default_rng(4)
    rows = clustered(draw, 200, 5)
    index = VectorIndex(spark, str(tmp_path))
    index.add(frame(spark, rows[:100]), "a")
    write = index.batches.write

    def failing(commit, table, *rest):
        if table == "lists":
            raise OSError("lost")
        write(commit, table, *rest)

    monkeypatch.setattr(index.batches, "write", failing)
    with pytest.raises(OSError):
        index.add(frame(spark, rows[100:], 100), "b")
    monkeypatch.setattr(index.batches, "write", write)
    assert index.total == 100 and index.vectors().count() == 100
    index.add(frame(spark, rows[100:], 100), "b")
    assert index.total == 200
    same(index, frame(spark, rows), frame(spark, rows[:2]).withColumnRenamed("vec_id", "query_id"), 150)


def test_nothing_stored_and_wrong_widths(spark, tmp_path):
    index = VectorIndex(spark, str(tmp_path))
    queries = frame(spark, np.ones((1, 3))).withColumnRenamed("vec_id", "query_id")
    assert index.total == 0 and index.nearest(queries, 3).count() == 0
    index.add(frame(spark, np.ones((0, 3))), "empty")
    index.add(frame(spark, np.ones((2, 3))), "some")
    assert [(r["vec_id"], r["score"]) for r in index.nearest(queries, 1).collect()] == [(0, 3.0)]
    with pytest.raises(ValueError):
        index.add(frame(spark, np.ones((2, 4))), "wide")
    with pytest.raises(ValueError):
        index.nearest(frame(spark, np.ones((1, 2))).withColumnRenamed("vec_id", "query_id"), 1)
