import random

import pytest
from pyspark.sql import functions as F

from memograph.operators import spans

DDL = "k BIGINT, start BIGINT, end BIGINT"


def brute(intervals, low, high):
    held = {p for s, e in intervals for p in range(max(s, low), min(e, high))}
    runs = []
    for p in range(low, high):
        if runs and runs[-1][2] == (p in held):
            runs[-1][1] = p + 1
        else:
            runs.append([p, p + 1, p in held])
    return [tuple(r) for r in runs]


@pytest.mark.parametrize("block", [1, 3, 7, 4096])
def test_runs_tile_the_frame_for_any_block_size(spark, block):
    rng = random.Random(block)
    cases, frames, expected = [], [], {}
    for key in range(60):
        low = rng.randrange(0, 20)
        high = low + rng.randrange(0, 40)
        made = []
        for _ in range(rng.randrange(0, 8)):
            s = rng.randrange(low, high + 1)
            e = rng.randrange(s, high + 1)
            made += [(s, e)] * rng.choice([1, 1, 3])
        cases += [(key, s, e) for s, e in made]
        frames.append((key, low, high))
        expected[key] = brute(made, low, high)
    runs = spans.coverage_runs(
        spark.createDataFrame(cases, DDL), ["k"], spark.createDataFrame(frames, DDL), block
    ).collect()
    found = {key: [] for key in expected}
    for r in sorted(runs, key=lambda r: (r.k, r.start)):
        found[r.k].append((r.start, r.end, r.covered))
    assert found == expected


@pytest.mark.parametrize("block", [2, 4096])
def test_merge_coalesces_touching_and_drops_empty(spark, block):
    rows = [(1, 0, 2), (1, 2, 4), (1, 6, 6), (1, 7, 9), (1, 8, 12), (2, 5, 6)]
    merged = spans.merge(spark.createDataFrame(rows, DDL), ["k"], block)
    assert sorted(map(tuple, merged.collect())) == [(1, 0, 4), (1, 7, 12), (2, 5, 6)]
    again = spans.merge(merged, ["k"], block)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, merged.collect()))


def test_many_copies_of_one_interval_collapse_before_the_shuffle(spark):
    rows = spark.range(50_000).select(F.lit(1).alias("k"), F.lit(3).alias("start"), F.lit(9).alias("end"))
    assert [tuple(r) for r in spans.merge(rows, ["k"]).collect()] == [(1, 3, 9)]


def test_tumbling_windows(spark):
    df = spark.createDataFrame([(0, 9), (4, 4)], "start BIGINT, end BIGINT")
    cut = df.select(F.col("start").alias("s"), F.inline(spans.tumbling(F.col("start"), F.col("end"), 4)))
    assert [(r.start, r.end) for r in cut.collect()] == [(0, 4), (4, 8), (8, 9)]
    with pytest.raises(ValueError):
        spans.tumbling(F.lit(0), F.lit(1), 0)
