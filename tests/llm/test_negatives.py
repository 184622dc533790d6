"""Hard negatives against all pairs, and what the tree leaves out."""

import math

import numpy as np
import pytest

from memograph.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<double>, row string, leaf string"


def plain(rows, every):
    """All pairs in whole numbers."""
    known = {
        (i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * c) for c in v))
        for i, label, v in rows
        if i is not None and label is not None and v and all(c is not None and math.isfinite(c) for c in v)
    }
    made = []
    for a in known:
        if a[0] % every:
            continue
        scored = [(sum(x * y for x, y in zip(a[2], b[2])), b) for b in known if b[0] != a[0]]
        scored.sort(key=lambda s: (-s[0], s[1][0]))
        for p, b in [s for s in scored if s[1][1] == a[1]][:5]:
            fits = [(n, c) for n, c in scored if c[1] != a[1] and 50 * p <= 100 * n <= 95 * p][:3]
            made += [(a[0], b[0], rank, c[0], p, n) for rank, (n, c) in enumerate(fits, 1)]
    return sorted(made)


def made_by(spark, rows, every, **options):
    df = spark.createDataFrame([(i, label, v, "x", "y") for i, label, v in rows], SCHEMA)
    return sorted(map(tuple, negatives.hard_negatives(df.repartition(3), every, **options).collect()))


def clustered(draw, n, clusters, width=12, spread=0.05):
    centres = draw.normal(size=(clusters, width))
    made = centres[np.arange(n) % clusters] + spread * draw.normal(size=(n, width))
    return made / np.linalg.norm(made, axis=1, keepdims=True)


@pytest.mark.parametrize("fanout, leaf_rows", [(4, 20), (16, 2048)])
def test_equal_to_all_pairs(spark, monkeypatch, fanout, leaf_rows):
    monkeypatch.setattr(negatives, "BLOCK", 64)
    monkeypatch.setattr(negatives, "ANCHORS", 8)
    draw = np.random.default_rng(6)
    rows = [(i, int(draw.integers(0, 4)), v.tolist()) for i, v in enumerate(clustered(draw, 500, 9))]
    rows += [(1000 + i, 1, rows[5][2]) for i in range(150)]  # one leaf of copies, all of them ties
    rows += [(2000 + i, i % 3, (20 * draw.normal(size=12)).tolist()) for i in range(60)]  # very unequal lengths
    rows += [(3000, 1, [0.0] * 12), (3010, None, [1.0] * 12), (3020, 1, None), (3030, 2, [None] * 12), (3040, 2, [math.nan] * 12), (None, 1, [1.0] * 12)]
    rows += [(3050, 2, [math.inf] * 12), (3060, 1, []), rows[10], rows[10], (20, 3, rows[11][2]), (3070, 99, [1.0] * 12)]
    assert made_by(spark, rows, 10, fanout=fanout, leaf_rows=leaf_rows) == plain(rows, 10)


def test_no_anchor_no_partner_no_rows(spark):
    one = [1.0, 0.5]
    for rows in ([], [(1, 0, one), (2, 0, one)], [(50, 0, one)], [(50, 0, one), (51, 0, one)], [(50, 1, one), (51, 2, one)], [(50, 1, one), (51, 1, [-1.0, -0.5]), (52, 2, one)]):
        assert made_by(spark, rows, 50) == plain(rows, 50) == []
    with pytest.raises(ValueError):
        made_by(spark, [(50, 1, [1.0]), (51, 1, [1.0, 2.0])], 50)


def test_windows_hold_their_bounds(spark):
    """Positive scores of every remainder, negatives right at both ends of the window."""
    for p in (0, 1, 2, 19, 20, 21, 100, 101):
        rows = [(50, 1, [1 / 256, 0.0]), (51, 1, [p / 256, 0.0])] + [(60 + n, 2, [n / 256, 0.0]) for n in range(0, 110)]
        assert made_by(spark, rows, 50) == plain(rows, 50)


def test_scores_beyond_a_double_are_exact(spark):
    rows = [(50 * i, i % 2, [2.0**20 + i * 257.0 + 1 / 256, -(2.0**19) - i, 3.0 + i]) for i in range(40)] + [(50 * i + 1, 2, [734_003.0, -367_001.0 - 3 * i - 1 / 256, 9.0]) for i in range(40)]
    expected = plain(rows, 50)
    assert any(abs(r[4]) > 2**53 for r in expected) and made_by(spark, rows, 50) == expected


def test_ranges_leave_out_far_leaves_and_no_row_within_a_window():
    draw = np.random.default_rng(8)
    for spread in (0.05, 0.5):
        rows = np.floor(256 * clustered(draw, 6000, 40, 16, spread)).astype(np.int64)
        tree = negatives.Tree(rows[::2], len(rows), 8, 100)
        tree.clear()
        leaf = tree.walk(rows, tree.see)
        assert tree.leaves > 30
        anchors = rows[::60]
        scores = negatives.products(anchors, rows)
        low, high = (np.sort(scores, axis=1)[:, -5] * x for x in (0.5, 0.95))
        met = tree.met(anchors, np.arange(len(anchors)), low, high)
        for i, row in enumerate(scores):
            assert met[i, np.unique(leaf[(row >= low[i]) & (row <= high[i])])].all()
        if spread == 0.05:
            assert met.mean() < 0.6
        close = tree.met(anchors, np.arange(len(anchors)), np.sort(scores, axis=1)[:, -5].astype(float), np.full(len(anchors), 2.0**62))
        assert spread > 0.05 or close.mean() < 0.1
