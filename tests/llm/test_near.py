"""Near duplicates and neighbours against all pairs."""

import itertools
import random
import re

import numpy as np
from pyspark.sql import functions as F

from memograph.llm import dedup, neighbours

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(zip(*(words[j:] for j in range(k)))) if len(words) >= k else frozenset([tuple(words)] if words else [])


def linked(sets, percent=80):
    label = {i: i for i in sets}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in itertools.combinations(sorted(sets), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
            a, b = sorted((top(i), top(j)))
            label[b] = a
    return {i: top(i) for i in sets}


def test_components_equal_all_pairs(corpus, nothing):
    rows = [(i, t) for i, t, *_ in corpus[1]]
    for words in (4, 5):
        sets = {i: shingles(t, words) for i, t in rows if i is not None}
        expected = linked(sets)
        made = dedup.near_duplicates(corpus[0], words).collect()
        assert len(made) == len(rows)
        for r in made:
            if r["doc_id"] is None:
                assert r["component_id"] is None and r["kept"]
            else:
                assert (r["component_id"], r["n_shingles"]) == (expected[r["doc_id"]], len(sets[r["doc_id"]]))
                assert r["kept"] == (r["doc_id"] == r["component_id"])
    assert dedup.near_duplicates(nothing).count() == 0


def test_kept_rows_keep_one_of_each_group(corpus, nothing):
    kept = dedup.kept_rows(corpus[0])
    assert kept.columns == corpus[0].columns
    expected = linked({i: shingles(t, 5) for i, t, *_ in corpus[1] if i is not None})
    assert sorted(r["doc_id"] for r in kept.filter("doc_id is not null").collect()) == sorted(set(expected.values()))
    assert kept.filter("doc_id is null").count() == 2
    assert dedup.kept_rows(nothing).count() == 0


def test_a_chain_of_many_near_copies_loses_no_link(spark):
    draw = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(150):
        words = list(base)
        for at in draw.sample(range(150), draw.randint(0, 9)):
            words[at] = f"x{draw.randint(0, 10**6)}"
        rows.append((i, " ".join(words)))
    made = dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    expected = linked({i: shingles(t, 4) for i, t in rows})
    assert {r["doc_id"]: r["component_id"] for r in made} == expected and len(set(expected.values())) > 5


def test_neighbours_reach_nine_in_ten(spark):
    draw = np.random.default_rng(2)
    rows = draw.normal(size=(3000, 48))
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "vec_id long, embedding array<double>")
    made = neighbours.nearest(df, df.filter("vec_id % 100 = 0")).collect()
    hits = 0
    for q in range(0, 3000, 100):
        distance = np.sqrt(((rows - rows[q]) ** 2).sum(axis=1))
        distance[q] = np.inf
        got = sorted((r["rank"], r["vec_id"], r["score"]) for r in made if r["query_id"] == q)
        assert [g[0] for g in got] == list(range(1, 11))
        assert np.allclose([g[2] for g in got], distance[[g[1] for g in got]], rtol=0, atol=1e-12)
        hits += len({g[1] for g in got} & set(np.argsort(distance)[:10].tolist()))
    assert hits / 300 >= 0.9


def test_neighbours_of_few_and_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, []), (None, [1.0, 1.0]), (100, [-1.0, 0.0]), (200, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    made = neighbours.nearest(df, df.filter("vec_id % 100 = 0"), k=10).collect()
    got = {q: [(r["vec_id"], round(r["score"], 6)) for r in sorted(made, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (0, 100, 200)}
    assert got[0] == [(2, 0.0), (3, 0.0), (1, 1.414214), (100, 2.0)]
    assert got[100] == [(1, 1.414214), (0, 2.0), (2, 2.0), (3, 2.0)] and got[200] == []
    empty = df.filter(F.lit(False))
    assert neighbours.nearest(empty, empty).count() == 0
