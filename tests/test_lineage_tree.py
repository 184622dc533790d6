"""The lineage tree against a plain walk."""

import random

import pytest

from memograph.operators import graph

EDGES = "parent_entry_id STRING, child_entry_id STRING, edge_type STRING, created_at STRING, metadata_json STRING"


def walked(root, edges, known, most):
    """Rows of a depth-first walk that expands an entry once."""
    children = {}
    for p, c, t in edges:
        if c in known:
            children.setdefault(p, {}).setdefault(c, t)
            children[p][c] = min(children[p][c], t)
    rows, seen = [], set()

    def walk(entry, depth):
        opened = depth < most and entry not in seen
        rows.append((root, len(rows), depth, entry, opened))
        if opened:
            seen.add(entry)
            for child in sorted(children.get(entry, {}), key=lambda c: (children[entry][c], c)):
                walk(child, depth + 1)

    walk(root, 0)
    return rows


def compare(spark, roots, edges, known, most=10):
    frame = spark.createDataFrame([(p, c, "depends_on", t, "{}") for p, c, t in edges], EDGES)
    entries = spark.createDataFrame([(k,) for k in known], "entry_id STRING")
    made = graph.lineage_tree(spark.createDataFrame([(r,) for r in roots], "entry_id STRING"), frame, entries, most).collect()
    assert sorted(map(tuple, made)) == sorted(row for r in set(roots) for row in walked(r, edges, known, most))


def test_diamond_cycle_and_order(spark):
    diamond = [("a", "c", "2"), ("a", "b", "1"), ("b", "d", "1"), ("c", "d", "1"), ("d", "e", "1"), ("a", "gone", "0")]
    compare(spark, ["a", "c", "alone", "a"], diamond, set("abcde"))
    cycle = [("a", "b", "1"), ("b", "c", "1"), ("c", "a", "1"), ("c", "c", "0"), ("a", "c", "2"), ("b", "a", "0")]
    compare(spark, ["a", "b"], cycle, set("abc"))
    # Met first where the depth ends, and expanded later at a smaller depth.
    late = [("a", "b", "1"), ("b", "c", "1"), ("c", "d", "1"), ("a", "d", "2"), ("d", "e", "1"), ("d", "e", "3")]
    for most in (0, 1, 2, 3, 4):
        compare(spark, ["a"], late, set("abcde"), most)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs(spark, seed):
    draw = random.Random(seed)
    names = [f"n{i}" for i in range(12)]
    edges = [(draw.choice(names), draw.choice(names), str(draw.randint(0, 3))) for _ in range(26)]
    compare(spark, names[:5], edges, set(names), 4 + seed)


def test_ways_do_not_multiply(spark):
    """Forty diamonds in a row have a trillion paths and 121 expanded entries."""
    edges = [e for i in range(40) for e in ((f"t{i:02}", f"l{i:02}", "1"), (f"t{i:02}", f"r{i:02}", "2"), (f"l{i:02}", f"t{i + 1:02}", "1"), (f"r{i:02}", f"t{i + 1:02}", "1"))]
    known = {x for p, c, _ in edges for x in (p, c)}
    assert len(walked("t36", edges, known, 100)) == 17
    compare(spark, ["t36"], edges, known, 100)


def test_no_roots(spark):
    compare(spark, [], [("a", "b", "1")], {"a", "b"})
