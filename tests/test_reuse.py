from pyspark.sql import functions as F

from memograph import schema as S
from memograph.operators import graph, matching
from memograph.plans.reuse import plan_reuse

EX, AG, HI, RO = S.EXACT_ANSWER, S.AGGREGATION_COMPONENT, S.SEARCH_HINT, S.RULED_OUT


def told(plan):
    rows = plan.telemetry.collect()
    assert len(rows) == 1
    return rows[0]


def intervals(df):
    return sorted((r.start, r.end) for r in df.collect())


def test_exact_replay_ignores_case_and_spacing(memo):
    plan = plan_reuse(memo.requests((1, 3, 4, {"prompt": "  find   the q1 arr "})), memo.entries((3, 4, EX)))
    row = told(plan)
    assert row.has_exact_replay and row.coverage_ratio == 1.0 and row.reusable == 1
    assert intervals(plan.covered) == [(3, 4)] and intervals(plan.missing) == []


def test_partial_coverage(memo):
    plan = plan_reuse(memo.requests((1, 0, 8)), memo.entries((0, 2, AG), (5, 7, AG)))
    row = told(plan)
    assert intervals(plan.missing) == [(2, 5), (7, 8)]
    assert (row.covered_length, row.coverage_ratio, row.kind_aggregation_component) == (4, 0.5, 2)


def test_same_scope_prefers_exact(memo):
    entries = memo.entries((0, 2, AG)).unionByName(memo.entries((0, 2, EX, {"dependencies": ["x"]})))
    plan = plan_reuse(memo.requests((1, 0, 4)), entries)
    assert [r.kind for r in plan.reusable.collect()] == [EX]
    assert intervals(plan.missing) == [(2, 4)]


def test_negatives_cover_and_hints_do_not(memo):
    row = told(plan_reuse(memo.requests((1, 0, 4)), memo.entries((0, 2, RO), (2, 4, AG))))
    assert row.is_complete and row.negative == 1 and row.coverage_ratio == 1.0
    assert (row.kind_ruled_out_region, row.kind_aggregation_component) == (1, 1)
    plan = plan_reuse(memo.requests((1, 0, 10)), memo.entries((6, 7, HI)))
    assert told(plan).hint == 1 and told(plan).coverage_ratio == 0.0
    assert intervals(plan.missing) == [(0, 10)]
    rejected = memo.entries((4, 5, HI, {"status": S.REJECTED}))
    assert told(plan_reuse(memo.requests((1, 0, 10)), rejected)).hint == 0


def test_content_hash_blocks_unless_empty(memo):
    old = memo.entries((0, 2, EX, {"hash": "old"}))
    blocked = plan_reuse(memo.requests((1, 0, 2, {"hash": "new"})), old)
    assert not told(blocked).has_exact_replay and intervals(blocked.missing) == [(0, 2)]
    assert told(plan_reuse(memo.requests((1, 0, 2, {"hash": ""})), old)).has_exact_replay


def test_empty_request_is_complete(memo):
    row = told(plan_reuse(memo.requests((1, 5, 5)), memo.entries((0, 9, AG))))
    assert row.coverage_ratio == 1.0 and row.is_complete and row.reusable == 0


def test_constraints_separate_tasks(memo):
    plan = plan_reuse(memo.requests((1, 0, 2, {"constraints": '{"chunk_size":2}'})), memo.entries((0, 2, AG)))
    assert intervals(plan.missing) == [(0, 2)]


def test_invalidation_rejects_and_propagates_even_in_cycles(memo, spark):
    child = memo.entries((0, 1, EX))
    child_id = child.first()["entry_id"]
    parent = memo.entries((8, 9, EX, {"dependencies": [child_id]}))
    parent_id = parent.first()["entry_id"]
    entries = child.unionByName(parent)
    changed = memo.requests((7, 0, 1, {"hash": ""}))
    edges = graph.depends_on(entries)
    back = spark.createDataFrame([(child_id, parent_id)], "parent_entry_id STRING, child_entry_id STRING")
    for known in (edges, edges.select(*back.columns).unionByName(back)):
        found = {r.entry_id: r.depth for r in graph.invalidated(changed, entries, known).collect()}
        assert found == {child_id: 0, parent_id: 1}
    stale = graph.invalidated(changed, entries, edges)
    after = graph.reject(entries, stale, "edited", "2024-02-02T00:00:00Z")
    assert {r.verifier_status for r in after.collect()} == {S.REJECTED}
    assert after.filter(F.get_json_object("metadata_json", "$.rejection_reason") == "edited").count() == 2
    assert intervals(plan_reuse(memo.requests((1, 0, 2)), after).missing) == [(0, 2)]
    alone = graph.invalidated(changed, entries, edges, propagate=False)
    assert [r.entry_id for r in alone.collect()] == [child_id]


def test_lineage_lists_dependencies_with_depth(memo):
    leaf = memo.entries((0, 1, AG))
    leaf_id = leaf.first()["entry_id"]
    top = memo.entries((0, 4, EX, {"dependencies": [leaf_id]}))
    edges = graph.depends_on(top)
    rows = graph.lineage(top.select("entry_id"), edges).collect()
    assert {(r.entry_id, r.depth) for r in rows} == {(top.first()["entry_id"], 0), (leaf_id, 1)}


def test_overlap_join_is_the_same_for_every_bin_width(memo, spark):
    import random

    rng = random.Random(5)
    asked = [(i, s, s + rng.randrange(1, 30)) for i in range(40) for s in [rng.randrange(0, 60)]]
    held = [(100 + i, s, s + rng.randrange(1, 30)) for i in range(40) for s in [rng.randrange(0, 60)]]
    left = spark.createDataFrame([("d", "", *r) for r in asked], "doc STRING, content_hash STRING, a BIGINT, start BIGINT, end BIGINT")
    right = spark.createDataFrame(
        [("d", "", *r) for r in held], "doc STRING, content_hash STRING, b BIGINT, scope_start BIGINT, scope_end BIGINT"
    )
    expected = sorted((x[0], y[0]) for x in asked for y in held if x[1] < y[2] and x[2] > y[1])
    for width in (1, 4, 1024):
        pairs = matching.overlapping(left, right, ["doc"], width)
        assert sorted((r.a, r.b) for r in pairs.collect()) == expected


def test_similar_text_join_equals_brute_force(spark):
    import random

    rng = random.Random(11)
    words = ["alpha", "beta", "gamma", "delta7", "omega", "zeta", "x9", "kilo"]
    texts = [(i, "k", " ".join(rng.sample(words, rng.randrange(1, 6)))) for i in range(60)]
    left = spark.createDataFrame(texts, "a BIGINT, k STRING, lt STRING")
    right = spark.createDataFrame(texts, "b BIGINT, k STRING, rt STRING")
    for threshold in (0.5, 0.8, 1.0):
        found = {(r.a, r.b) for r in matching.similar_text_join(left, right, ["k"], "lt", "rt", threshold).collect()}
        expected = set()
        for i, _, s in texts:
            for j, _, t in texts:
                x, y = set(s.split()), set(t.split())
                if len(x & y) >= threshold * len(x | y):
                    expected.add((i, j))
        assert found == expected


def test_lineage_has_no_depth_limit_and_marks_a_given_one(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(14)], "parent_entry_id STRING, child_entry_id STRING")
    roots = spark.createDataFrame([("n0",), ("n12",)], "entry_id STRING")
    assert graph.lineage(roots, edges).filter("root_id = 'n0'").count() == 15
    cut = graph.lineage(roots, edges, max_depth=3)
    assert {(r.root_id, r.truncated) for r in cut.collect()} == {("n0", True), ("n12", False)}
