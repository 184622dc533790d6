import random

from pyspark.sql import functions as F

from memograph import schema as S
from memograph.operators import graph
from memograph.plans import retrieval, solve
from memograph.plans.reuse import plan_reuse

AG, EX, HI = S.AGGREGATION_COMPONENT, S.EXACT_ANSWER, S.SEARCH_HINT
AT = "2024-01-01T00:00:00Z"
NOTHING = lambda memo: memo.entries((0, 1, AG)).filter("false")
FACT = solve.python_solver(lambda s: f"fact:{s['document_id']}:{s['start']}")


def report(solution):
    return {r.request_id: r for r in solution.report.collect()}


def test_windows_then_replay(memo):
    asked = memo.requests((1, 0, 4))
    made = solve.solve_windows(asked, NOTHING(memo), 2, FACT, AT)
    row = report(made)[1]
    assert (row.memo_type, row.windows, row.reused_windows, row.missing_windows) == ("composed", 2, 0, 2)
    assert row.answer == "fact:doc-a:0\nfact:doc-a:2" and (row.initial_ratio, row.final_ratio) == (0.0, 1.0)
    assert sorted((r.scope_start, r.scope_end) for r in made.solved.collect()) == [(0, 2), (2, 4)]
    stored = made.composites()
    top = stored.collect()
    assert len(top) == 1 and len(top[0].dependencies) == 2 and top[0].reusable_as == [EX]
    known = made.solved.unionByName(stored)
    again = solve.solve_windows(asked, known, 2, FACT, AT)
    row = report(again)[1]
    assert (row.memo_type, row.windows) == ("exact", 0) and again.solved.count() == 0


def test_larger_fragment_covers_windows(memo):
    made = solve.solve_windows(memo.requests((1, 0, 6)), memo.entries((0, 4, AG)), 2, FACT, AT)
    row = report(made)[1]
    assert (row.reused_windows, row.missing_windows) == (2, 1)
    assert [(r.scope_start, r.scope_end) for r in made.solved.collect()] == [(4, 6)]
    assert row.answer == "r0-4\nfact:doc-a:4"


def test_gaps_call_the_solver_on_the_gap_only(memo):
    made = solve.solve_gaps(memo.requests((1, 0, 6)), memo.entries((0, 2, AG)), FACT, AT)
    assert [(r.scope_start, r.scope_end) for r in made.solved.collect()] == [(2, 6)]
    row = report(made)[1]
    assert (row.initial_ratio, row.final_ratio, row.memo_type) == (0.333333, 1.0, "composed")


def test_hints_from_a_solver_leave_the_answer_partial(memo):
    hinting = solve.python_solver(lambda s: {"result": "maybe", "reusable_as": [HI]})
    made = solve.solve_windows(memo.requests((1, 0, 4)), memo.entries((0, 2, AG)), 2, hinting, AT)
    row = report(made)[1]
    assert (row.memo_type, row.final_ratio) == ("partial", 0.5)
    assert made.composites().count() == 0


def test_not_found_becomes_a_covering_negative(memo):
    blind = solve.python_solver(lambda s: {"result": "", "not_found": True})
    made = solve.solve_windows(memo.requests((1, 0, 4)), memo.entries((0, 2, AG)), 2, blind, AT)
    new = made.solved.collect()[0]
    assert (new.result, new.result_type, new.reusable_as) == ("not_found", "not_found", [S.RULED_OUT])
    row = report(made)[1]
    assert (row.memo_type, row.final_ratio, row.answer) == ("composed", 1.0, "r0-2")
    assert len(made.composites().first()["dependencies"]) == 2


def test_same_scope_in_two_requests_is_solved_once(memo):
    made = solve.solve_windows(memo.requests((1, 0, 4), (2, 0, 4)), NOTHING(memo), 4, FACT, AT)
    assert made.solved.count() == 1
    assert {r.answer for r in made.report.collect()} == {"fact:doc-a:0"}


def test_mutable_workspace(memo):
    """Four chunks, one changes: 4 calls, 2 entries invalidated, 1 call, then a replay."""
    asked = memo.requests((1, 0, 4, {"hash": ""}))
    first = solve.solve_windows(asked, NOTHING(memo), 1, FACT, AT)
    assert first.solved.count() == 4
    known = first.solved.unionByName(first.composites()).checkpoint()
    changed = memo.requests((9, 1, 2, {"hash": ""}))
    second_solver = solve.python_solver(lambda s: f"new:{s['start']}")
    stale, second = solve.resolve_changes(asked, known, graph.depends_on(known), changed, 1, second_solver, AT)
    assert stale.count() == 2
    row = report(second)[1]
    assert (row.initial_ratio, row.reused_windows, row.missing_windows) == (0.75, 3, 1)
    live = known.join(stale, "entry_id", "left_anti").unionByName(second.solved).unionByName(second.composites())
    warm = solve.solve_windows(asked, live, 1, FACT, AT)
    assert warm.solved.count() == 0 and report(warm)[1].memo_type == "exact"


def test_reworded_task_reuses_only_with_consent(memo):
    known = memo.entries((0, 4, EX, {"prompt": "the Q1 ARR, find", "result": "12"}), (0, 3, EX, {"prompt": "find Q1 ARR", "result": "no"}))
    asked = memo.requests((1, 0, 4))
    assert [r.result for r in solve.semantic_reuse(asked, known).collect()] == ["12"]
    refuse = lambda pairs: pairs.withColumn("reuse_as", F.lit("different"))
    assert solve.semantic_reuse(asked, known, verifier=refuse).count() == 0
    accept = lambda pairs: pairs.withColumn("reuse_as", F.lit("Replay"))
    assert solve.semantic_reuse(asked, known, verifier=accept).count() == 1


def test_planner_answers_with_known_dependencies_only(memo):
    known = memo.entries((0, 2, AG, {"result": "x" * 900, "evidence": [("d", 0, 2, "chunk", "e" * 300)] * 4}))
    entry_id = known.first()["entry_id"]

    def decide(query, packets):
        assert len(packets) == 1 and len(packets[0]["result"]) == 800
        return {"action": "answer", "answer": "done", "used_entry_ids": [packets[0]["entry_id"], "unknown"], "confidence": 75}

    row = retrieval.answer_from_memo(memo.requests((1, 0, 4)), known, retrieval.python_planner(decide)).first()
    assert (row.memo_type, row.answer, row.dependencies, row.confidence) == ("memo_context_answer", "done", [entry_id], 0.75)
    assert len(row.evidence) == 3 and all(len(e.text) == 240 for e in row.evidence)


def test_packets_flag_truncation(memo):
    known = memo.entries((0, 2, AG, {"result": "a long enough result", "evidence": [("d", 0, 2, "chunk", "some evidence")]}))
    ranked = retrieval.ranked_entries(memo.requests((1, 0, 4)), known)
    cut = retrieval.packets(ranked, known, 12, 10).first()
    assert (cut.result, cut.result_truncated, cut.evidence[0].text_truncated) == ("a long enoug", True, True)
    whole = retrieval.packets(ranked, known, None, -1).first()
    assert (whole.result, whole.result_truncated, whole.evidence[0].text_truncated) == ("a long enough result", False, False)


def test_coverage_never_shrinks_when_entries_are_added(memo):
    asked = memo.requests((1, 0, 20))
    held = memo.entries((0, 3, AG), (10, 12, AG))
    more = held.unionByName(memo.entries((2, 11, AG)))
    before = plan_reuse(asked, held).telemetry.first()
    after = plan_reuse(asked, more).telemetry.first()
    assert before.covered_length + before.missing_length == 20 == after.covered_length + after.missing_length
    assert after.missing_length <= before.missing_length


def test_warm_run_needs_no_calls(memo, spark):
    from memograph.plans.runs import run_samples

    made = spark.createDataFrame(
        [(1, "qa", "8", "Where?", "a b c d e", ["doc:0"], "doc", ""), (2, "qa", "8", "Who?", "a", ["x"], "doc2", "")],
        "sample_id BIGINT, task STRING, length STRING, question STRING, context STRING, gold ARRAY<STRING>, document_id STRING, content_hash STRING",
    )
    solver = solve.python_solver(lambda s: f"{s['document_id']}:{s['start']}")
    cold, stored = run_samples(made, NOTHING(memo), solver, "c", 1, 2, AT)
    assert {r.sample_id: (r.delta_calls, r.from_cache, r.is_correct) for r in cold.collect()} == {1: (3, False, 1.0), 2: (1, False, 0.0)}
    warm, _ = run_samples(made, stored.checkpoint(), solver, "c", 1, 2, AT)
    assert {(r.delta_calls, r.from_cache, r.cache_type) for r in warm.collect()} == {(0, True, "exact")}


def test_solver_confidence_may_be_a_label_and_metadata_a_map(spark):
    from memograph.plans.solve import python_solver

    scopes = spark.createDataFrame([(1,), (2,), (3,)], "request_id BIGINT")
    answers = {1: {"result": "a", "confidence": "high", "metadata": {"k": 1}}, 2: {"result": "b", "confidence": "80%"}, 3: "c"}
    rows = {r.request_id: r for r in python_solver(lambda scope: answers[scope["request_id"]])(scopes).collect()}
    assert 0.5 < rows[1].confidence <= 1 and rows[1].metadata_json == '{"k": 1}'
    assert rows[2].confidence == 0.8 and rows[3].confidence == 1.0 and rows[3].metadata_json == "{}"


def test_window_states_count_every_position_once(memo):
    """Against sets of positions: nested, touching, repeated, long and far-off entries, windows across bins."""
    chance = random.Random(7)
    held = [(0, 2_000, AG, {"hash": "v2"}), (60, 70, AG), (60, 66, AG), (60, 70, AG, {"result": "again"}), (64, 130, AG), (300, 1_100, EX), (1_023, 1_025, AG), (5, 9, HI)]
    held += [(s, s + chance.choice([1, 2, 5, 40]), AG) for s in chance.sample(range(1_200, 1_500), 60)]
    asked = [(1, 3, 1_510), (2, 61, 190), (3, 1_000, 1_030), (4, 4_000, 4_007), (5, 5, 5)]
    covers = {p for s, e, mode, *o in held if mode != HI and not (o and "hash" in o[0]) for p in range(s, e)}
    for size in (4, 100):
        states = solve.window_states(solve.windows_of(memo.requests(*asked), size), memo.entries(*held)).collect()
        assert len(states) == sum(-(-(e - s) // size) for _, s, e in asked)
        for r in states:
            missing = sum(p not in covers for p in range(r.start, r.end))
            assert (r.missing_length, r.is_complete) == (missing, missing == 0), r
