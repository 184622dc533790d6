"""Equivalent tasks: judged once per store, adopted with their source, never without consent."""

from pyspark.sql import functions as F

from memograph import schema as S
from memograph.operators import matching
from memograph.plans.solve import python_solver, solve_windows
from memograph.plans.verified import Verdicts, solve_verified

WHEN = "2024-01-01T00:00:00Z"
SOLVER = python_solver(lambda scope: f"new:{scope['start']}")


def verifier(spark, says):
    """Says the same of every pair, and counts the pairs it is asked about."""
    calls = spark.sparkContext.accumulator(0)

    def judge(pairs):
        def run(batches):
            for batch in batches:
                calls.add(len(batch))
                yield batch.assign(reuse_as=says, confidence="high", reason="same words")

        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema)
        return pairs.mapInPandas(run, f"{fields}, reuse_as STRING, confidence STRING, reason STRING")

    return judge, calls


def many(memo):
    """One reworded task with answers for six documents, and a request for each of them and for one more."""
    rows = [(0, 4, S.EXACT_ANSWER, {"prompt": "the Q1 ARR, find", "document": f"d{i}", "result": f"r{i}", "evidence": [(f"d{i}", 0, 1, "chunk", "seen")]}) for i in range(6)]
    return memo.entries(*rows), memo.requests(*[(i, 0, 4, {"document": f"d{i}"}) for i in range(7)])


def test_a_pair_is_asked_once(spark, memo, tmp_path):
    entries, requests = many(memo)
    verdicts, (judge, calls) = Verdicts(spark, str(tmp_path)), verifier(spark, "Replay")
    first = solve_verified(requests, entries, 2, SOLVER, WHEN, judge, verdicts, "a")
    assert first.calls == calls.value == 1
    report = {r["request_id"]: r for r in first.report.collect()}
    assert {i: r["memo_type"] for i, r in report.items()} == {**dict.fromkeys(range(6), "semantic_exact"), 6: "composed"}
    assert all(report[i]["answer"] == f"r{i}" and (report[i]["initial_ratio"], report[i]["final_ratio"]) == (0.0, 1.0) for i in range(6))
    again = solve_verified(requests, entries, 2, SOLVER, WHEN, judge, verdicts, "b")
    assert again.calls == 0 and calls.value == 1 and sorted(map(tuple, again.report.collect())) == sorted(map(tuple, report.values()))


def test_adopted_entries_rest_on_their_source_and_replay(spark, memo, tmp_path):
    entries, requests = many(memo)
    done = solve_verified(requests, entries, 2, SOLVER, WHEN, verifier(spark, "exact")[0], Verdicts(spark, str(tmp_path)), "a")
    sources = {r["document_id"]: r["entry_id"] for r in entries.collect()}
    adopted = {r["document_id"]: r for r in done.adopted.collect()}
    assert len(adopted) == 6 and done.rest.solved.select("document_id").distinct().count() == 1
    for document, row in adopted.items():
        assert row["dependencies"] == [sources[document]] and row["confidence"] == 0.9 and row["evidence"][0]["text"] == "seen"
        assert '"verifier_reason":"same words"' in row["metadata_json"] and row["reusable_as"] == [S.EXACT_ANSWER]
    replayed = solve_windows(requests.filter("document_id <> 'd6'"), entries.unionByName(done.adopted), 2, SOLVER, WHEN).report.collect()
    assert {r["memo_type"] for r in replayed} == {"exact"}


def test_refusals_are_kept_and_other_scopes_do_not_count(spark, memo, tmp_path):
    entries, requests = many(memo)
    verdicts, (judge, calls) = Verdicts(spark, str(tmp_path)), verifier(spark, "different")
    for batch in ("a", "b"):
        done = solve_verified(requests, entries, 2, SOLVER, WHEN, judge, verdicts, batch)
        assert {r["memo_type"] for r in done.report.collect()} == {"composed"} and done.adopted.count() == 0
    assert calls.value == 1
    judge, calls = verifier(spark, "exact")
    elsewhere = memo.requests((1, 0, 3, {"document": "d1"}), (2, 0, 4, {"document": "d2", "hash": "v9"}))
    done = solve_verified(elsewhere, entries, 2, SOLVER, WHEN, judge, Verdicts(spark, str(tmp_path / "other")), "a")
    assert done.calls == calls.value == 0 and done.adopted.count() == 0
    none = solve_verified(elsewhere.filter(F.lit(False)), entries, 2, SOLVER, WHEN, judge, Verdicts(spark, str(tmp_path / "third")), "a")
    assert none.report.count() == 0


def test_replays_are_looked_for_once(spark, memo, tmp_path, monkeypatch):
    """One plan serves the pairs and the windows; a second look is at the new entries only."""
    entries, requests = many(memo)
    looked, look = [], matching.exact_replays
    monkeypatch.setattr(matching, "exact_replays", lambda asked, known: looked.append(known is entries) or look(asked, known))
    done = solve_verified(requests, entries, 2, SOLVER, WHEN, verifier(spark, "exact")[0], Verdicts(spark, str(tmp_path)), "a")
    assert done.report.count() == 7 and looked == [True, False]
