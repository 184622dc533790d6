"""Answers by a callback: what it is given, what its outcome means, and requests of many pieces."""

import pytest

from memograph import schema as S
from memograph.plans.aggregate import aggregated
from memograph.plans.solve import python_solver, solve_gaps, solve_windows

PIECES = "request_id BIGINT, negative BOOLEAN, scope_start BIGINT, scope_end BIGINT, entry_id STRING, query STRING, result STRING, confidence DOUBLE"
WHEN = "2024-01-01T00:00:00Z"


def pieces(spark, sizes):
    rows = [(r, i % 7 == 6, i // 3, i // 3 + 1, f"e{r}-{i:04}", f"q{r}", str(i), 0.5 + (i % 2) / 4) for r, n in enumerate(sizes) for i in range(n)]
    return spark.createDataFrame(rows, PIECES).repartition(3), rows


def in_order(rows, request):
    return [r[4] for r in sorted((r for r in rows if r[0] == request), key=lambda r: (r[1], r[2], r[3], r[4]))]


@pytest.mark.parametrize("fan_in", [4, 256])
def test_pieces_come_in_order_and_a_large_request_is_a_tree(spark, fan_in):
    frame, rows = pieces(spark, [70, 1, 4, 5])

    def joined(query, given):
        assert len(given) <= fan_in and query.startswith("q")
        return {"result": "+".join(p["result"] for p in given), "confidence": min(p["confidence"] for p in given), "used_entry_ids": [i for p in given for i in p["used"]]}

    made = {r["request_id"]: r for r in aggregated(frame, joined, fan_in).collect()}
    assert set(made) == {0, 1, 2, 3}
    for request, row in made.items():
        ids = in_order(rows, request)
        assert row["used"] == ids and row["result"] == "+".join(str(int(i.split("-")[1])) for i in ids) and row["confidence"] == 0.5


def test_outcomes(spark):
    frame, rows = pieces(spark, [9, 9, 9])

    def choose(query, given):
        if query == "q0":
            return "plain text"
        if query == "q1":
            return {"result": "some", "confidence": "85%", "used_entry_ids": ["e1-0003", "unknown", "e1-0001"], "metadata": {"b": 1, "a": "é"}}
        return {"result": "none", "used_entry_ids": [], "evidence": [{"document_id": "d", "start": 1, "end": 2, "unit": "chunk", "text": "seen"}]}

    made = {r["request_id"]: r for r in aggregated(frame, choose).collect()}
    assert (made[0]["result"], made[0]["confidence"], made[0]["used"]) == ("plain text", 1.0, in_order(rows, 0))
    assert (made[1]["result"], made[1]["confidence"], made[1]["used"], made[1]["metadata_json"]) == ("some", 0.85, ["e1-0001", "e1-0003"], '{"a":"é","b":1}')
    assert made[2]["used"] == in_order(rows, 2) and made[2]["evidence"][0]["text"] == "seen"
    assert aggregated(frame.limit(0), choose).count() == 0


@pytest.mark.parametrize("solve", [solve_windows, solve_gaps])
def test_composites_carry_what_the_callback_used(spark, memo, solve):
    entries = memo.entries((0, 2, S.AGGREGATION_COMPONENT, {"evidence": [("doc-a", 0, 1, "chunk", "text zero")]}), (2, 4, S.RULED_OUT))
    requests = memo.requests((1, 0, 6), (2, 0, 2, {"prompt": "another"}))

    def pick(query, given):
        kinds = [p["negative"] for p in given]
        assert kinds == sorted(kinds)
        return {"result": f"{query}: {len(given)} pieces", "confidence": "high", "used_entry_ids": [i for p in given if p["result"] == "r0-2" for i in p["used"]]}

    size = (2,) if solve is solve_windows else ()
    run = solve(requests, entries, *size, python_solver(lambda scope: f"new {scope['start']}"), WHEN, pick)
    report = {r["request_id"]: r for r in run.report.collect()}
    assert report[1]["answer"].endswith("3 pieces") and report[2]["answer"] == "another: 1 pieces"
    stored = {r["scope_end"]: r for r in run.composites().collect()}
    known = {r["scope_start"]: r["entry_id"] for r in entries.collect()}
    assert stored[6]["dependencies"] == [known[0]] and stored[6]["confidence"] == 0.9
    assert [e["text"] for e in stored[6]["evidence"]] == ["text zero"]
    assert len(stored[2]["dependencies"]) == 1 and stored[2]["dependencies"] != [known[0]]
