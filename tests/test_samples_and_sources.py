import json

import pytest
from pyspark.sql import functions as F

from memograph.operators import reports, samples
from memograph.sources import files


def haystack(spark, text):
    return spark.createDataFrame([("book", 0, "h", text)], "haystack STRING, haystack_no BIGINT, haystack_hash STRING, text STRING")


def case(df, needle="NEEDLE", characters=(), distractor=None):
    return df.withColumns(
        {
            "exp_id": F.lit("0001"), "test_name": F.lit("t"), "question_type": F.lit("direct"), "needle": F.lit(needle),
            "retrieval_question": F.lit("where?"), "gold_answers": F.array(F.lit("g")),
            "character_set": F.array(*map(F.lit, characters)).cast("array<string>"),
            "distractor": F.lit(distractor).cast("string"), "seed_offset": F.lit(1),
        }
    )


def test_needle_goes_to_a_line_start_at_each_depth(spark):
    text = "\n".join(f"a{i} b{i} c{i} d{i}" for i in range(50))
    rows = samples.place_needles(case(haystack(spark, text)), [40], 3, seed=1).orderBy("depth_index").collect()
    assert [r.depth_percent for r in rows] == [0.0, 50.0, 100.0]
    assert rows[0].context.startswith("NEEDLE\na0")
    for r in rows:
        lines = r.context.split("\n")
        assert lines.count("NEEDLE") + sum(line.endswith(" NEEDLE") or line == " NEEDLE" for line in lines) >= 1
    assert [len(r.context.split()) for r in rows[:2]] == [41, 41]
    assert rows[1].token_depth == 20
    # The deepest anchor lies past the cut, so the unfinished last line before it is dropped.
    assert rows[2].context.endswith("d9\n NEEDLE")


def test_draws_are_repeatable_and_distractors_stay_away(spark):
    text = "\n".join(f"w{i} x y z" for i in range(80))
    df = case(haystack(spark, text), "It was {CHAR}.", ["Ada", "Bo", "Cy"], "DECOY")
    first = samples.place_needles(df, [60, 100], 5, seed=7).orderBy("sample_id").collect()
    again = samples.place_needles(df.repartition(3), [60, 100], 5, seed=7).orderBy("sample_id").collect()
    assert first == again and len(first) == 10
    for r in first:
        assert r.selected_character in ("Ada", "Bo", "Cy") and r.gold_answers == [r.selected_character]
        assert "DECOY" in r.context and abs(r.distractor_depth - r.depth_percent / 100) >= 0.2 - 1e-6


def test_unknown_character_set_is_an_error(spark):
    with pytest.raises(Exception, match="character set"):
        samples.place_needles(case(haystack(spark, "a\nb"), "{CHAR}"), [10], 1, seed=1).collect()


def test_case_expansion(spark, tmp_path):
    raw = [
        {"id": "0002", "system_prompt": "", "needle": "Fixed by {1}.", "questions": {"direct": "Who fixed {2}?"},
         "tests": {"01": {"input_args": ["Marta", "it"], "gold_answers": ["Marta"]}}},
        {"id": "x", "needle": "", "questions": {"direct": "?"}, "tests": {"01": {"input_args": []}}},
    ]
    df = spark.createDataFrame([(json.dumps(raw),)], "j STRING").select(
        F.inline(F.from_json("j", f"ARRAY<STRUCT<{samples.EXPERIMENT}>>"))
    )
    rows = samples.expand_cases(df).collect()
    assert [(r.test_name, r.needle, r.retrieval_question, r.gold_answers, r.seed_offset) for r in rows] == [
        ("0002_01_direct", "Fixed by Marta.", "Who fixed it?", ["Marta"], 2)
    ]


def test_workload_numbers(spark):
    columns = samples.workload(F.lit(128000), F.lit(24), 1000, 2, 32000)
    row = spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()
    assert (row.chunks_per_sample, row.windows_per_sample, row.calls_per_cold_sample) == (128, 64, 65)
    assert (row.calls_cold_total, row.window_multiple, row.exceeds_window) == (1560, 4.0, True)


def test_duplicates_raise(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",)], "id STRING")
    with pytest.raises(ValueError):
        samples.require_unique(df)
    assert samples.require_unique(df.distinct()).count() == 2


def test_text_folder(spark, tmp_path):
    (tmp_path / "b.txt").write_bytes("  café \n".encode() + b"\xff ok ")
    (tmp_path / "a.txt").write_text("   \n")
    (tmp_path / "c.md").write_text("no")
    rows = files.read_text_dir(spark, str(tmp_path)).collect()
    assert [(r.filename, r.text) for r in rows] == [("b.txt", "café \n ok")]


def test_records_from_jsonl_lists_and_containers(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "a.jsonl").write_text('{"id": "1"}\n\n{"id": "2"}\n')
    (tmp_path / "d" / "b.json").write_text('{"samples": [{"id": "3"}, {"id": "4"}]}')
    (tmp_path / "c.json").write_text('[{"id": "5"}]')
    (tmp_path / "e.json").write_text('{\n"id": "6"}')
    rows = files.read_records(spark, str(tmp_path), "id STRING").collect()
    assert sorted(r.id for r in rows) == ["1", "2", "3", "4", "5", "6"]
    assert all(r.source_file for r in rows)
    assert files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "id STRING").count() == 2


def test_manifests(spark, tmp_path):
    for name, samples_run in (("r1", 1), ("r2", 2)):
        (tmp_path / name).mkdir()
        body = {"benchmark": "b", "totals": {"questions": samples_run, "exact_replays": 3}, "memo_stats": {"entry_count": 9, "by_fragment_kind": {"hint": 2}}}
        (tmp_path / name / "manifest.json").write_text(json.dumps(body, indent=1))
    found = files.resolve_manifests(spark, str(tmp_path))
    row = reports.summarize_manifests(found).first()
    assert row.manifest.endswith("r2/manifest.json") and (row.samples, row.memo_entries, row.exact_replay_checks) == (2, 9, 3)
    compact = json.loads(reports.without_nulls(reports.summarize_manifests(found)).first()["row"])
    assert "model" not in compact and compact["fragment_mix"] == {"hint": 2}


def test_manifest_and_jsonl_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", 1)], "benchmark STRING, n INT")
    files.write_manifest(df, spark, str(tmp_path / "m"))
    text = spark.read.text(str(tmp_path / "m")).first()["value"]
    assert json.loads(text) == {"benchmark": "b", "n": 1}
    files.write_jsonl(df, str(tmp_path / "p"))
    assert files.read_jsonl(spark, str(tmp_path / "p"), "benchmark STRING, n INT").first()["n"] == 1
    with pytest.raises(ValueError):
        files.write_manifest(df.unionByName(df), spark, str(tmp_path / "x"))


def test_malformed_records_are_errors_and_empty_containers_count(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1"}\n{"id": \n')
    with pytest.raises(Exception):
        files.read_records(spark, str(tmp_path), "id STRING").collect()
    (tmp_path / "a.jsonl").write_text('{"id": "1"}\n')
    (tmp_path / "b.json").write_text('{"samples": [], "data": [{"id": "2"}]}')
    assert [r.id for r in files.read_records(spark, str(tmp_path), "id STRING").collect()] == ["1"]


def test_only_manifests_are_manifests(spark, tmp_path):
    (tmp_path / "run").mkdir()
    (tmp_path / "predictions.json").write_text("{}")
    (tmp_path / "run" / "manifest.json").write_text('{"a": 1}')
    assert [r.body for r in files.resolve_manifests(spark, str(tmp_path)).collect()] == ['{"a": 1}']


def test_streams_read_tables_of_one_or_many_files(spark, tmp_path):
    from memograph.streaming import ingest

    spark.range(20).repartition(4).write.parquet(f"{tmp_path}/many.parquet")
    for name in ("many",):
        target = f"{tmp_path}/out_{name}"
        stream = ingest.stream_table(spark, str(tmp_path), name).writeStream.option("checkpointLocation", f"{tmp_path}/c_{name}")
        stream.trigger(availableNow=True).format("parquet").start(target).awaitTermination()
        assert spark.read.parquet(target).count() == 20
