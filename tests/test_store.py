import pytest
from pyspark.sql import functions as F

from memograph import schema as S
from memograph.operators import graph
from memograph.sources.tables import KEYS, MemoTables, dependency_edges, newest, upsert

AG, EX = S.AGGREGATION_COMPONENT, S.EXACT_ANSWER


def test_newest_batch_wins_and_revives_a_rejected_entry(memo, spark, tmp_path):
    tables = MemoTables(spark, str(tmp_path / "m"), "finance")
    first = memo.entries((0, 2, AG), (2, 4, AG))
    tables.add_entries(first, 1)
    stale = first.filter("scope_start = 0").select("entry_id")
    tables.add_entries(graph.reject(first, stale, "edited", "t").join(stale, "entry_id", "left_semi"), 2)
    assert {r.scope_start: r.verifier_status for r in tables.read("memo_entries").collect()} == {0: "rejected", 2: "not_required"}
    tables.add_entries(first.filter("scope_start = 0"), 3)
    tables.add_entries(first.filter("scope_start = 0"), 3)  # a repeated batch changes nothing
    assert tables.read("memo_entries").filter("verifier_status = 'rejected'").count() == 0
    assert tables.history("memo_entries").count() == 4


def test_folder_of_another_corpus_is_refused(spark, tmp_path):
    MemoTables(spark, str(tmp_path / "m"), "one")
    MemoTables(spark, str(tmp_path / "m"), "one")
    with pytest.raises(ValueError):
        MemoTables(spark, str(tmp_path / "m"), "two")


def test_edges_follow_the_current_dependencies(memo, spark, tmp_path):
    tables = MemoTables(spark, str(tmp_path / "m"))
    assert tables.read("memo_entries").count() == 0
    tables.add_entries(memo.entries((0, 4, EX, {"dependencies": ["a", "b"]})), 1)
    assert {r.child_entry_id for r in tables.edges().collect()} == {"a", "b"}


def test_upserted_parents_rewrite_their_edges(memo):
    old = memo.entries((0, 4, EX, {"dependencies": ["a", "b"]}))
    edges = graph.depends_on(old)
    again = old.withColumn("dependencies", F.array(F.lit("c")))
    assert {r.child_entry_id for r in dependency_edges(old, edges, again).collect()} == {"c"}


def test_upsert_on_a_hot_key(spark):
    old = spark.range(2000).select(F.lit("x").alias("k"), F.col("id").alias("v"))
    new = spark.createDataFrame([("x", -1), ("y", -2)], "k STRING, v BIGINT")
    assert sorted(map(tuple, upsert(old, new, ["k"]).collect())) == [("x", -1), ("y", -2)]
    assert newest(old.withColumn("b", F.col("v")), ["k"], "b").first()["v"] == 1999


def test_chunks_are_keyed_by_five_columns(spark, tmp_path):
    tables = MemoTables(spark, str(tmp_path / "m"))
    rows = [("c", "d", i, "chunk", "v1", text, "{}") for i, text in enumerate(["The launch codeword is ORCHID-57.", "The backup contact channel is north-bridge-9."])]
    chunks = spark.createDataFrame(rows, S.CONTEXT_CHUNKS)
    tables.append("context_chunks", chunks, 0)
    tables.append("context_chunks", chunks.withColumn("text", F.upper("text")).filter("chunk_index = 1"), 1)
    stored = {r.chunk_index: r.text for r in tables.read("context_chunks").collect()}
    assert stored[0].startswith("The launch") and stored[1].startswith("THE BACKUP")
    assert len(KEYS["context_chunks"]) == 5
    tables.compact("context_chunks", str(tmp_path / "n"))
    assert MemoTables(spark, str(tmp_path / "n")).read("context_chunks").count() == 2


def test_writers_share_one_sequence_of_commits(memo, spark, tmp_path):
    tables = MemoTables(spark, str(tmp_path / "m"))
    assert [tables.commit("memo_entries", w, b) for w, b in (("entries", 0), ("changes", 0), ("entries", 1), ("changes", 0))] == [1, 2, 3, 2]
