"""Cases that only larger tables hold: queries against their SQL on small tables made for them, and operators by themselves."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from memograph.functions.embedding import hashed_embedding
from memograph.operators import folding, samples
from memograph.plans import retrieval, summarise
from memograph.plans.aggregate import aggregated
from tools.check_oracle import canon


def equals_sql(spark, folder, name, *tables):
    con = duckdb.connect()
    for table in tables:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    df = entry_points.queries()[name](spark, str(folder))
    result = con.execute(entry_points.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    rows = [tuple(r) for r in df.collect()]
    assert rows and canon(df.columns, rows) == canon(columns, result.fetchall())


@pytest.mark.parametrize("name", ["sample_normalize", "split_prompt"])
def test_system_turns_do_not_ask(spark, tmp_path, name):
    rows = [(1, 0, "system", "Be brief.\nWhen anan oueth"), (1, 1, "user", "Facts.\nWhat thened"), (1, 2, "assistant", "Facts.\nWhen thened"), (2, 0, "system", "One line?")]
    spark.createDataFrame(rows, "conv_id BIGINT, turn BIGINT, role STRING, text STRING").write.parquet(f"{tmp_path}/conversations.parquet")
    equals_sql(spark, tmp_path, name, "conversations")


def test_pieces_without_sentences_take_no_line(spark, tmp_path):
    text = "".join(f"word{i} and word{i % 9} meet here {i}. " for i in range(2_000))[:16_000]
    rows = [(1, text + "."), (2, text + "tail"), (3, text[:8_000] + "." * 4_000 + text[:8_000])]
    spark.createDataFrame(rows, "doc_id BIGINT, text STRING").write.parquet(f"{tmp_path}/documents.parquet")
    equals_sql(spark, tmp_path, "summarize_central", "documents")
    made = summarise.condense(spark.createDataFrame([(1, "!" * 20_000)], "doc_id BIGINT, text STRING"), "doc_id", "text", summarise.central_sentences())
    assert [(r.doc_id, r.summary) for r in made.collect()] == [(1, "")]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_text_is_cut_into_tokens_once_for_all_its_needles(spark):
    """Before, every placement cut the whole text and its context into words and gaps: more often the longer both are."""
    text = "\n".join(f"  line {i} of words\there" for i in range(30))
    case = spark.range(1).selectExpr(
        "'h' AS haystack", "'hash' AS haystack_hash", "'0001' AS exp_id", "'t' AS test_name", "'direct' AS question_type", "'NEEDLE' AS needle",
        "'Who?' AS retrieval_question", "array('x') AS gold_answers", "array() AS character_set", "'DECOY' AS distractor", "1L AS seed_offset",
    ).withColumn("character_set", F.col("character_set").cast("array<string>")).withColumn("text", F.lit(text))
    placed = samples.place_needles(case, [10, 1_000], 3, seed=1)
    plan = plan_of(placed)
    assert plan.count("regexp_extract_all") <= 3 and not re.search(r"split\([^,]*, \\S\+", plan)
    for row in placed.collect():
        assert "NEEDLE" in row.context and row.context.count("DECOY") == 1


def test_folds_send_many_stretches_to_python_at_once(spark):
    """Ties are in order, stretches go on from batch to batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        df = spark.range(600).selectExpr("id % 5 AS k", "id div 10 AS p", "format_string('%03d', 600 - id) AS tie", "CAST(id AS STRING) AS t")
        seen = folding.fold_in_pandas(
            df, "k", "p", lambda rows: rows.iloc[[0]].assign(t="+".join(rows["t"])), "k BIGINT, p BIGINT, tie STRING, t STRING", fan_in=16, ties=["tie"]
        )
        made = {r.k: r.t for r in seen.collect()}
        assert "FlatMapGroups" not in plan_of(seen)
        for k in range(5):
            mine = sorted((i for i in range(600) if i % 5 == k), key=lambda i: (i // 10, 600 - i))
            assert made[k] == "+".join(map(str, mine))
        rows = [(r, False, i, i + 1, f"e{i:03}", "q", str(i), 1.0) for r in range(20) for i in range(1 + r * 3 % 11)]
        pieces = spark.createDataFrame(rows, "request_id BIGINT, negative BOOLEAN, scope_start BIGINT, scope_end BIGINT, entry_id STRING, query STRING, result STRING, confidence DOUBLE")
        made = {r.request_id: r.result for r in aggregated(pieces, lambda q, given: "+".join(p["result"] for p in given), fan_in=4).collect()}
        assert made == {r: "+".join(map(str, range(1 + r * 3 % 11))) for r in range(20)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_hashed_embeddings_read_the_tokens_once(spark):
    """Before, every one of the dimensions filtered all tokens of the text twice."""
    df = spark.createDataFrame([(1, "alpha beta beta"), (2, ""), (3, None)], "id BIGINT, t STRING").select("id", hashed_embedding(F.col("t"), 16).alias("e"))
    assert plan_of(df).count("filter(") <= 1
    made = {r.id: r.e for r in df.collect()}
    assert sorted(abs(x) for x in made[1] if x) in ([pytest.approx(1 / 5**0.5), pytest.approx(2 / 5**0.5)], [pytest.approx(1.0)])
    assert made[2] == made[3] == [0.0] * 16


def test_terms_of_entries_are_not_shuffled_with_their_pairs(spark, memo):
    """Before, pairs met the requests a second time to get their prompts, and took the terms of all entries along."""
    entries = memo.entries((0, 2, "aggregation_component"), (2, 4, "aggregation_component", {"result": "Q1 ARR found"}))
    ranked = retrieval.ranked_entries(memo.requests((1, 0, 4)), entries)
    assert len(re.findall(r"Join (Inner|LeftOuter)", plan_of(ranked))) <= 1 + plan_of(entries).count("Join ")
    assert [r["rank"] for r in ranked.collect()] == [1, 2]
