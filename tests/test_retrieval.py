import numpy as np
from pyspark.sql import functions as F

from memograph import schema as S
from memograph.operators import folding, ranking
from memograph.plans import cache as caching
from memograph.plans import summarise


def test_chunk_search_finds_the_backup_channel(spark):
    rows = [("c", "d", i, "chunk", "", t, "{}") for i, t in enumerate(["The launch codeword is ORCHID-57.", "The backup contact channel is north-bridge-9."])]
    hits = ranking.search_chunks(spark.createDataFrame(rows, S.CONTEXT_CHUNKS), ["Which backup channel should launch use?"]).orderBy("rank").collect()
    assert hits[0].chunk_index == 1 and "backup" in hits[0].matched_terms


def test_underscore_is_a_wildcard_for_the_score_only(spark):
    df = spark.createDataFrame([("north bridge",)], "t STRING").select(
        ranking.like_hits(F.col("t"), F.array(F.lit("north_bridge"), F.lit("north"), F.lit("north"))).alias("n")
    )
    assert df.first()["n"] == 3


def test_nearest_is_exact_in_one_pass_and_in_many(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(200, 8)).astype("float32")
    vectors[50] = vectors[7]  # a tie, broken by id
    queries = rng.normal(size=(9, 8)).astype("float32")
    queries[0] = vectors[7]
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(vectors)], "vec_id BIGINT, embedding ARRAY<FLOAT>").repartition(5)
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(queries)], "query_id BIGINT, embedding ARRAY<FLOAT>")
    scores = np.round(queries.astype("float64") @ vectors.astype("float64").T, 6)
    expected = {(i, int(j)) for i in range(9) for j in np.lexsort((np.arange(200), -scores[i]))[:6]}
    for per_pass in (2048, 2):
        found = ranking.nearest(q, v, "query_id", "vec_id", 6, per_block=per_pass).collect()
        assert {(r.query_id, r.vec_id) for r in found} == expected
    more = ranking.nearest(q, v, "query_id", "vec_id", 500)
    assert more.count() == 9 * 200


def test_rerank_cuts_to_top_before_the_gate(spark):
    rows = [(1, i, "alpha beta", text) for i, text in enumerate(["alpha", "alpha beta", "none", "beta alpha x"])]
    df = spark.createDataFrame(rows, "q BIGINT, id BIGINT, query STRING, text STRING")
    kept = ranking.rerank(df, "q", "query", "text", "id", top=3, threshold=0.6).collect()
    assert sorted(r.id for r in kept) == [1, 3]


def test_cache_lookup_exact_semantic_and_miss(spark):
    cache = spark.createDataFrame(
        [(1, "What is the total of order 5?", "12%", "12%", "h", ""), (2, "what is the total of order 5? ", "later", "", "h", ""), (3, "Who signed?", "x", "", "g", "")],
        "cache_id BIGINT, query STRING, result STRING, source_context STRING, chunk_hash STRING, data_scope_hash STRING",
    )
    lookups = spark.createDataFrame(
        [(10, " WHAT is the total of order 5?", "h"), (11, "order 5 total", "h"), (12, "Who signed?", "h"), (13, "Who signed?", "g")],
        "lookup_id BIGINT, query STRING, chunk_hash STRING",
    )
    found = {r.lookup_id: (r.outcome, r.cache_id) for r in caching.lookup(lookups, cache).collect()}
    assert found == {10: ("exact", 1), 11: ("semantic", 1), 12: ("miss", None), 13: ("exact", 3)}


def test_summaries_repeat_until_they_fit(spark):
    df = spark.createDataFrame([(1, "a" * 20_000), (2, "b" * 10), (3, "c" * 4_000_000)], "id BIGINT, text STRING")
    done = {r.id: r for r in summarise.condense(df, "id", "text", summarise.leading_text()).collect()}
    assert done[2].levels == 0 and done[2].summary == "b" * 10
    assert done[1].levels == 1 and done[1].summary == "\n".join(["a" * 200] * 5)
    assert done[3].levels == 2
    stuck = summarise.condense(df, "id", "text", lambda p: p.withColumn("summary", F.col("text")))
    last = {r.id: r for r in stuck.collect()}
    assert last[1].levels == 5 and len(last[1].summary) == 16_000


def test_ordered_text_spans_many_segments(spark):
    df = spark.range(3000).select(F.lit("k").alias("k"), F.col("id").alias("p"))
    text = folding.ordered_text(df, ["k"], ["p"], F.col("p").cast("string"), "t", ",").first()["t"]
    assert text == ",".join(map(str, range(3000)))


def test_fold_in_pandas_keeps_order_over_levels(spark):
    df = spark.range(700).repartition(6).select(F.lit(1).cast("bigint").alias("k"), F.col("id").alias("p"), F.col("id").cast("string").alias("t"))

    def partial(rows):
        head = rows.iloc[[0]].copy()
        head["t"] = ",".join(rows["t"])
        return head

    rows = folding.fold_in_pandas(df, "k", "p", partial, "k BIGINT, p BIGINT, t STRING", fan_in=8).collect()
    assert [r.t for r in rows] == [",".join(map(str, range(700)))]


def test_row_index_and_offsets(spark):
    df = spark.range(1000).select((F.lit(999) - F.col("id")).alias("k")).repartition(7)
    rows = folding.with_row_index(df, ["k"], "n").collect()
    assert all(r.k == r.n for r in rows) and len(rows) == 1000


def test_signature_depends_on_content_and_multiplicity_only(spark):
    def sign(values):
        df = spark.createDataFrame([(v,) for v in values], "v STRING")
        return folding.content_signature(df, [], F.col("v")).first()["signature"]

    assert sign("abc") == sign("cab")
    assert sign("abc") != sign("abcc") != sign("abbc")


def test_judge_accepts_the_first_candidate_it_likes(spark):
    cache = spark.createDataFrame(
        [(1, "total of order five", "a", "", "h", ""), (2, "order five total now", "b", "", "h", "")],
        "cache_id BIGINT, query STRING, result STRING, source_context STRING, chunk_hash STRING, data_scope_hash STRING",
    )
    lookups = spark.createDataFrame([(10, "order five total", "h")], "lookup_id BIGINT, query STRING, chunk_hash STRING")
    second = caching.lookup(lookups, cache, 0.5, judge=lambda c: c.withColumn("hit", F.col("plain").endswith("now"))).first()
    assert (second.outcome, second.cache_id) == ("semantic", 2)
    none = caching.lookup(lookups, cache, 0.5, judge=lambda c: c.withColumn("hit", F.lit(False))).first()
    assert none.outcome == "miss"


def test_embeddings_are_unit_vectors(spark):
    from memograph.functions.embedding import hashed_embedding, model_embedding

    df = spark.createDataFrame([("north bridge channel",), ("channel north bridge",), ("",)], "t STRING")
    rows = [r.e for r in df.select(hashed_embedding(F.col("t"), 16).alias("e")).collect()]
    assert rows[0] == rows[1] and abs(sum(x * x for x in rows[0]) - 1) < 1e-6 and not any(rows[2])
    encode = model_embedding(lambda texts: np.array([[len(t), 1.0] for t in texts]), batch=2)
    for r in df.select(encode(F.col("t")).alias("e")).collect():
        assert abs(sum(x * x for x in r.e) - 1) < 1e-5


def test_answers_stay_in_their_data_scope(memo, spark):
    cache = spark.createDataFrame(
        [(1, "who signed", "of a", "", "h", "a"), (2, "who signed", "of none", "", "h", ""), (3, "who paid", "of b", "", "h", "b")],
        "cache_id BIGINT, query STRING, result STRING, source_context STRING, chunk_hash STRING, data_scope_hash STRING",
    )
    lookups = spark.createDataFrame([(10, "who signed", "h"), (11, "who paid", "h")], "lookup_id BIGINT, query STRING, chunk_hash STRING")
    outcomes = {s: {r.lookup_id: r.cache_id for r in caching.lookup(lookups, cache, active_scope=s).collect()} for s in ("a", "b", "c", None)}
    assert outcomes == {"a": {10: 1, 11: None}, "b": {10: None, 11: 3}, "c": {10: None, 11: None}, None: {10: 1, 11: 3}}
    empty = memo.entries((0, 1, "exact_answer")).filter("false")
    assert [r.result for r in caching.migrate_cache(cache, empty, "2024-01-01T00:00:00Z", active_scope="b").collect()] == ["of b"]
