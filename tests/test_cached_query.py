"""Questions through the cache: executed once, stored in all tables or in none."""

import pytest
from pyspark.sql import functions as F

from memograph.plans.cached import CacheStore, cached_query

WHEN = "2024-01-01T00:00:00Z"
LOOKUPS = "lookup_id BIGINT, query STRING, context STRING"


class Model:
    """Counts the questions that are sent to it, over all tasks."""

    def __init__(self, spark, answer="total is $5.0M | of | the ledger"):
        self.calls, self.answer = spark.sparkContext.accumulator(0), answer

    def __call__(self, asked):
        calls, answer = self.calls, self.answer

        def run(batches):
            for batch in batches:
                calls.add(len(batch))
                yield batch.assign(result=[f"{q}: {answer}" for q in batch["query"]])

        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asked.schema)
        return asked.mapInPandas(run, f"{fields}, result STRING")


def run(spark, store, rows, model, batch, **options):
    report = cached_query(spark.createDataFrame(rows, LOOKUPS), store, model, batch, WHEN, **options)
    return {r["lookup_id"]: r for r in report.collect()}


ROWS = [
    (1, "Find the total", "ledger one $5.0M"), (2, "  find the TOTAL ", "ledger one $5.0M "), (3, "Find the total", "another ledger"), (4, None, None),
    (5, "Explain the sum of order twelve", "ledger one $5.0M"),
]


def test_a_second_run_executes_nothing(spark, tmp_path):
    store, model = CacheStore(spark, str(tmp_path)), Model(spark)
    first = run(spark, store, ROWS, model, "a")
    assert model.calls.value == 4 and sum(r["executed"] for r in first.values()) == 4
    assert {i: r["outcome"] for i, r in first.items()} == dict.fromkeys(range(1, 6), "miss") and not any(r["from_cache"] for r in first.values())
    assert first[1]["result"] == first[2]["result"] and not first[2]["executed"] and first[1]["cache_id"] == first[2]["cache_id"] == "a:1"
    assert (first[1]["model"], first[5]["model"], first[1]["consensus"], first[1]["grounding"], first[3]["grounding"]) == ("small", "large", "AGREED", "GROUNDED", "INFERRED")
    second = run(spark, store, [*ROWS, (9, "order twelve: explain its sum", "ledger one $5.0M")], model, "b")
    assert model.calls.value == 4 and {i: r["outcome"] for i, r in second.items()} == {**dict.fromkeys(range(1, 6), "exact"), 9: "semantic"}
    assert all(second[i]["result"] == first[i]["result"] for i in first) and second[9]["result"] == first[5]["result"]
    # A repeated batch is answered by what it stored.
    assert all(r["from_cache"] for r in run(spark, store, ROWS, model, "a").values()) and model.calls.value == 4


def test_one_commit_over_four_tables(spark, tmp_path):
    store = CacheStore(spark, str(tmp_path))
    run(spark, store, ROWS[:3], Model(spark), "a")
    assert {t: store.table(t).count() for t in ("cache", "facts", "memo_entries", "vectors")} == {"cache": 2, "facts": 2, "memo_entries": 2, "vectors": 4}
    vectors = store.table("vectors").groupBy("kind").agg(F.count("*"), F.min(F.size("embedding"))).collect()
    assert {tuple(r) for r in vectors} == {("query", 2, 64), ("fact", 2, 64)}
    assert {r["of"] for r in store.table("facts").select(F.col("relation").alias("of")).collect()} == {"of"}


@pytest.mark.parametrize("broken", ["facts", "memo_entries", "vectors"])
def test_a_batch_that_breaks_is_seen_in_no_table(spark, tmp_path, monkeypatch, broken):
    store, model = CacheStore(spark, str(tmp_path)), Model(spark)
    run(spark, store, ROWS[2:3], model, "a")
    write = store.batches.write

    def failing(commit, table, *rest):
        if table == broken:
            raise OSError("lost")
        write(commit, table, *rest)

    monkeypatch.setattr(store.batches, "write", failing)
    with pytest.raises(OSError):
        run(spark, store, ROWS, model, "b")
    assert {t: store.table(t).count() for t in ("cache", "facts", "memo_entries", "vectors")} == {"cache": 1, "facts": 1, "memo_entries": 1, "vectors": 2}
    monkeypatch.setattr(store.batches, "write", write)
    again = run(spark, store, ROWS, model, "b")
    assert again[3]["outcome"] == "exact" and again[1]["outcome"] == "miss" and store.table("cache").count() == 4


def test_two_writers_are_noticed(spark, tmp_path):
    one, two = CacheStore(spark, str(tmp_path)), CacheStore(spark, str(tmp_path))
    commits = [s.batches.begin() for s in (one, two)]
    # Both saw an empty folder, so both take the first number.
    two.batches.published = lambda: []
    one.batches.publish(commits[0], "a")
    two.batches.publish(commits[1], "b")
    with pytest.raises(RuntimeError):
        one.table("cache")


def test_scope_and_second_opinion(spark, tmp_path):
    store, model = CacheStore(spark, str(tmp_path)), Model(spark)
    first = run(spark, store, ROWS[:1], model, "a", active_scope="north", second_opinion=Model(spark, "total is $6.0M"))
    assert first[1]["consensus"] == "DISPUTED" and first[1]["divergent"] == ["$5.0M", "5.0M"]
    assert run(spark, store, ROWS[:1], model, "b", active_scope="south")[1]["outcome"] == "miss"
    assert run(spark, store, ROWS[:1], model, "c", active_scope="north")[1]["outcome"] == "exact" and model.calls.value == 2
    assert run(spark, store, [], model, "d") == {}
