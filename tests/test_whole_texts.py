"""Summaries and evidence that used to be cut without a sign."""

import re

from pyspark.sql import functions as F

from memograph.plans import cache as caching
from memograph.plans import summarise


def test_long_texts_shrink_beyond_five_levels_or_say_so(spark):
    df = spark.createDataFrame([(1, "a" * 1_200_000), (2, "b" * 10)], "id BIGINT, text STRING")
    halved = lambda p: p.withColumn("summary", F.left("text", (F.length("text") / 2).cast("int")))
    done = {r.id: r for r in summarise.condense(df, "id", "text", halved).collect()}
    assert done[1].levels == 7 and len(done[1].summary) < 16_000 and not done[1].truncated and done[1].whole is None
    assert (done[2].levels, done[2].summary, done[2].truncated) == (0, "b" * 10, False)
    stuck = summarise.condense(spark.createDataFrame([(3, "cd" * 10_000)], "id BIGINT, text STRING"), "id", "text", lambda p: p.withColumn("summary", F.col("text")))
    row = stuck.first()
    assert row.truncated and row.whole.replace("\n", "") == "cd" * 10_000 and row.whole.startswith(row.summary)


def test_migrated_entries_carry_whole_evidence(memo, spark):
    context = "s" * 1_200 + "end"
    cache = spark.createDataFrame(
        [(1, "who signed", "an answer", context, "h", "")],
        "cache_id BIGINT, query STRING, result STRING, source_context STRING, chunk_hash STRING, data_scope_hash STRING",
    )
    empty = memo.entries((0, 1, "exact_answer")).filter("false")
    facts = spark.createDataFrame([(1, "A", "is", "B")], "cache_id BIGINT, subject STRING, relation STRING, object STRING")
    at = "2024-01-01T00:00:00Z"
    for moved in (caching.migrate_cache(cache, empty, at), caching.migrate_facts(facts, cache, empty, at)):
        assert [e.text for r in moved.collect() for e in r.evidence] == [context]


def test_central_sentences_read_the_whole_piece(spark):
    """The last sentence of a piece wins where it shares most words; ties go to the earlier sentence, order is kept."""
    rows = [
        (1, 0, "Far off. The cat sat. The dog sat. Nothing else! The cat and the dog sat"),
        (1, 1, "... !!"), (2, 0, "one two. one two. three"), (3, 0, "x" * 90),
    ]
    pieces = spark.createDataFrame(rows, "id BIGINT, piece_no INT, text STRING")
    made = {(r.id, r.piece_no): r.summary for r in summarise.central_sentences(40)(pieces).collect()}
    assert made[1, 1] == "" and made[3, 0] == "x" * 40 and made[2, 0] == "one two. one two. three"
    assert made[1, 0] == "The cat sat. The dog sat."
    assert {(r.id, r.piece_no): r.summary for r in summarise.central_sentences(12)(pieces).collect()}[2, 0] == "one two."


def test_central_sentences_reach_a_second_level(spark):
    text = " ".join(f"w{i % 7} w{i % 11} w{i % 13} sentence {i}." for i in range(3_000))
    done = summarise.condense(spark.createDataFrame([(1, text), (2, "short")], "id BIGINT, text STRING"), "id", "text", summarise.central_sentences())
    rows = {r.id: r for r in done.collect()}
    assert rows[1].levels >= 2 and not rows[1].truncated and len(rows[1].summary) // 4 <= 4000
    # In order, and from the end of the text too; ends of lines that a further level reads become blanks.
    numbers = [int(n) for n in re.findall(r"w\d+ w\d+ w\d+ sentence (\d+)\.", rows[1].summary)]
    assert numbers == sorted(numbers) and numbers[0] == 0 and numbers[-1] > 2_900
    assert rows[2].summary == "short" and rows[2].levels == 0
