"""Hilbert shards: the curve itself, the law, odd rows, and what the order is for."""

import itertools
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from memograph.llm import sharding


@pytest.mark.parametrize("dims, bits", [(1, 4), (2, 3), (3, 2), (4, 2)])
def test_the_curve_visits_every_cell_once_by_steps_of_one(spark, dims, bits):
    cells = list(itertools.product(range(1 << bits), repeat=dims))
    df = spark.createDataFrame(cells, ", ".join(f"c{i} int" for i in range(dims)))
    made = df.withColumn("at", sharding.hilbert_index([F.col(f"c{i}") for i in range(dims)], bits)).orderBy("at").collect()
    assert [r["at"] for r in made] == list(range(len(cells)))
    for a, b in zip(made, made[1:]):
        assert sum(abs(a[i] - b[i]) for i in range(dims)) == 1


def test_an_index_has_at_most_63_bits():
    with pytest.raises(ValueError):
        sharding.hilbert_index([F.lit(0)] * 8, 8)


def test_every_row_gets_a_slot(corpus):
    df, rows = corpus
    for shards in (16, 7, 1000):
        made = sharding.shard_documents(df, shards).collect()
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in made) == Counter(
            (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows
        )
        counts = Counter(r["shard"] for r in made)
        assert set(counts) <= set(range(shards)) and max(counts.values()) - min(counts[s] for s in range(shards)) <= 1
        for s in counts:
            assert sorted(r["slot"] for r in made if r["shard"] == s) == list(range(counts[s]))
        assert {r["law"] for r in made} == {"rows"} and {r["grown_shard"] for r in made} == {None}


def test_order_follows_the_curve_and_equal_texts_with_equal_metadata_stay_together(spark):
    rows = [(i, f"text {i % 40}", "en", "a") for i in range(400)] + [(i, "x" * (i % 300), "fr" if i % 2 else "de", f"s{i % 7}") for i in range(400, 1000)]
    made = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), 4).collect()
    made.sort(key=lambda r: (r["shard"], r["slot"]))
    assert [r["curve_index"] for r in made] == sorted(r["curve_index"] for r in made)
    runs = [k for k, _ in itertools.groupby(made, lambda r: (r["text_crc32"], r["curve_index"]))]
    assert len(runs) == len(set(runs))


def test_codes_hold_equal_shares_whatever_the_values(spark):
    values = [10 ** (i % 13) for i in range(1300)]
    df = spark.createDataFrame([(v,) for v in values], "size long")
    found = sharding.cuts(df, "size", len(values), 2)
    expected = [min((v for v in values if 4 * sum(w < v for w in values) // len(values) >= k), default=None) for k in (1, 2, 3)]
    assert found == expected
    coded = df.distinct().withColumn("code", sharding.code_of(F.col("size"), found, df.schema["size"].dataType)).collect()
    assert all(r["code"] == 4 * sum(w < r["size"] for w in values) // len(values) for r in coded)


def test_no_rows_one_row_and_one_hot_row(spark, nothing):
    assert sharding.shard_documents(nothing).count() == 0
    one = spark.createDataFrame([(None, None, None)], "doc_id long, text string, lang string")
    assert [(r["shard"], r["slot"], r["size"]) for r in sharding.shard_documents(one).collect()] == [(0, 0, 1)]
    hot = spark.createDataFrame([(1, "same", "en", "s")], "doc_id long, text string, lang string, source string").select(
        "*", F.explode(F.sequence(F.lit(1), F.lit(3000))).alias("rank")
    )
    made = sharding.shard_documents(hot).collect()
    assert sorted((r["shard"], r["slot"]) for r in made) == sorted((i * 16 // 3000, i - -(-(i * 16 // 3000) * 3000 // 16)) for i in range(3000))


def test_files_hold_all_columns_and_are_skipped_along_every_dimension(spark, tmp_path):
    rows = [(i, "w" * (i * 37 % 997), ("en", "de", "fr", "es")[i * 7 % 4], f"s{i * 11 % 16}", i, "x") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, pos long, slot string")
    sharding.write_shards(df, str(tmp_path / "out"), 32)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, back.drop("shard").collect())) == sorted(rows)
    wide = back.withColumn("size", F.octet_length("text") + 1).groupBy("shard").agg(
        *[F.min(c).alias(f"{c}_from") for c in ("lang", "source", "size")], *[F.max(c).alias(f"{c}_to") for c in ("lang", "source", "size")]
    ).collect()
    assert len(wide) == 32

    def met(dimension, values):
        return sum(r[f"{dimension}_from"] <= v <= r[f"{dimension}_to"] for r in wide for v in values) / (32 * len(values))

    # A shard in any order would be met by nearly all of these; each dimension alone skips more than half of them.
    assert met("lang", ["de", "en", "es", "fr"]) < 0.5
    assert met("source", [f"s{i}" for i in range(16)]) < 0.5
    assert met("size", list(range(1, 998, 50))) < 0.5
