"""The memo without evidence texts: the same entries, from the sizes of the documents alone."""

import re
import uuid

import pytest
from pyspark.sql import functions as F

from memograph.functions import text as T
from memograph.sources.views import Views
from memograph.suite import registry

ODD = ["", " ", " \x1c\t", "one", " one  two\n", "a b　c\x85d", "zero​width joiner", None, "﻿mark \x1f end\x00"]


@pytest.fixture
def odd(spark, tmp_path):
    """A folder with odd, short and long documents."""
    texts = [*ODD, *[" ".join(f"w{i}" for i in range(n)) for n in (80, 81, 320, 321, 1_700, 4_000)]]
    rows = [(i, t, "en", f"s{i % 2}") for i, t in enumerate(texts * 3)]
    folder = f"{tmp_path}/{uuid.uuid4().hex}"
    spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING, source STRING").write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int(i % 4 == 0)) for i in range(len(rows))]
    spark.createDataFrame(labels, "doc_id BIGINT, quality INT, toxic INT").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_words_are_counted_as_they_are_cut(spark):
    df = spark.createDataFrame([(t,) for t in ODD], "text STRING").select("text", F.size(T.words("text")).alias("cut"), T.count_words("text").alias("counted"))
    rows = df.collect()
    assert [r.counted for r in rows] == [r.cut for r in rows] == [len(re.findall(r"\S+", t or "")) for t in ODD]


def test_outline_is_the_memo_without_texts(spark, odd):
    v = Views(spark, odd)
    assert v.outline.schema.simpleString() == v.memo.schema.simpleString()
    places = F.transform("evidence", lambda e: F.struct(*[e[c] for c in ("document_id", "start", "end", "unit")]))
    whole, bare = (sorted(map(repr, df.withColumn("evidence", places).collect())) for df in (v.memo, v.outline))
    assert whole == bare and len(bare) > 20
    texts = lambda df: df.select(F.explode("evidence.text").alias("t")).filter("t IS NOT NULL")
    assert not texts(v.memo).isEmpty() and texts(v.outline).isEmpty()


@pytest.mark.parametrize("name", ["scope_candidates_join", "candidates_interval_join", "plan_telemetry"])
def test_planning_cuts_no_texts(spark, odd, monkeypatch, name):
    """Which entries a request overlaps does not depend on evidence texts, so none are cut for it."""
    registry.load_all()
    monkeypatch.setattr(Views, "texts", property(lambda v: pytest.fail("texts were cut")))
    assert registry.QUERIES[name](spark, odd).count() > 0
