"""Ingest of a folder in rounds: only what changed is cut and embedded, only what depends on it is invalidated."""

import pytest
from pyspark.sql import functions as F

from memograph.functions.embedding import hashed_embedding
from memograph.operators.graph import depends_on
from memograph.plans import ingest as I
from memograph.sources.files import read_text_dir

LONG = "A sentence about the revenue of one quarter, told at length. " * 120


def folder(path, **texts):
    for name, text in texts.items():
        (path / f"{name}.txt").write_text(text, encoding="utf-8")
    return str(path)


def report(rows):
    return {r["filename"]: (r["state"], r["windows"], r["embedded"]) for r in rows.collect()}


def test_only_changes_are_embedded(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    asked = spark.sparkContext.accumulator(0)

    @F.udf("array<float>")
    def embed(text):
        asked.add(1)
        return [float(len(text)), 1.0]

    corpus = I.Corpus(spark, str(tmp_path / "corpus"), embed)
    where = folder(docs, a=LONG, b=LONG + "End.", c="short", d="x" * 3000)
    first = report(I.ingest(read_text_dir(spark, where), corpus, "one"))
    assert first == {"a.txt": ("added", 3, 3), "b.txt": ("added", 3, 3), "c.txt": ("added", 0, 0), "d.txt": ("added", 2, 2)}
    assert asked.value == 8 and corpus.windows().count() == 8
    (docs / "d.txt").unlink()
    folder(docs, b="Changed. " + LONG[:3000], e="new " * 50)
    second = report(I.ingest(read_text_dir(spark, where), corpus, "two"))
    assert second == {
        "a.txt": ("same", 3, 0), "b.txt": ("changed", 2, 2), "c.txt": ("same", 0, 0), "d.txt": ("removed", 0, 0), "e.txt": ("added", 1, 1),
    }
    assert asked.value == 11
    now = {(r["filename"], r["char_start"]): r["text"] for r in corpus.windows().collect()}
    assert sorted(now) == [("a.txt", 0), ("a.txt", 2800), ("a.txt", 5600), ("b.txt", 0), ("b.txt", 2800), ("e.txt", 0)]
    assert now["b.txt", 0].startswith("Changed.")
    # Again: nothing is new, and a batch of a known name is not stored twice.
    again = report(I.ingest(read_text_dir(spark, where), corpus, "two"))
    assert {state for state, *_ in again.values()} == {"same"} and asked.value == 11


def test_a_file_that_comes_back_has_one_version(spark, tmp_path):
    rows = lambda text: spark.createDataFrame([("f", text, str(hash(text)), len(text))], "filename STRING, text STRING, content_hash STRING, total_chars BIGINT")
    corpus = I.Corpus(spark, str(tmp_path))
    old, new = "the first text " * 10, "another text " * 10
    for n, text in enumerate((old, new, old)):
        made = report(I.ingest(rows(text), corpus, str(n), whole=False))
        assert made["f"][0] == ("changed" if n else "added")
    assert [r["text"] for r in corpus.windows().collect()] == [old]
    nothing = rows(old).filter("false")
    assert I.ingest(nothing, corpus, "part", whole=False).count() == 0 and corpus.files().count() == 1
    assert report(I.ingest(nothing, corpus, "all")) == {"f": ("removed", 0, 0)} and corpus.windows().count() == 0


def test_odd_rows(spark, tmp_path):
    schema = "filename STRING, text STRING, content_hash STRING, total_chars BIGINT, state STRING"
    rows = [("n", None, "h0", 0, "x"), (None, "t" * 60, "h", 60, "x"), ("twice", "b" * 60, "h2", 60, "x"), ("twice", "a" * 70, "h1", 70, "y"), ("no", "t", None, 1, "z")]
    corpus = I.Corpus(spark, str(tmp_path))
    made = report(I.ingest(spark.createDataFrame(rows, schema), corpus, "odd"))
    assert made == {"n": ("added", 0, 0), "twice": ("added", 1, 1)}
    assert [r["text"] for r in corpus.windows().collect()] == ["a" * 70]


def test_a_broken_batch_is_not_seen(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([("f", "t" * 80, "h", 80)], "filename STRING, text STRING, content_hash STRING, total_chars BIGINT")
    corpus = I.Corpus(spark, str(tmp_path))
    with monkeypatch.context() as broken:
        broken.setattr(corpus.batches, "publish", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            I.ingest(rows, corpus, "b")
    assert corpus.files().count() == 0 and corpus.windows().count() == 0
    assert report(I.ingest(rows, corpus, "b")) == {"f": ("added", 1, 1)} and corpus.windows().count() == 1


def test_only_what_depends_on_a_change_is_stale(spark, tmp_path, memo):
    rows = lambda **texts: spark.createDataFrame([(n, t, f"hash of {t[:9]}", len(t)) for n, t in texts.items()], "filename STRING, text STRING, content_hash STRING, total_chars BIGINT")
    corpus = I.Corpus(spark, str(tmp_path), hashed_embedding)
    I.ingest(rows(one="first " * 30, two="second " * 30), corpus, "a")
    made = I.ingest(rows(one="altered " * 30, two="second " * 30), corpus, "b")
    entries = memo.entries(
        (0, 50, "exact_answer", {"document": "one", "hash": "hash of first fir"}), (0, 60, "exact_answer", {"document": "two", "hash": "hash of second se"}),
    )
    leaf = {r["document_id"]: r["entry_id"] for r in entries.collect()}
    built = memo.entries((0, 400, "exact_answer", {"document": "both", "dependencies": [leaf["one"]]}), (0, 500, "exact_answer", {"document": "both", "dependencies": [leaf["two"]]}))
    top = {r["scope_end"]: r["entry_id"] for r in built.collect()}
    stored = entries.unionByName(built)
    stale = I.stale_entries(made, stored, depends_on(stored), "finance", "chunk")
    assert {(r["entry_id"], r["depth"]) for r in stale.collect()} == {(leaf["one"], 0), (top[400], 1)}
    marked = I.marked_stale(stale, stored, "2024-01-02T00:00:00Z")
    assert {(r["entry_id"], r["verifier_status"]) for r in marked.collect()} == {(leaf["one"], "rejected"), (top[400], "rejected")}
