"""The pipeline on odd rows and on tables without rows."""

import corpus_pipeline

NAMES = ["quality_rules", "toxicity", "near_duplicates", "best_fit_packing"]


def through(spark, docs, labels, tmp_path):
    """The rows that each stage hands on, by name; the last are the packed pieces."""
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    made = {}
    for name, stage in corpus_pipeline.STAGES:
        out = str(tmp_path / name)
        stage(spark, docs, str(tmp_path)).write.parquet(out)
        docs = made[name] = spark.read.parquet(out)
    return made


def test_odd_rows(spark, corpus, labels, tmp_path):
    made = through(spark, corpus[0], labels, tmp_path)
    assert list(made) == NAMES
    rows = {tuple(r) for r in corpus[1]}
    for name in NAMES[:-1]:
        assert made[name].columns == corpus[0].columns
        kept = [tuple(r) for r in made[name].collect()]
        assert set(kept) <= rows
        # Null and empty texts fail the base rules; a very long text passes whole.
        assert not [r for r in kept if not (r[1] or "").strip()]
        assert [r[1] for r in kept if r[0] == 405] == [r[1] for r in corpus[1] if r[0] == 405]
    assert sum(r[0] == 5 for r in made["near_duplicates"].collect()) <= 1
    left = {r["doc_id"] for r in made["near_duplicates"].collect()}
    assert {r["doc_id"] for r in made["best_fit_packing"].collect()} == left


def test_no_rows(spark, nothing, labels, tmp_path):
    made = through(spark, nothing, labels.limit(0), tmp_path)
    assert all(made[name].count() == 0 for name in NAMES)
    assert all(made[name].columns == nothing.columns for name in NAMES[:-1])
