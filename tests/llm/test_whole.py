"""Whole results where a limit used to cut them."""

import collections
import math

import numpy as np
import pytest

from memograph.llm import extraction, language_model, neighbours


def backoff(rows):
    """Scores by plain counts: (doc_id, n_words, log_score)."""
    texts = [(i, (t or "").lower().split()) for i, t in rows]
    single, pairs = collections.Counter(w for _, t in texts for w in t), collections.Counter()
    total, single[None] = sum(single.values()), sum(bool(t) for _, t in texts)
    own = [collections.Counter(zip([None, *t], [*t, None])) if t else collections.Counter() for _, t in texts]
    for b in own:
        pairs.update(b)
    for (doc_id, t), b in zip(texts, own):
        score = 0.0
        for (u, v), n in b.items():
            rest = pairs[u, v] - n
            score += n * math.log(rest / max(single[u] - n, rest) if rest else 0.4 * single[v] / (total + single[None]))
        yield doc_id, len(t), score


def test_backoff_has_no_vocabulary(spark):
    """More different words than 200,000: two texts of words seen nowhere else share no bigram and back off."""
    rows = [(i, " ".join(f"w{(i * 9_000 + j) % 205_000}" for j in range(10_000))) for i in range(24)]
    rows += [(100, "zzunseen zzother zzwords zzof zztheir zzown"), (101, "zzanother zzset zzof2 zzunseen2 zzwords2 w5")]
    made = {r["doc_id"]: r for r in language_model.backoff_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(made) == len(rows)
    for doc_id, n, score in backoff(rows):
        assert made[doc_id]["n_words"] == n and made[doc_id]["log_score"] == pytest.approx(score, rel=1e-9)
        assert made[doc_id]["mean_log_score"] == pytest.approx(score / (n + 1), rel=1e-9)


@pytest.mark.parametrize("sent, hot", [(3, 1), (1, 5), (50_000, 20_000)])
def test_backoff_is_the_same_however_much_is_sent(spark, monkeypatch, sent, hot):
    monkeypatch.setattr(language_model, "SENT", sent)
    monkeypatch.setattr(language_model, "HOT_WORDS", hot)
    monkeypatch.setattr(language_model, "HOT_BIGRAMS", hot)
    draw = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{x}" for x in draw.zipf(1.5, 40))) for i in range(60)] + [(60, None), (61, ""), (62, "w1 w1 w1 w1")]
    made = {r["doc_id"]: r["log_score"] for r in language_model.backoff_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert made == {doc_id: pytest.approx(score, rel=1e-9) for doc_id, _, score in backoff(rows)}


def test_copies_of_an_id_take_no_places(spark):
    """Rows of one id, repeated or slightly different, count once: the other ids are still found."""
    rows = [(0, [1.0, 0.0])] + [(1, [1.0, 0.001 * i]) for i in range(1, 13)] + [(1, [1.0, 0.001])] * 12
    rows += [(i, [1.0, 0.1 * i]) for i in range(2, 9)]
    expected = [(0, 1, 0.001)] + [(0, i, 0.1 * i) for i in range(2, 6)]
    array, ids = np.array([r[1] for r in rows]), np.array([r[0] for r in rows])
    made = list(neighbours.closest(array[:1], array, ids[:1], ids, 5))
    assert [(q, i, round(d, 9)) for q, i, d in made] == [(q, i, round(d, 9)) for q, i, d in expected]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    made = neighbours.nearest(df, df.filter("vec_id = 0"), k=5).orderBy("rank").collect()
    assert [(r["query_id"], r["vec_id"], round(r["score"], 9)) for r in made] == [(q, i, round(d, 9)) for q, i, d in expected]


def test_extraction_learns_from_long_pages(spark):
    """Where every page is over 40,000 characters and 160 blocks the labeller is trained all the same, by windows."""
    pages, texts = [], []
    for p in range(3):
        main = [f"Paragraph {i} of article {p} tells, at some length and with stops, what took place on day {i}." for i in range(240)]
        links = "".join(f'<li><a href="/{i}">Link {i}</a></li>' for i in range(200))
        notes = "".join(f"<p>Reply {i}: I would like to say something about page {p}, too.</p>" for i in range(160))
        story = "".join(f"<p>{t}</p>" for t in main)
        pages.append((p, "u", f"<html><body><nav><ul>{links}</ul></nav><article>{story}</article><div class='comments'>{notes}</div></body></html>"))
        texts.append("\n".join(main))
    assert min(len(h) for *_, h in pages) > 40_000
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {r["turn"] for r in extraction.sampled(frame)} == {0, 1, 2, 3}
    made = {r["page_id"]: r["text"] for r in extraction.extract(frame).collect()}
    for p, text in enumerate(texts):
        got, expected = set(made[p].split("\n")), set(text.split("\n"))
        assert len(got & expected) >= 0.95 * len(expected) and len(got - expected) <= 0.05 * len(expected)


def test_backoff_of_odd_rows(spark, corpus, nothing):
    """Null ids and texts, empty and very long texts, repeated rows, columns named like the operator's own; a table without rows."""
    clashing = corpus[0].withColumnsRenamed({"lang": "hi", "score": "n_words", "row": "slice"})
    made = [(r["doc_id"], r["n_words"], r["log_score"]) for r in language_model.backoff_scores(clashing).collect()]
    expected = list(backoff([(i, t) for i, t, *_ in corpus[1]]))
    order = lambda row: (row[0] is None, row[0] or 0, row[1], row[2])
    assert len(made) == len(expected)
    for got, plain in zip(sorted(made, key=order), sorted(expected, key=order)):
        assert got[:2] == plain[:2] and got[2] == pytest.approx(plain[2], rel=1e-9)
    assert language_model.backoff_scores(nothing).count() == 0
