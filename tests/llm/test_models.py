"""Quality, rules, toxicity, extraction and the pipeline."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from memograph.llm import extraction, quality, rules, toxicity

WORDS = [f"{a}{b}{c}" for a in ("ba", "ko", "ri", "tu") for b in ("len", "mor", "sti", "") for c in ("ed", "ing", "a")]


def fold(i):
    return zlib.crc32(str(i).encode()) % 5


@pytest.fixture(scope="module")
def judged(spark):
    """Texts that are good or of signs, toxic by two words or clean, with labels."""
    draw = random.Random(6)
    docs, labels = [], []
    for i in range(500):
        words = [draw.choice(WORDS) for _ in range(draw.randint(60, 120))]
        good, toxic = i % 5 != 0, i % 7 == 0
        for _ in range(4 * toxic):
            words[draw.randrange(len(words))] = draw.choice(["zounds", "knave"])
        docs.append((i, " ".join(words if good else [w + draw.choice(["***", "$$$"]) for w in words]), "en"))
        labels.append((i, int(good), int(toxic)))
    docs += [(900, None, "en"), (901, "", None), (None, docs[0][1], "en"), (7, docs[7][1], "en")]
    frame = spark.createDataFrame([(*d, 1.0, "x") for d in docs], "doc_id long, text string, lang string, score double, level string")
    return frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), docs, {r[0]: r for r in labels}


def held_out_accuracy(rows, truth):
    checked = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    return sum(r["predicted"] == truth[r["doc_id"]] for r in checked) / len(checked)


def test_quality(judged, spark):
    frame, labels, docs, truth = judged
    rows = quality.quality(frame, labels).collect()
    assert len(rows) == len(docs) and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (r["doc_id"] is not None and fold(r["doc_id"]) == 0) for r in rows)
    assert held_out_accuracy(rows, {i: t[1] for i, t in truth.items()}) > 0.97
    assert len({r["score"] for r in rows if r["doc_id"] in (900, 901)}) == 1
    none = quality.quality(frame, labels.filter("false")).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality.quality(frame.filter("false"), labels).count() == 0


def test_temperature_calibrates():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(4000, 3))
    y = (draw.random(4000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    network = quality.Network().fit(x[:2000], y[:2000])
    before = np.mean(np.logaddexp(0, network.logits(x[2000:])) - y[2000:] * network.logits(x[2000:]))
    network.calibrate(x[2000:], y[2000:])
    p = network.probabilities(x[2000:])
    assert -np.mean(y[2000:] * np.log(p) + (1 - y[2000:]) * np.log(1 - p)) <= before + 1e-9


def test_toxicity(judged):
    frame, labels, docs, truth = judged
    rows = toxicity.toxicity(frame, labels).collect()
    assert len(rows) == len(docs) and held_out_accuracy(rows, {i: t[2] for i, t in truth.items()}) > 0.95
    flagged = next(r for r in rows if r["predicted"])
    assert flagged["evidence"] and all(fold(i) and truth[i] for i in flagged["evidence"])
    assert {r["score"] for r in toxicity.toxicity(frame, labels.filter("false")).collect()} == {0.25}
    assert toxicity.toxicity(frame.filter("false"), labels).count() == 0
    kept = toxicity.kept_rows(frame, labels)
    assert kept.columns == frame.columns and kept.count() == sum(not r["predicted"] for r in rows)


def test_toxicity_equals_all_cosines(spark):
    """Index, weights, cosines and evidence against plain sums over all words of all examples and documents."""
    draw = random.Random(3)
    lexicon = [f"w{chr(97 + i // 20)}{chr(97 + i % 20)}é" for i in range(300)]
    texts = [" ".join(lexicon[min(int(draw.expovariate(0.02)), 299)] for _ in range(draw.randint(3, 60))) for _ in range(700)]
    texts += [None, "", "123 ...", texts[0], texts[1], "Wæß neverseen", "long " * 50_000 + texts[2]]
    frame = spark.createDataFrame([(i, t, "de") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int("waaé" in (t or ""))) for i, t in enumerate(texts[:600])], "doc_id long, toxic int")
    index = toxicity.fitted(frame, labels)
    words = [Counter(re.findall(r"[^\W\d_]+", (t or "").lower())) for t in texts]
    examples = [i for i in range(600) if fold(i)]
    assert sorted(index.ids.tolist()) == examples and set(index.words.to_pylist()) == {w for i in examples for w in words[i]}
    frequency = Counter(w for c in words for w in c)
    weight = dict(zip(index.words.to_pylist(), index.weights))
    plain = {w: 0.05 * (np.log((1 + len(texts)) / (1 + frequency[w])) + 1) for w in weight}
    assert all(weight[w] >= plain[w] * (1 - 1e-12) for w in weight) and max(weight, key=lambda w: weight[w] / plain[w]) == "waaé"
    unknown = 0.05 * (np.log(1 + len(texts)) + 1)

    def unit(counts):
        values = {w: (1 + np.log(n)) * weight.get(w, unknown) for w, n in counts.items()}
        norm = np.sqrt(sum(v * v for v in values.values()))
        return {w: v / norm for w, v in values.items()}

    known = [(i, unit(words[i])) for i in examples]
    rows = {r["doc_id"]: r for r in toxicity.toxicity(frame, labels).collect()}
    assert len(rows) == len(texts)
    for i in [*range(0, 700, 29), *range(700, len(texts))]:
        query = unit(words[i])
        cosines = [(-round(sum(v * x.get(w, 0.0) for w, v in query.items()), 8), j) for j, x in known]
        expected = [(j, -c) for c, j in sorted(cosines) if c < 0][:15]
        assert np.allclose(rows[i]["cosines"], [c for _, c in expected], atol=2e-8)
        reach = expected[-1][1] if expected else 0
        assert {j for j, c in expected if c > reach + 1e-7} <= set(rows[i]["evidence"])
    assert rows[700]["evidence"] == rows[702]["evidence"] == rows[705]["evidence"] == [] and rows[0]["score"] == rows[703]["score"]
    scored = [n for _, _, n in index.nearest(*index.examples(0, 100), 100, 15)]
    assert max(scored) <= index.blocks


def test_toxicity_of_odd_tables(spark):
    empty = spark.createDataFrame([(1, ""), (2, None), (None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    assert [(r["predicted"], r["evidence"]) for r in toxicity.toxicity(empty, labels).collect()] == [(0, [])] * 3
    assert toxicity.toxicity(empty.filter("false"), labels.filter("false")).count() == 0


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = list(zip(words, words[1:], words[2:]))
    again = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again)


def test_rule_counts(corpus, labels, nothing):
    short = corpus[0].filter("doc_id <> 405 or doc_id is null")
    made = rules.quality_rules(short, labels).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    expected = [(str(i), *counts(t)) for i, t, *_ in corpus[1] if i != 405]
    assert sorted((str(r["doc_id"]), *(r[n] for n in names)) for r in made) == sorted(expected)
    for r in made:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert rules.quality_rules(nothing, labels).count() == 0
    assert rules.kept_rows(short, labels).columns == short.columns


def test_cutoffs_are_proven(spark, judged):
    from pyspark.sql import functions as F

    for k, n, p in [(0, 200, 0.02), (3, 500, 0.02), (9, 500, 0.02), (150, 10_000, 0.02), (40, 40, 0.5)]:
        tail = spark.range(1).select(rules.binomial_tail(F.lit(k), F.lit(n), p)).first()[0]
        exact = sum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p)) for j in range(k + 1))
        assert math.isclose(tail, exact if k < n * p else 1.0, rel_tol=1e-9)
    frame, labels, _, truth = judged
    made = {r["doc_id"]: r for r in rules.quality_rules(frame, labels, risk=0.05).collect()}
    assert made[1]["level"] == len(rules.LEVELS) and made[901]["level"] == 0
    assert all(made[i]["kept"] == (truth[i][1] == 1) for i in range(500) if not made[i]["base_failed"])


PAGE = """<html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body><header><p>Site name and motto</p></header>
<nav><ul><li><a href="/a">Home</a><li><a href="/b">News &amp; more</a></ul></nav><div class="cookie-notice"><p>We use cookies on this site.</p></div>
{open}<h1>Title of it</h1><p>The first   paragraph &eacute; of a long text, with <b>bold</b> words.<p>A second one,<br>broken in two.</p>{close}
<aside><p>Read also this other story.</p></aside><div class="comments"><p>Nice article, thank you!</p></div>
<form><p>Leave your address here</p><input></form><footer>&copy; 2020 Nobody</footer>"""
TEXT = "Title of it\nThe first paragraph é of a long text, with bold words.\nA second one, broken in two."


def test_extraction(spark):
    draw = random.Random(3)
    filler = lambda n: " ".join(draw.choice(WORDS) for _ in range(n)).capitalize() + "."
    pages = []
    for i in range(60):
        body = "".join(f"<p>{filler(draw.randint(8, 60))}</p>" for _ in range(draw.randint(2, 7)))
        pages.append((i, f"u{i}", f'<html><body><nav><ul><li><a href="/x">{filler(1)}</a></li></ul></nav><div class="ad">{filler(9)}</div><article><h1>{filler(5)}</h1>{body}</article><footer>&copy; {filler(4)}</footer>'))
    asked = [
        (100, PAGE.format(open="<article>", close="</article>"), TEXT), (101, PAGE.format(open='<main><div class="content">', close="</div></main>"), TEXT),
        (102, None, ""), (103, "", ""), (104, "<p", "<p"), (105, "<!-- only --><script>x", ""), (101, PAGE.format(open="<main>", close="</main>"), TEXT),
    ]
    pages += [(i, None, h) for i, h, _ in asked] + [(None, "n", pages[0][2])]
    frame = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, text string")
    made = extraction.extract(frame).collect()
    assert len(made) == len(pages) and all(r["n_chars"] == len(r["text"]) for r in made)
    got = {}
    for r in made:
        got.setdefault(r["page_id"], []).append(r["text"])
    for i, _, text in asked:
        if i != 104:
            assert text in got[i], (i, got[i])
    for i, _, page in pages[:60]:
        article = re.findall(r"<(?:h1|p)>(.*?)</", page.split("<article>")[1].split("</article>")[0])
        assert got[i] == ["\n".join(article)]
    assert got[None] == got[0] and extraction.extract(frame.filter("false")).count() == 0


def test_pipeline(spark, judged, tmp_path):
    frame, labels, docs, truth = judged
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    stage, names = frame, [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "toxicity", "near_duplicates", "best_fit_packing"]
    for name, function in corpus_pipeline.STAGES[:-1]:
        stage = function(spark, stage, str(tmp_path))
        assert stage.columns == frame.columns
    clean = {i for i, t, _ in docs if i in truth and truth[i][1] and not truth[i][2]}
    left = {r["doc_id"] for r in stage.collect()}
    assert clean <= left and not any(truth[i][2] for i in left if i in truth)
    made = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in made.collect()} == left
