"""The term index against LIKE over every chunk."""

import random
import re

import pytest

from memograph.functions.text import SEARCH_STOPWORDS
from memograph.sources import lexical_index
from memograph.sources.lexical_index import LexicalIndex

CHUNKS = "corpus_id STRING, document_id STRING, chunk_index BIGINT, unit STRING, content_hash STRING, text STRING"
REQUESTS = "request_id BIGINT, corpus_id STRING, document_id STRING, unit STRING, content_hash STRING, prompt STRING"
WORDS = "Station channel back-up back_up leaux Über İstanbul q1 a x_y ab-c e1 e_1 naïve ORCHID-57 on nation".split()
PROMPTS = [
    "Which backup channel should the station use?", "q1 on nation nation", "back_up x_y", "a_b e_1", "tion ion", "zzz nowhere", "", "the of",
    "_ab -c n__t", "l_aux hann",
]


def tokens(text):
    return [t for t in re.findall(r"[a-z0-9][a-z0-9_-]*", text.lower()) if len(t) > 1 and t not in SEARCH_STOPWORDS]


def like(text, token):
    return re.search(re.escape(token).replace("_", "."), text, re.S) is not None


def best(chunks, asked, limit):
    scored = [(sum(like((c[5] or "").lower(), t) for t in asked), c) for c in chunks]
    scored = sorted((-n, c[1], c[2]) for n, c in scored if n)[:limit]
    return [(d, i, float(-n), r) for r, (n, d, i) in enumerate(scored, 1)]


@pytest.fixture(scope="module")
def chunks():
    draw = random.Random(5)
    made = [("c", f"d{d}", i, "chunk", "" if d % 2 else "v1", " ".join(draw.choices(WORDS, k=draw.randint(1, 9)))) for d in range(7) for i in range(9)]
    return made + [("c", "d0", 50, "chunk", "v1", None), ("c", "d0", 51, "chunk", "v1", ""), ("c", "d0", 52, "chunk", "v1", "a\nb x\ny")]


def stored(spark, path, *batches):
    index = LexicalIndex(spark, str(path))
    for i, rows in enumerate(batches):
        index.add(spark.createDataFrame(rows, CHUNKS), f"b{i}")
    return index


def test_corpus_wide_search_equals_like(spark, tmp_path, chunks):
    index, frame = stored(spark, tmp_path, chunks[:20], chunks[20:]), spark.createDataFrame(chunks, CHUNKS)
    made = index.search(PROMPTS, frame, 6).collect()
    for no, prompt in enumerate(PROMPTS):
        got = sorted((r for r in made if r["query_no"] == no), key=lambda r: r["rank"])
        expected = best(chunks, tokens(prompt), 6)
        assert [(r["document_id"], r["chunk_index"], r["score"], r["rank"]) for r in got] == expected, prompt
        assert all(r["matched_terms"] == [t for t in tokens(prompt) if t in r["text"].lower()] for r in got)


def test_document_search_equals_like_within_the_document(spark, tmp_path, chunks):
    index, frame = stored(spark, tmp_path, chunks), spark.createDataFrame(chunks, CHUNKS)
    asked = [(10 * d + n, "c", f"d{d}", "chunk", ("", "v1", "v2")[n % 3], p) for d in range(8) for n, p in enumerate(PROMPTS)]
    asked += [(500 + i, *asked[0][1:]) for i in range(40)]
    made = {}
    for r in index.search_documents(spark.createDataFrame(asked, REQUESTS), frame, "prompt", 4).collect():
        made.setdefault(r["request_id"], []).append((r["document_id"], r["chunk_index"], r["score"], r["rank"]))
    for request, _, document, _, version, prompt in asked:
        own = [c for c in chunks if c[1] == document and (c[4] == version or "" in (c[4], version))]
        assert sorted(made.get(request, []), key=lambda r: r[3]) == best(own, tokens(prompt), 4), (request, prompt)


def test_the_latest_version_of_a_chunk_counts(spark, tmp_path):
    first = [("c", "d", 0, "chunk", "v1", "old wording"), ("c", "d", 1, "chunk", "v1", "other wording")]
    second = [("c", "d", 0, "chunk", "v1", "new phrase"), ("c", "d", 1, "chunk", "v2", "old times")]
    index = stored(spark, tmp_path, first, second)
    index.add(spark.createDataFrame(first, CHUNKS), "b0")
    current = spark.createDataFrame([second[0], first[1], second[1]], CHUNKS)
    made = index.search(["old", "wording", "phrase"], current, 9).collect()
    assert sorted((r["query_no"], r["chunk_index"], r["content_hash"]) for r in made) == [(0, 1, "v2"), (1, 1, "v1"), (2, 0, "v1")]


def test_an_empty_index_finds_nothing(spark, tmp_path):
    index = LexicalIndex(spark, str(tmp_path))
    none = spark.createDataFrame([], CHUNKS)
    assert index.search(["some words"], none).count() == 0
    index.add(none, "nothing")
    assert index.search(["some words"], none).count() == 0


@pytest.mark.parametrize("sent", [0, 200_000])
def test_one_row_per_chunk_and_equal_hits_however_the_terms_travel(spark, tmp_path, chunks, monkeypatch, sent):
    monkeypatch.setattr(lexical_index, "SENT_PAIRS", sent)
    index, frame = stored(spark, tmp_path, chunks[:20], chunks[20:]), spark.createDataFrame(chunks, CHUNKS)
    assert index.batches.read("held").count() == len(chunks)
    made = index.search(PROMPTS, frame, 6).collect()
    for no, prompt in enumerate(PROMPTS):
        got = sorted((r["rank"], r["document_id"], r["chunk_index"]) for r in made if r["query_no"] == no)
        assert got == [(rank, d, i) for d, i, _, rank in best(chunks, tokens(prompt), 6)], prompt
