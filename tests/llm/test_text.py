"""Tokens, packing, language model, licences: against the libraries and plain versions."""

import collections
import hashlib
import math
import zlib
from array import array

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from memograph.llm import bpe, language_model, licences, packing


def test_bpe_equals_the_tokenizer(corpus, nothing):
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    made = bpe.encode(corpus[0], path, digests=True).collect()
    expected = []
    for doc_id, text, *_ in corpus[1]:
        ids = plain.encode(text or "", add_special_tokens=False).ids
        decoded = plain.decode(ids, skip_special_tokens=False)
        expected.append((doc_id, len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, made), key=key) == sorted(expected, key=key)
    assert bpe.encode(nothing, path).count() == 0


def test_bpe_round_trip_of_rare_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    plain, own = Tokenizer.from_file(path), bpe.WordBpe(path)
    for text in ["ΣΑΣ ΟΔΟΣ", "a\x1cb \x85c", "<|startoftext|>Hi<|endoftext|> <|x", "İstanbul ß é", "aaaaaaaaaaaaaaaaaaaa", "don't WE'LL 's", "̀ a", "１２３½²", "x" * 3000]:
        ids = plain.encode(text, add_special_tokens=False).ids
        assert list(array("I", own.encode(text))) == ids
        assert own.decode(own.encode(text)) == plain.decode(ids, skip_special_tokens=False)


def test_byte_tokens_equal_the_tokenizer():
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, own = Tokenizer.from_file(path), packing.byte_tokens(path)
    for text in ["", " a", "a ", "a  b", "a   b", "a\n b", "a \nb", "a\t\t b  c", "x <|endoftext|> y<|endoftext|>", "don't 12ab ½ 日本 😀!", "a  b", "plain words, here."]:
        assert list(array("I", own(text))) == plain.encode(text, add_special_tokens=False).ids


def test_packing_places_every_piece_once(corpus, nothing):
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    made = packing.pack_documents(corpus[0], path).collect()
    expected = collections.Counter()
    for doc_id, text, *_ in corpus[1]:
        ids = plain.encode(text or "", add_special_tokens=False).ids + [0]
        over, start, number = len(ids) % 2048, 0, 0
        while start < len(ids):
            end = start + (over if number == 0 and over and len(ids) > 2048 else 2048)
            part = ids[start:end]
            expected[doc_id, number, start, len(part), zlib.crc32(array("I", part).tobytes())] += 1
            start, number = start + len(part), number + 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in made) == expected
    bins = collections.defaultdict(list)
    for r in made:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for content in bins.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= math.ceil(sum(r["length"] for r in made) / 2048) + 1
    assert packing.pack_documents(nothing, path).count() == 0


def test_two_replace_the_smallest_when_they_fit_better():
    planned = packing.plan_bins({60: 1, 39: 1, 25: 1, 15: 1, 1: 0}, 100)
    assert [sorted(c) for _, _, c in planned] == [[15, 25, 60], [39]]


def test_language_model(corpus, nothing):
    made = language_model.backoff_scores(corpus[0]).collect()
    texts = [(i, (t or "").lower().split()) for i, t, *_ in corpus[1]]
    single, pairs = collections.Counter(w for _, t in texts for w in t), collections.Counter()
    total, single[None] = sum(single.values()), sum(bool(t) for _, t in texts)
    own = [collections.Counter(zip([None, *t], [*t, None])) if t else collections.Counter() for _, t in texts]
    for b in own:
        pairs.update(b)
    expected = []
    for (doc_id, t), b in zip(texts, own):
        score = 0.0
        for (u, v), n in b.items():
            rest = pairs[u, v] - n
            score += n * math.log(rest / max(single[u] - n, rest) if rest else 0.4 * single[v] / (total + single[None]))
        expected.append((str(doc_id), len(t), round(score, 4)))
    assert sorted((str(r["doc_id"]), r["n_words"], round(r["log_score"], 4)) for r in made) == sorted(expected)
    assert language_model.backoff_scores(nothing).count() == 0


def test_licences(spark, corpus, nothing):
    known = licences.known_digests(spark)
    mit = "The MIT Licence\n\nCopyright (c) 2020 Some One\n\n" + licences.TEXTS["MIT"].replace(",", " ,").upper()
    docs = spark.createDataFrame(
        [(1, mit.replace("The ", "", 1)), (2, "Some text.\nreleased under the mit licence!\nmore"), (3, None), (4, ""), (5, "MIT"), (5, "MIT"), (None, "isc")],
        "doc_id long, text string",
    )
    found = {(r["doc_id"], r["license_id"], r["scope"]): r["n"] for r in licences.scan(docs.withColumn("digest", F.lit(1)), known).collect()}
    assert found[1, "MIT", "text"] == 1 and found[2, "MIT", "line"] == 1 and (2, "MIT", "text") not in found
    assert found[5, "MIT", "line"] == found[5, "MIT", "text"] == 2 and found[None, "ISC", "text"] == 1
    assert {k[0] for k in found} == {1, 2, 5, None}
    assert licences.scan(nothing, known).count() == 0
