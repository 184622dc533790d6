"""Toxicity by the nearest labelled examples: exact TF-IDF cosine through a block-max inverted index.

Examples are a bounded sample of labelled documents, with all of their words; document frequencies are counted over
all documents. A word's weight is its inverse document frequency, raised by its association with label 1 in the sample,
counted by groups of near copies so that one copied document is no evidence for its words. The index holds every example
in blocks with each word's largest weight per block; a block whose bound lies below the k-th best cosine so far is not
scored, which leaves the k nearest exact. Their votes are weighted by closeness and calibrated by the votes that the
examples get from the others.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memograph.llm.common import checkpointed, held_out, labelled_sample, text_slices

#: Most examples in the index (the bound of all that is broadcast), and neighbours that vote.
EXAMPLES = 4_096
NEIGHBOURS = 15
BLOCK, FIRST_BLOCKS = 32, 4
#: Share of its inverse document frequency that a word keeps without association, and what a unit of association per group
#: of copies adds. Association counts from twice the logarithm of the number of words, plus the margin: of words without
#: any, not one in ten samples is expected to reach it.
PLAIN, PULL, MARGIN = 0.05, 28.0, 4.0
#: Words that are in more than one of so many blocks are common; so many texts are searched together.
COMMON, TOGETHER = 3, 256
SLICE = 4 << 20
TIE = 1e-9
CUTOFF = 0.5


def word_counts(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words (runs of letters, in lower case) of some texts; by text and word in order: text, word, times."""
    parts = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"\PL+", " "))
    flat = parts.flatten().dictionary_encode()
    text = np.repeat(np.arange(len(parts)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
    code = flat.indices.to_numpy(zero_copy_only=False)
    said = pc.binary_length(flat.dictionary).to_numpy(zero_copy_only=False)[code] > 0
    width = max(len(flat.dictionary), 1)
    pairs, times = np.unique(text[said] * width + code[said], return_counts=True)
    return flat.dictionary, pairs // width, pairs % width, times


def _copies(text: str) -> int:
    """A number that most near copies share: the least checksum of three words in a row."""
    words = [w for w in pc.split_pattern_regex(pa.array([text]), r"\PL+").flatten().to_pylist() if w]
    return min((zlib.crc32(" ".join(w).encode()) for w in zip(words, words[1:], words[2:])), default=zlib.crc32(" ".join(words).encode()))


def _example_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, labels, texts = batch.columns
        names, text, word, times = word_counts(texts)
        ends = np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32)
        words = pa.ListArray.from_arrays(pa.array(ends), names.take(pa.array(word)))
        counts = pa.ListArray.from_arrays(pa.array(ends), pa.array(times.astype(np.int32)))
        copies = pa.array([_copies(t.as_py().lower()) for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([ids, labels, copies, words, counts], names=["doc_id", "label", "copies", "words", "times"])


def places_of(names: pa.Array, words: pa.Array) -> np.ndarray:
    """The place of each name among the words, -1 for others."""
    return pc.fill_null(pc.index_in(names, value_set=words.cast(names.type)), -1).to_numpy(zero_copy_only=False)


def document_frequencies(docs: DataFrame, words: pa.Array) -> tuple[np.ndarray, int]:
    """In how many rows of ``docs`` each word stands, and how many rows there are; counted per task before they are summed."""
    sent = docs.sparkSession.sparkContext.broadcast(words)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, rows = np.zeros(len(sent.value), dtype=np.int64), 0
        for batch in batches:
            texts, rows = batch.column(0), rows + batch.num_rows
            for start, end in text_slices(texts, SLICE):
                names, _, word, _ = word_counts(texts.slice(start, end - start))
                at = places_of(names, sent.value)[word]
                found += np.bincount(at[at >= 0], minlength=len(found))
        seen = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1)), pa.array(np.append(found[seen], rows))], names=["word", "n"])

    each = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(counted, "word long, n long")
    made = each.groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    word, n = made["word"].to_numpy(), made["n"].to_numpy()
    total = np.zeros(len(words) + 1, dtype=np.int64)
    total[word] = n  # -1, the rows, comes last
    return total[:-1], int(total[-1])


def associations(words: int, word: np.ndarray, label: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """By word, how far its likelihood ratio with label 1 passes the bar, per group of copies; 0 for words of label 0.

    One entry per example and word: the word's place, the example's label and its group of copies.
    """
    groups = np.unique(np.c_[label, copies], axis=0)[:, 0]
    one, zero = np.sum(groups == 1), np.sum(groups == 0)
    if not one or not zero:
        return np.zeros(words)
    entries = np.unique(np.c_[word, label, copies], axis=0)
    a, b = (np.bincount(entries[entries[:, 1] == y, 0], minlength=words).astype(float) for y in (1, 0))

    def part(n, whole, of):
        return n * np.log(np.where(n > 0, n, 1) * (zero + one) / np.maximum(whole * of, 1))

    ratio = 2 * (part(a, a + b, one) + part(b, a + b, zero) + part(one - a, zero + one - a - b, one) + part(zero - b, zero + one - a - b, zero))
    return np.where(a * zero > b * one, np.maximum(ratio - 2 * np.log(words) - MARGIN, 0), 0) / (zero + one)


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All numbers of the stretches, one stretch after the other."""
    return np.arange(lengths.sum()) + np.repeat(starts - np.cumsum(lengths) + lengths, lengths)


class Neighbours:
    """Block-max inverted index of the unit vectors of all examples, and the vote of the nearest.

    ``counts`` are arrays of example, word and times, sorted by example; ``weights`` are the words' weights and ``unknown``
    that of every word that no example has.
    """

    def __init__(self, words: pa.Array, weights: np.ndarray, unknown: float, ids: np.ndarray, labels: np.ndarray, counts, k: int = NEIGHBOURS):
        self.k, self.words, self.weights, self.unknown = k, words, weights, unknown
        self.blank = (labels.sum() + 0.5) / (len(labels) + 2)
        example, word, times = counts
        self.made_of = ids, labels, np.bincount(example, minlength=len(ids)).astype(np.int32), word.astype(np.int32), times.astype(np.int32)
        value = (1 + np.log(times)) * weights[word]
        norms = np.sqrt(np.bincount(example, value**2, minlength=len(ids)))
        # Examples whose heaviest word is the same lie side by side: tight blocks.
        heaviest = np.full(len(ids), len(words))
        by_value = np.lexsort((-word, value))
        heaviest[example[by_value]] = word[by_value]
        order = np.lexsort((ids, heaviest))
        self.ids, self.labels = ids[order], labels[order].astype(float)
        place = np.empty(len(ids), dtype=np.int64)
        place[order] = np.arange(len(ids))
        by_word = np.lexsort((place[example], word))
        self.row, self.value = place[example[by_word]].astype(np.int32), (value / norms[example])[by_word]
        # One entry per word and block with its postings' start and its largest weight.
        self.blocks = -(-len(ids) // BLOCK)
        entry, self.start = np.unique(word[by_word] * max(self.blocks, 1) + self.row // BLOCK, return_index=True)
        self.length = np.diff(np.append(self.start, len(self.row)))
        self.most = np.maximum.reduceat(self.value, self.start) if len(entry) else np.zeros(0)
        self.block = entry % max(self.blocks, 1)
        self.first = np.searchsorted(entry // max(self.blocks, 1), np.arange(len(words) + 1))
        # Words of many blocks are kept as dense columns instead: bounds and cosines of theirs are matrix products.
        spread = np.diff(self.first)
        common = np.flatnonzero(spread > max(int(self.blocks / COMMON), 1))
        self.common = np.full(len(words), -1)
        self.common[common] = np.arange(len(common))
        self.dense, self.most_of = np.zeros((self.blocks * BLOCK, len(common))), np.zeros((len(common), self.blocks))
        here = _spread(self.first[common], spread[common])
        self.most_of[np.repeat(np.arange(len(common)), spread[common]), self.block[here]] = self.most[here]
        column = np.repeat(np.arange(len(common)), np.add.reduceat(self.length[here], np.cumsum(spread[common]) - spread[common]) if len(common) else 0)
        here = _spread(self.start[here], self.length[here])
        self.dense[self.row[here], column] = self.value[here]

    def __reduce__(self):
        """Sent as the examples' counts alone, a fraction of the index; each worker builds the index anew."""
        ids, labels, lengths, word, times = self.made_of
        return _rebuilt, (self.words, self.weights, self.unknown, ids, labels, lengths, word, times, self.k)

    def vectors(self, names: pa.Array, text: np.ndarray, word: np.ndarray, times: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, known word and weight of the unit vectors of n texts; unknown words count in their length."""
        at = places_of(names, self.words)[word]
        value = (1 + np.log(times)) * np.where(at >= 0, self.weights[at] if len(self.weights) else 0.0, self.unknown)
        norms = np.sqrt(np.bincount(text, value**2, minlength=n))
        known = at >= 0
        return text[known], at[known], (value / norms[text])[known]

    def examples(self, start: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Example (from 0), word and weight of the examples at these places."""
        here = np.flatnonzero((self.row >= start) & (self.row < end))
        here = here[np.argsort(self.row[here], kind="stable")]
        entry = np.searchsorted(self.start, here, side="right") - 1
        return self.row[here] - start, np.searchsorted(self.first, entry, side="right") - 1, self.value[here]

    def nearest(self, text: np.ndarray, word: np.ndarray, value: np.ndarray, n: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """Of each of n texts the k nearest examples, ties to the smaller id, none that share no word: places and cosines
        (to nine decimals), and how many blocks were scored."""
        for start in range(0, n, TOGETHER):
            some = min(TOGETHER, n - start)
            part = slice(*np.searchsorted(text, [start, start + some]))
            yield from self._nearest(text[part] - start, word[part], value[part], some, k)

    def _nearest(self, text: np.ndarray, word: np.ndarray, value: np.ndarray, n: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        common = self.common[word]
        dense = np.zeros((n, self.dense.shape[1]))
        dense[text[common >= 0], common[common >= 0]] = value[common >= 0]
        text, word, value = text[common < 0], word[common < 0], value[common < 0]
        lengths = self.first[word + 1] - self.first[word]
        rare = np.repeat(text, lengths), _spread(self.first[word], lengths), np.repeat(value, lengths)
        text, entries, value = rare
        bound = dense @ self.most_of
        bound += np.bincount(text * self.blocks + self.block[entries], value * self.most[entries], minlength=bound.size).reshape(bound.shape)
        # The blocks of highest bounds give a k-th best cosine; of the others those that can reach it are scored.
        first = np.zeros(bound.shape, dtype=bool)
        np.put_along_axis(first, np.argsort(-bound, axis=1, kind="stable")[:, :FIRST_BLOCKS], True, axis=1)
        scores = np.zeros((n, self.blocks * BLOCK))
        self._score(scores, dense, rare, first)
        least = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] >= k else np.zeros(n)
        rest = ~first & (bound > 0) & (bound >= least[:, None] - TIE)
        self._score(scores, dense, rare, rest)
        scored = (first | rest).sum(axis=1)
        reach = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] >= k else np.zeros(n)
        for i in range(n):
            places = np.flatnonzero(scores[i] >= max(reach[i] - TIE, 1e-12))
            cosines = np.round(scores[i, places], 9)
            order = np.lexsort((self.ids[places], -cosines))[:k]
            yield places[order], cosines[order], int(scored[i])

    def _score(self, scores: np.ndarray, dense: np.ndarray, rare, chosen: np.ndarray) -> None:
        """Adds the cosines of the chosen blocks, by text and block, to ``scores``."""
        for block in np.flatnonzero(chosen.any(axis=0)):
            here, rows = np.flatnonzero(chosen[:, block]), slice(block * BLOCK, (block + 1) * BLOCK)
            scores[here, rows] = dense[here] @ self.dense[rows].T
        text, entries, value = rare
        here = chosen[text, self.block[entries]]
        text, entries, value = text[here], entries[here], value[here]
        lengths = self.length[entries]
        at = _spread(self.start[entries], lengths)
        spot = np.repeat(text, lengths) * scores.shape[1] + self.row[at]
        scores += np.bincount(spot, np.repeat(value, lengths) * self.value[at], minlength=scores.size).reshape(scores.shape)

    def vote(self, places: np.ndarray, cosines: np.ndarray) -> float:
        weights = 1 / (1.05 - np.minimum(cosines, 1.0))
        return float((weights @ self.labels[places] + self.blank) / (weights.sum() + 1))

    def votes_of_others(self, start: int, end: int) -> Iterator[float]:
        """The vote on each of these examples by the nearest others."""
        found = self.nearest(*self.examples(start, end), end - start, self.k + 1)
        for place, (places, cosines, _) in zip(range(start, end), found):
            others = places != place
            yield self.vote(places[others][: self.k], cosines[others][: self.k])


def _rebuilt(words, weights, unknown, ids, labels, lengths, word, times, k) -> Neighbours:
    return Neighbours(words, weights, unknown, ids, labels, (np.repeat(np.arange(len(ids)), lengths), word.astype(np.int64), times), k)


def _logit(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def calibration(votes: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic fit of the labels on the votes (Newton's steps, a small ridge)."""
    x = np.c_[_logit(votes), np.ones(len(votes))]
    beta, ridge = np.array([1.0, 0.0]), np.diag([1e-2, 1e-2])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (labels - p) - ridge @ (beta - [1.0, 0.0])
        beta = beta + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, gradient)
    return float(max(beta[0], 0.0)), float(beta[1])


def fitted(docs: DataFrame, labels: DataFrame) -> Neighbours:
    """The index on the driver: the words of at most ``EXAMPLES`` documents, weighed by all of ``docs``."""
    sample = labelled_sample(docs, labels, "toxic", EXAMPLES).select("doc_id", "label", "text")
    fields = "doc_id long, label int, copies long, words array<string>, times array<int>"
    found = checkpointed(sample.mapInArrow(_example_words, fields)).toArrow().sort_by("doc_id").combine_chunks()
    ids, marks, copies = (found[c].to_numpy() for c in ("doc_id", "label", "copies"))
    lists = found["words"].combine_chunks()
    times = pc.list_flatten(found["times"]).to_numpy()
    said = lists.flatten().cast(pa.string())
    words = pc.unique(said).sort() if len(said) else pa.array([], pa.string())
    word = places_of(said, words).astype(np.int64)
    example = np.repeat(np.arange(len(ids)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    frequencies, rows = document_frequencies(docs, words)
    idf = np.log((1 + rows) / (1 + frequencies)) + 1
    pull = associations(len(words), word, marks[example], copies[example]) if len(words) else np.zeros(0)
    return Neighbours(words, idf * (PLAIN + PULL * pull), PLAIN * (np.log(1 + rows) + 1), ids, marks, (example, word, times))


def scorer(docs: DataFrame, labels: DataFrame):
    """A column function of texts: struct of score, evidence and cosines, by the examples found in ``docs``."""
    spark = docs.sparkSession
    made = fitted(docs, labels)
    index = spark.sparkContext.broadcast(made)
    slope, shift = 1.0, 0.0

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in batch.column(0).to_pylist():
                end = min(start + TOGETHER, len(index.value.ids))
                found = pa.array(index.value.votes_of_others(start, end), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(range(start, end), pa.int64()), found], names=["id", "vote"])

    if len(made.ids) > made.k:
        found = spark.range(0, len(made.ids), TOGETHER).mapInArrow(votes, "id long, vote double").toArrow().sort_by("id")
        slope, shift = calibration(found["vote"].to_numpy(), made.labels)

    def judged(places: np.ndarray, cosines: np.ndarray) -> tuple[float, list[int], list[float]]:
        if not len(places):
            return index.value.blank, [], []
        score = 1 / (1 + np.exp(-np.clip(slope * _logit(index.value.vote(places, cosines)) + shift, -30, 30)))
        return float(score), index.value.ids[places].tolist(), np.minimum(cosines, 1.0).tolist()

    @F.arrow_udf("struct<score: double, evidence: array<long>, cosines: array<double>>")
    def score(texts: pa.Array) -> pa.Array:
        rows = []
        for start, end in text_slices(texts, SLICE):
            vectors = index.value.vectors(*word_counts(texts.slice(start, end - start)), end - start)
            rows += [judged(*found[:2]) for found in index.value.nearest(*vectors, end - start, index.value.k)]
        columns = list(zip(*rows)) or [[]] * 3
        kinds = [pa.float64(), pa.list_(pa.int64()), pa.list_(pa.float64())]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["score", "evidence", "cosines"])

    return lambda text: score(text.cast("string"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted (score >= 0.5), evidence (ids of the nearest), cosines.

    A text that shares no word with any example (an empty or null one, too) has no evidence and the examples' rate of
    label 1. Without labels the score is 0.25. Equal texts get equal scores, rows of a null id as well.
    """
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), scorer(docs, labels)(F.col("text")).alias("made"))
    return scored.select(
        "doc_id", held_out("doc_id").alias("held_out"), "made.score", (F.col("made.score") >= CUTOFF).cast("int").alias("predicted"),
        "made.evidence", "made.cosines",
    )


def kept_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, unchanged."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    scored = docs.select(row.alias("row"), scorer(docs, labels)(F.col("text")).alias("made"))
    return scored.filter(F.col("made.score") < CUTOFF).select("row.*")
