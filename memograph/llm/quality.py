"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

Every word has a fixed sparse random vector of +1 and -1; a word's vector is the sum of the random vectors of the
words around it in a bounded sample of labelled documents, plus its own. Rare words stand in by their form (lower,
upper, title case, digits, signs). A word said twice in a row, and a line said before, are words of their own. A
document is the mean of its words' vectors with its length and its share of different words; the network is trained
on one part of the sample and its temperature is set on the other.
"""

from __future__ import annotations

import operator
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memograph.llm.common import Known, checkpointed, fold, held_out, labelled_sample

#: Most labelled documents that are learned from, words with vectors of their own, and tasks that sum them up.
EXAMPLES, WORDS, TASKS = 8_192, 8_192, 8
WIDTH, SIGNS, REACH = 64, 6, 2
LEAST_DOCUMENTS = 5
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 60, 128, 3e-3, 1e-4
CUTOFF = 0.3
FORMS = ["<a>", "<A>", "<Aa>", "<aA>", "<1>", "<.>", "<again>", "<line>"]
CACHED_WORDS = 200_000
_tokens = re.compile(r"\w+|[^\w\s]+").findall


def form(token: str) -> str:
    if not token[0].isalnum() and token[0] != "_":
        return "<.>"
    if token.isdigit():
        return "<1>"
    return "<a>" if token.islower() else "<A>" if token.isupper() else "<Aa>" if token.istitle() else "<aA>"


def stream(text: str) -> Iterator[str]:
    """Tokens in order, with the marks of repeated tokens and lines between them."""
    lines, before = set(), None
    for line in text.split("\n"):
        if line in lines:
            yield "<line>"
        lines.add(line)
        for token in _tokens(line):
            if token == before:
                yield "<again>"
            yield token
            before = token


def index_vectors(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the few non-zero components of each word's random vector."""
    places, signs = np.empty((len(words), SIGNS), dtype=np.int64), np.empty((len(words), SIGNS))
    for i, word in enumerate(words):
        draw = np.random.default_rng(zlib.crc32(word.encode()))
        places[i], signs[i] = draw.choice(WIDTH, SIGNS, replace=False), draw.choice([-1.0, 1.0], SIGNS)
    return places, signs


class Words:
    """Vectors of the vocabulary and the forms, and the pooling of texts."""

    def __init__(self, words: list[str]):
        self.words = FORMS + words
        self.at = {w: i for i, w in enumerate(self.words)}
        self.vectors = np.zeros((len(self.words), WIDTH), dtype=np.float32)
        self.codes = Known(self._code, CACHED_WORDS)

    def __getstate__(self):
        return {"words": self.words, "vectors": self.vectors}

    def __setstate__(self, state):
        self.__init__(state["words"][len(FORMS) :])
        self.vectors = state["vectors"]

    def _code(self, token: str) -> int:
        return self.at[token] if token in self.at else self.at[form(token)]

    def contexts(self, texts: Iterator[str]) -> np.ndarray:
        """Sums of the random vectors of the neighbours of every word."""
        places, signs = index_vectors(self.words)
        made = np.zeros(len(self.words) * WIDTH)
        for text in texts:
            codes = np.fromiter((self.codes[t] for t in stream(text)), dtype=np.int64)
            for reach in range(1, REACH + 1):
                for word, near in ((codes[:-reach], codes[reach:]), (codes[reach:], codes[:-reach])):
                    for j in range(SIGNS):
                        np.add.at(made, word * WIDTH + places[near, j], signs[near, j])
        return made.reshape(len(self.words), WIDTH)

    def learn(self, contexts: np.ndarray) -> None:
        """Unit sums of the neighbours, plus a unit random vector of the word's own."""
        places, signs = index_vectors(self.words)
        own = np.zeros_like(contexts)
        np.put_along_axis(own, places, signs, axis=1)
        norms = np.sqrt((contexts**2).sum(axis=1, keepdims=True))
        self.vectors = (contexts / np.maximum(norms, 1e-9) + own / np.sqrt(SIGNS)).astype(np.float32)

    def pooled(self, text: str) -> np.ndarray:
        """Mean word vector, length and share of different tokens; zeros for a text without tokens."""
        tokens = _tokens(text)
        made = np.zeros(WIDTH + 2, dtype=np.float64)
        if not tokens:
            return made
        lines = text.split("\n")
        marks = (sum(map(operator.eq, tokens, tokens[1:])), len(lines) - len(set(lines)))
        codes = np.fromiter(map(self.codes.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        for start in range(0, len(codes), 65_536):
            made[:WIDTH] += self.vectors[codes[start : start + 65_536]].sum(axis=0, dtype=np.float64)
        for mark, n in zip(FORMS[-2:], marks):
            made[:WIDTH] += n * self.vectors[self.at[mark]]
        made[:WIDTH] /= len(tokens) + sum(marks)
        made[WIDTH:] = np.log1p(len(tokens)), len(set(tokens)) / len(tokens)
        return made


class Network:
    """Two layers, trained by Adam on the cross entropy, with a temperature for the probabilities."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Network:
        draw = np.random.default_rng(3)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        x = (x - self.mean) / self.scale
        self.w = [draw.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), draw.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        first, second, step, self.temperature = [0 * w for w in self.w], [0 * w for w in self.w], 0, 1.0
        for _ in range(EPOCHS):
            order = draw.permutation(len(x))
            for start in range(0, len(x), BATCH):
                rows = order[start : start + BATCH]
                hidden = np.tanh(x[rows] @ self.w[0] + self.w[1])
                wrong = (1 / (1 + np.exp(-np.clip(hidden @ self.w[2] + self.w[3], -30, 30))) - y[rows]) / len(rows)
                back = wrong[:, None] * self.w[2] * (1 - hidden**2)
                slopes = [x[rows].T @ back + DECAY * self.w[0], back.sum(axis=0), hidden.T @ wrong + DECAY * self.w[2], wrong.sum(keepdims=True)]
                step += 1
                for i, g in enumerate(slopes):
                    first[i], second[i] = 0.9 * first[i] + 0.1 * g, 0.999 * second[i] + 0.001 * g * g
                    self.w[i] = self.w[i] - RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
        return self

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """The temperature of least cross entropy, by a golden-section search of its logarithm between 1/4 and 8."""
        z = self.logits(x)
        loss = lambda t: np.mean(np.logaddexp(0, z / np.exp(t)) - y * z / np.exp(t))
        low, high, ratio = np.log(0.25), np.log(8.0), (5**0.5 - 1) / 2
        for _ in range(40):
            a, b = high - ratio * (high - low), low + ratio * (high - low)
            low, high = (low, b) if loss(a) <= loss(b) else (a, high)
        self.temperature = float(np.exp((low + high) / 2))

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def _per_text(sample: DataFrame, words: Words) -> tuple[np.ndarray, ...]:
    """Pooled vectors, labels and part of all examples, in the order of ids."""
    shared = sample.sparkSession.sparkContext.broadcast(words)

    @F.arrow_udf("array<double>")
    def pooled(texts: pa.Array) -> pa.Array:
        return pa.array([shared.value.pooled(t.as_py()).tolist() for t in texts], pa.list_(pa.float64()))

    rows = sample.select("doc_id", "label", (fold("doc_id") == 1).alias("aside"), pooled("text").alias("x")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return np.array([r["x"] for r in rows]), np.array([float(r["label"]) for r in rows]), np.array([r["aside"] for r in rows])


def fitted(docs: DataFrame, labels: DataFrame) -> tuple[Words, Network | float]:
    """The word vectors and the network, or the one probability that there is without labels of both kinds."""
    sample = checkpointed(labelled_sample(docs, labels, "quality", EXAMPLES).repartition(TASKS, "doc_id"))

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter(t for b in batches for text in b.column(0).to_pylist() for t in set(_tokens(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    counted = sample.select("text").mapInArrow(seen, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    frequent = counted.filter(F.col("n") >= LEAST_DOCUMENTS).orderBy(F.desc("n"), "word").limit(WORDS)
    words = Words(sorted(r["word"] for r in frequent.collect()))
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = shared.value.contexts(text for b in batches for text in b.column(0).to_pylist()).astype(np.int64)
        seen = np.flatnonzero(made.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(list(made[seen]), pa.list_(pa.int64()))], names=["word", "sums"])

    # Tasks' sums are added up in Spark, so that one row per word reaches the driver however many tasks there are.
    parts = sample.select("text").mapInArrow(summed, "word long, sums array<long>")
    sums = parts.groupBy("word").agg(*[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(WIDTH)]).collect()
    contexts = np.zeros((len(words.words), WIDTH))
    for row in sums:
        contexts[row["word"]] = row[1:]
    words.learn(contexts)
    x, y, aside = _per_text(sample, words)
    if len(set(y)) < 2:
        return words, float((y.sum() + 0.5) / (len(y) + 1))
    network = Network().fit(x[~aside], y[~aside]) if len(set(y[~aside])) == 2 else Network().fit(x, y)
    if len(set(y[aside])) == 2:
        network.calibrate(x[aside], y[aside])
    return words, network


def scorer(docs: DataFrame, labels: DataFrame):
    """A column function of texts: the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels))

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        words, network = shared.value
        if isinstance(network, float):
            return pa.array([network] * len(texts), pa.float64())
        return pa.array(network.probabilities(np.array([words.pooled(t.as_py() or "") for t in texts]).reshape(-1, WIDTH + 2)), pa.float64())

    return lambda text: score(text.cast("string"))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score (probability of label 1), predicted (score >= 0.3).

    Null and empty texts are scored as texts without words. Without labels of both kinds every score is the smoothed
    share of label 1 (0.5 without any). Equal texts get equal scores; rows of a null id are scored and never learned from.
    """
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), scorer(docs, labels)(F.col("text")).alias("score"))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))
