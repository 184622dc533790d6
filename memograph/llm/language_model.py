"""Language-model scores with stupid backoff, computed relationally.

Words are known by a 64-bit hash, bigrams by the two hashes of their words, so no vocabulary is kept and none is cut.
Every document is exploded into its distinct bigrams with their counts. A bigram counts if the corpus has it more often than
the document itself; otherwise the score backs off to the word's own frequency. The bigrams are dealt to parts by hash: by
the rare word in them if there is one, so that the counts of rare words, dealt in the same way, lie beside them; a bigram of
two rare words goes to both parts, the first word's scores it if other documents have it, the second word's if not. A slice
of texts sends one packed row to a part, in which a frequent word takes two bytes and a document its place in the slice; the
part answers with a sum per document, and the answers come together by slice. They say how many bigrams they tell of, so
that a slice that was cut differently when a task was repeated is an error and not a wrong score.

What is sent to all tasks is bounded and changes no score: the exact counts of the most frequent words, and of the bigrams so
frequent that they would burden one part; those are scored where the text is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memograph.llm.common import Known, stored, text_slices

BACKOFF = 0.4
#: Words whose counts are sent to all tasks (two bytes name one of them), the counts of all others are dealt by hash.
SENT, MOST_SENT = 50_000, 65_535
#: A word or bigram is hot if it makes up one of so many steps. Both words of a hot bigram are hot, so they are sent, too.
HOT_WORDS, HOT_BIGRAMS = 20_000, 20_000
#: Words whose hash a task remembers, bytes of text that it works on at a time, and bytes of text to a part.
REMEMBERED, SLICE, PART = 100_000, 3 << 20, 10 << 20
ODD = np.int64(-7046029254386353131)
RARE = np.uint16(65_535)
GRAMS = "first long, word long, n long"
PIECES = {
    "part": pa.int64(), "slice": pa.binary(), "places": pa.binary(), "sizes": pa.binary(), "n": pa.binary(), "u": pa.binary(), "v": pa.binary(),
    "rare_u": pa.binary(), "rare_v": pa.binary(), "words": pa.binary(), "times": pa.binary(), "docs": pa.binary(), "sums": pa.binary(), "told": pa.int64(),
}
ANSWERS = {name: PIECES[name] for name in ("slice", "places", "sizes", "docs", "sums", "told")}
SCORES = pa.schema([("hi", pa.int64()), ("lo", pa.int64()), ("score", pa.float64()), ("n_words", pa.int64())])


def _fields(columns: dict[str, pa.DataType]) -> str:
    return ", ".join(f"{name} {'long' if kind == pa.int64() else 'binary'}" for name, kind in columns.items())


def _words(text: str) -> list[str]:
    return text.lower().split()


def code(word: str) -> int:
    """The signed 64-bit hash of a word; the empty word is the begin and end of every text."""
    return int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


EDGE = code("")


def _coded(texts: pa.Array, known: Known) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts in a row, an edge before the first and after every text with words; words of each text."""
    made, sizes = [np.array([EDGE])], np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        words = _words(text.as_py() or "")
        if words:
            sizes[i] = len(words)
            words.append("")
            made.append(np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words)))
    return np.concatenate(made), sizes


def _runs(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal bigrams together, and where each of them starts in it."""
    key = u * ODD + v
    order = np.argsort(key)
    if np.any((np.diff(key[order]) == 0) & ((np.diff(u[order]) != 0) | (np.diff(v[order]) != 0))):
        order = np.lexsort((v, u))
    fresh = np.ones(len(u), dtype=bool)
    fresh[1:] = (np.diff(u[order]) != 0) | (np.diff(v[order]) != 0)
    return order, np.flatnonzero(fresh)


def counted_grams(docs: DataFrame) -> DataFrame:
    """Counts of words (first is null), and of the bigrams that may be hot, each a lower bound of the bigram's own.

    Every word counts, and the empty word for each text with words. A bigram is listed by the slices of text in which it
    makes up one of ``2 * HOT_BIGRAMS`` steps. The other slices together have it less often than that, so a hot one has
    at least half of its share listed; tasks add up their own first.
    """
    share = 2 * HOT_BIGRAMS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(code, REMEMBERED)
        for batch in batches:
            for start, end in text_slices(batch.column(0), SLICE):
                codes, _ = _coded(batch.column(0)[start:end], known)
                words, n = np.unique(codes[1:], return_counts=True)
                order, starts = _runs(codes[:-1], codes[1:])
                times = np.diff(np.r_[starts, len(order)])
                often = times * share >= len(order)
                at = order[starts[often]]
                first = pa.array(np.r_[np.zeros(len(words), dtype=np.int64), codes[:-1][at]], mask=np.arange(len(words) + len(at)) < len(words))
                made = [first, pa.array(np.r_[words, codes[1:][at]]), pa.array(np.r_[n, times[often]])]
                yield pa.RecordBatch.from_arrays(made, names=["first", "word", "n"])

    return docs.select("text").mapInArrow(run, GRAMS).groupBy("first", "word").agg(F.sum("n").alias("n"))


def _pairs(texts: pa.Array, known: Known) -> tuple[np.ndarray, ...]:
    """Distinct bigrams of each text: place of the text, first word, second word, times; and the words of each text."""
    codes, sizes = _coded(texts, known)
    u, v = codes[:-1], codes[1:]
    place = np.repeat(np.arange(len(sizes)), np.where(sizes > 0, sizes + 1, 0))
    order = np.lexsort((v, u, place))
    u, v, place = u[order], v[order], place[order]
    fresh = np.ones(len(u), dtype=bool)
    fresh[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1]) | (place[1:] != place[:-1])
    starts = np.flatnonzero(fresh)
    return place[starts], u[starts], v[starts], np.diff(np.r_[starts, len(u)]), sizes


class Sent:
    """The most frequent words with their counts."""

    def __init__(self, times: dict[int, int], steps: int):
        self.words = np.array(sorted(times), dtype=np.int64)
        self.times, self.steps = np.array([times[w] for w in sorted(times)], dtype=np.int64), max(steps, 1)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """The number of each word, ``RARE`` if it is not here."""
        if not len(self.words):
            return np.full(len(codes), RARE)
        at = np.minimum(np.searchsorted(self.words, codes), len(self.words) - 1)
        return np.where(self.words[at] == codes, at, RARE).astype(np.uint16)


class Hot:
    """Bigrams that make up a large part of the corpus, with the counts of them and of their words."""

    def __init__(self, rows: list[tuple[int, int, int]], sent: Sent):
        table = np.array(rows, dtype=np.int64).reshape(-1, 3)
        key = table[:, 0] * ODD + table[:, 1]
        self.table, self.key, self.steps = table[np.argsort(key)], np.sort(key), sent.steps
        self.times = np.stack([sent.times[sent.find(self.table[:, i]).astype(np.int64)] for i in (0, 1)], axis=1) if len(table) else table[:, :2]

    def find(self, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the bigrams are here, and where."""
        if not len(self.key):
            return np.zeros(len(u), dtype=bool), np.zeros(0, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.key, u * ODD + v), len(self.key) - 1)
        here = (self.table[at, 0] == u) & (self.table[at, 1] == v)
        return here, at[here]

    def scores(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return logarithms(n, self.table[at, 2] - n, self.times[at, 0], self.times[at, 1], self.steps)


def logarithms(n: np.ndarray, others: np.ndarray, first: np.ndarray, second: np.ndarray, steps: int) -> np.ndarray:
    """Of bigrams that a document has n times and all others together ``others`` times, with the counts of both words."""
    seen = np.maximum(others, 1) / np.maximum(first - n, np.maximum(others, 1))
    return n * np.log(np.where(others > 0, seen, BACKOFF * second / steps))


def hot_bigrams(docs: DataFrame, listed: DataFrame, sent: Sent) -> Hot:
    """Exact counts of the listed bigrams that can be hot: at most ``2 * HOT_BIGRAMS``, every hot one among them."""
    rows = listed.filter(F.col("n") * 2 * HOT_BIGRAMS >= sent.steps).collect()
    asked = np.array([(r["first"], r["word"], 0) for r in rows], dtype=np.int64).reshape(-1, 3)
    asked = asked[(sent.find(asked[:, 0]) != RARE) & (sent.find(asked[:, 1]) != RARE)]
    if not len(asked):
        return Hot([], sent)
    shared = docs.sparkSession.sparkContext.broadcast(Hot(asked.tolist(), sent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, known = shared.value, Known(code, REMEMBERED)
        total = np.zeros(len(hot.table), dtype=np.int64)
        for batch in batches:
            for start, end in text_slices(batch.column(0), SLICE):
                codes, _ = _coded(batch.column(0)[start:end], known)
                total += np.bincount(hot.find(codes[:-1], codes[1:])[1], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    counts = docs.select("text").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    table = shared.value.table
    return Hot([(*table[r["at"], :2].tolist(), r["n"]) for r in counts], sent)


def _part(codes: np.ndarray, parts: int) -> np.ndarray:
    return ((codes >> np.int64(20)) & np.int64(0xFFFFFFFF)) % parts


def _piece(part: int, told: int = 0, name: bytes | None = None, **arrays: np.ndarray) -> dict:
    return {"part": part, "told": told, "slice": name} | {column: a.tobytes() for column, a in arrays.items()}


def _batch(pieces: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p.get(name) for p in pieces], kind) for name, kind in PIECES.items()], names=list(PIECES))


def _dealt(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each part that occurs with the places where it does, in their order."""
    order = np.argsort(part, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(part[order]) != 0]) if len(part) else []
    for start, end in zip(starts, [*starts[1:], len(order)]):
        yield int(part[order[start]]), order[start:end]


def exploded(docs: DataFrame, sent, hot, parts: int) -> DataFrame:
    """Packed rows of the bigrams that are not hot, by part, and (below 0) of the documents of a slice with their hot scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(code, REMEMBERED)
        for batch in batches:
            ids = np.stack([batch.column(i).to_numpy() for i in (0, 1)], axis=1)
            for start, end in text_slices(batch.column(2), SLICE):
                place, u, v, n, sizes = _pairs(batch.column(2)[start:end], known)
                here, at = hot.value.find(u, v)
                sums = np.bincount(place[here], hot.value.scores(at, n[here]), len(sizes)).astype(np.float64)
                own = np.ascontiguousarray(ids[start:end])
                name = blake2b(own.tobytes(), digest_size=16).digest()
                place, u, v, n = (x[~here] for x in (place, u, v, n))
                a, b = sent.value.find(u), sent.value.find(v)
                by = np.where(b == RARE, v, np.where(a == RARE, u, u * ODD + v))
                both = np.flatnonzero((a == RARE) & (b == RARE))
                dealt = [(p, x) for p, x in _dealt(_part(by, parts))] + [(parts + p, both[x]) for p, x in _dealt(_part(u[both], parts))]
                told = len(u) + len(both)
                yield _batch([_piece(-1 - int(_part(own[:1, 0], parts)[0]), told, name, docs=own, sizes=sizes, sums=sums)])
                pieces = []
                for p, x in dealt:
                    mine, each = np.unique(place[x], return_counts=True)
                    first, second = u[x][a[x] == RARE], v[x][b[x] == RARE]
                    own_words = {"u": a[x], "v": b[x], "rare_u": first, "rare_v": second}
                    steps = np.diff(mine, prepend=0).astype(np.uint32)
                    pieces.append(_piece(p, len(x), name, places=steps, sizes=each.astype(np.uint32), n=n[x].astype(np.uint32), **own_words))
                yield _batch(pieces)

    return docs.select("hi", "lo", "text").mapInArrow(run, _fields(PIECES))


def dealt_words(rare: DataFrame, parts: int) -> DataFrame:
    """Packed rows of the counts of rare words, for both parts in which a bigram asks for them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, times = (c.to_numpy() for c in batch.columns)
            pieces = [_piece(p, words=words[x], times=times[x]) for p, x in _dealt(_part(words, parts))]
            yield _batch(pieces + [piece | {"part": piece["part"] + parts} for piece in pieces])

    return rare.select("word", "n").mapInArrow(run, _fields(PIECES))


def part_scores(pieces: pa.Table, sent: Sent, parts: int) -> pa.Table:
    """Sums of logarithms per document of every packed row of one part; rows of documents go on unchanged."""
    part = pieces.column("part")[0].as_py()
    if part < 0:
        return pieces.select(list(ANSWERS))

    def joined(name: str, kind) -> np.ndarray:
        return np.frombuffer(b"".join(x for x in pieces.column(name).to_pylist() if x), dtype=kind)

    sizes = joined("sizes", np.uint32)
    words, times = joined("words", np.int64), joined("times", np.int64)
    order = np.argsort(words)
    words, times = words[order], times[order]

    def read(name: str) -> tuple[np.ndarray, np.ndarray]:
        """Codes and counts of the bigrams' words; a rare word whose count is in another part has 0."""
        at = joined(name, np.uint16)
        rare = at == RARE
        codes, counts = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
        codes[~rare], counts[~rare] = sent.words[at[~rare]], sent.times[at[~rare]]
        codes[rare] = joined(f"rare_{name}", np.int64)
        if len(words):
            where = np.minimum(np.searchsorted(words, codes[rare]), len(words) - 1)
            counts[rare] = np.where(words[where] == codes[rare], times[where], 0)
        return codes, counts

    u, first = read("u")
    v, second = read("v")
    n = joined("n", np.uint32).astype(np.int64)
    order, starts = _runs(u, v)
    others = np.zeros(len(n), dtype=np.int64)
    if len(n):
        others[order] = np.repeat(np.add.reduceat(n[order], starts), np.diff(np.r_[starts, len(n)]))
    others -= n
    both = (joined("u", np.uint16) == RARE) & (joined("v", np.uint16) == RARE)
    mine = others > 0 if part >= parts else ~both | (others == 0)
    made = np.zeros(len(n))
    made[mine] = logarithms(n[mine], others[mine], first[mine], second[mine], sent.steps)
    sums = np.bincount(np.repeat(np.arange(len(sizes)), sizes), made, len(sizes)).astype(np.float64)
    asked = pieces.filter(pa.compute.is_valid(pieces.column("slice")))
    ends = np.cumsum([len(x) // 4 for x in asked.column("places").to_pylist()], dtype=np.int64)
    cells = [sums[start:end].tobytes() for start, end in zip([0, *ends[:-1]], ends)]
    columns = {"slice": asked.column("slice"), "places": asked.column("places"), "sums": pa.array(cells, pa.binary()), "told": asked.column("told")}
    return pa.table([columns.get(name, pa.nulls(len(asked), kind)) for name, kind in ANSWERS.items()], schema=pa.schema(ANSWERS))


def slice_scores(answers: pa.Table) -> pa.Table:
    """A row (hi, lo, score, n_words) per document of one slice, and of its copies if the same slice was read again."""
    rows = answers.to_pylist()
    own, parts = [r for r in rows if r["docs"] is not None], [r for r in rows if r["docs"] is None]
    if not own or sum(r["told"] for r in own) != sum(r["told"] for r in parts):
        raise RuntimeError("a slice of texts was cut in two ways: read the documents from files or a stored table")
    docs = np.frombuffer(own[0]["docs"], dtype=np.int64).reshape(-1, 2)
    total = np.zeros(len(docs))
    for r in parts:
        total[np.cumsum(np.frombuffer(r["places"], dtype=np.uint32))] += np.frombuffer(r["sums"], dtype=np.float64)
    score = np.frombuffer(own[0]["sums"], dtype=np.float64) + total / len(own)
    made = [docs[:, 0], docs[:, 1], score, np.frombuffer(own[0]["sizes"], dtype=np.int64)]
    return pa.table([pa.array(np.tile(x, len(own))) for x in made], schema=SCORES)


def backoff_scores(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, log_score (sum of the logarithms) and mean_log_score per word and end.

    For words u, v that the rest of the corpus has c times in a row: c / count(u), where count(u) leaves the bigram's own
    occurrences in the document out, too; without any, 0.4 * count(v) / all words. Texts without words (null ones, too) have
    n_words 0, log_score 0.0 and a null mean. Rows go by two hashes of id and text; equal rows have equal scores, each
    told apart by how many there are. Documents should come from files or a stored table, so that a repeated task reads the same.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumns({"hi": F.xxhash64("doc_id", "text"), "lo": F.xxhash64("text", F.lit(1), "doc_id")})
    grams = stored(counted_grams(rows), "grams")
    counted = grams.filter("first IS NULL").select("word", "n")
    steps = int(counted.agg(F.sum("n")).first()[0] or 0)
    most = min(max(SENT, HOT_WORDS), MOST_SENT)
    frequent = {r["word"]: r["n"] for r in counted.orderBy(F.desc("n"), "word").limit(most).collect()}
    sent = Sent(frequent, steps)
    hot = hot_bigrams(rows, grams.filter("first IS NOT NULL"), sent)
    spark = docs.sparkSession
    known = spark.createDataFrame([(w,) for w in frequent], "word long")
    rare = counted.join(F.broadcast(known), "word", "left_anti")

    parts = 1 + int(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART
    shared, shared_hot = spark.sparkContext.broadcast(sent), spark.sparkContext.broadcast(hot)
    pieces = exploded(rows, shared, shared_hot, parts).unionByName(dealt_words(rare, parts))
    answers = pieces.groupBy("part").applyInArrow(lambda t: part_scores(t, shared.value, parts), _fields(ANSWERS))
    scored = answers.groupBy("slice").applyInArrow(slice_scores, "hi long, lo long, score double, n_words long")
    scored = scored.groupBy("hi", "lo").agg(F.max("n_words").alias("n_words"), F.avg("score").alias("log_score"))
    made = rows.select("hi", "lo", "doc_id").join(scored, ["hi", "lo"])
    return made.select("doc_id", "n_words", "log_score", F.when(F.col("n_words") > 0, F.col("log_score") / (F.col("n_words") + 1)).alias("mean_log_score"))
