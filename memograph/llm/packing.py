"""Best-fit packing of token sequences (best two fit).

Only lengths decide how documents are packed, so the plan is made on the counts per length: at most
``capacity`` numbers, however many documents there are. Bins of equal content are planned at once. A bin is
filled greedily with the longest document that fits; then its smallest document gives way to the two unpacked
ones that together fit the widened gap best, if they fill more of it. Documents find their bin by their rank
among equal lengths, which comes from counts per task and length: no group of documents is ever in one place.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memograph.llm.common import Known, byte_letters, stored

CAPACITY = 2048
SEPARATOR = 0
CACHED_WORDS = 800_000
PIECE_FIELDS = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, task_rank long"


#: Fixed value: the word pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteTokens:
    """Ids of texts by a byte-level tokenizer file, through a memory of words.

    A space between two characters that are not white space always begins a new word of the pattern, so the parts
    between such spaces are encoded on their own, new ones by a coder for single words with the file's vocabulary.
    Texts with other white space, and parts that may hold a special token, are encoded by the tokenizer itself.
    """

    def __init__(self, path: str):
        import json
        import os
        import re

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            vocab = json.load(file)["model"]["vocab"]
        byte_of = {letter: b for b, letter in enumerate(byte_letters())}
        ranks = {bytes(map(byte_of.__getitem__, token)): i for token, i in vocab.items()}
        self.coder = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        # White space of the pattern other than spaces and line ends; rare, so texts with it are encoded whole.
        self.rare = re.compile("[\t\v\f\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search
        self.first = Known(self._encode, CACHED_WORDS // 8)
        self.inner = Known(self._part, CACHED_WORDS)

    def _part(self, part: str) -> bytes:
        if "<|" in part:
            return self._encode(" " + part)
        return array("I", self.coder.encode_ordinary(" " + part)).tobytes()

    def _encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __call__(self, text: str) -> bytes:
        """The ids as unsigned 32-bit little-endian integers."""
        if not text:
            return b""
        if "  " in text or " \n" in text or "\n " in text or text[0] == " " or text[-1] == " " or self.rare(text):
            return self._encode(text)
        first, *rest = text.split(" ")
        return self.first[first] + b"".join(map(self.inner.__getitem__, rest))


_TOKENS: dict[str, ByteTokens] = {}


def byte_tokens(path: str) -> ByteTokens:
    """One per Python worker and file."""
    if path not in _TOKENS:
        _TOKENS[path] = ByteTokens(path)
    return _TOKENS[path]


def cut(ids: bytes, capacity: int) -> list[tuple[int, int, int]]:
    """Start, length and checksum of each piece: full ones, behind a first one that takes what is over."""
    n = len(ids) // 4
    if n <= capacity:
        return [(0, n, zlib.crc32(ids))]
    over = n % capacity
    ends = ([over] if over else []) + list(range(over + capacity, n + 1, capacity))
    made, start = [], 0
    for end in ends:
        made.append((start, end - start, zlib.crc32(ids[4 * start : 4 * end])))
        start = end
    return made


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every document's ids, the separator at its end included.

    A null or empty text is the separator alone; every row is its own document, also with a repeated or null id.
    ``task`` and ``task_rank`` number the pieces of equal length that one task made.
    """
    schema = pa.schema(
        [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
         ("ids_crc32", pa.int64()), ("task", pa.int32()), ("task_rank", pa.int64())]
    )
    ending = array("I", [SEPARATOR]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens, task, seen = byte_tokens(tokenizer_path), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for number, (start, length, crc) in enumerate(cut(tokens(text.as_py() or "") + ending, capacity)):
                    rows.append((doc_id, number, start, length, crc, task, seen[length]))
                    seen[length] += 1
            columns = list(zip(*rows)) or [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECE_FIELDS)


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, int, list[int]]]:
    """Bins as (first bin number, bins of this content, lengths in them), which use every counted piece once."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    planned, number = [], 0
    while left.any():
        content, gap = [], capacity
        while (fitting := np.flatnonzero(left[: gap + 1])).size:
            content.append(int(fitting[-1]))
            left[content[-1]] -= 1
            gap -= content[-1]
        if len(content) > 1 and gap:
            content = _two_for_one(content, gap, left)
        each = Counter(content)
        times = 1 + min(int(left[length]) // n for length, n in each.items())
        for length, n in each.items():
            left[length] -= n * (times - 1)
        planned.append((number, times, content))
        number += times
    return planned


def _two_for_one(content: list[int], gap: int, left: np.ndarray) -> list[int]:
    """Swap the smallest length for the two that fit its room best, when they fill more of it than it does."""
    smallest = content[-1]
    room = gap + smallest
    lengths = np.flatnonzero(left[: room + 1])
    best, pair = smallest, None
    for one in lengths[::-1]:
        if 2 * one < best:
            break
        at = np.searchsorted(lengths, min(room - one, one), side="right") - 1
        if at >= 0 and lengths[at] == one and left[one] < 2:
            at -= 1
        if at >= 0 and one + lengths[at] > best:
            best, pair = int(one + lengths[at]), (int(one), int(lengths[at]))
            if best == room:
                break
    if pair is None:
        return content
    left[smallest] += 1
    for length in pair:
        left[length] -= 1
    return content[:-1] + list(pair)


def slots(planned: list[tuple[int, int, list[int]]]) -> list[tuple[int, int, int, int, int]]:
    """Per place of a content: length, ranks [first, last) of that length that go there, first bin, offset."""
    used, made = Counter(), []
    for number, times, content in planned:
        offset = 0
        for length in content:
            made.append((length, used[length], used[length] + times, number, offset))
            used[length] += times
            offset += length
    return made


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces with ``length``, ``task`` and ``task_rank``.

    ``pieces`` must be a stored table, as it is read twice. Lengths are 1 to ``capacity``. The counts that reach
    the driver are one per length; the slots sent to the tasks are bounded by the contents that are planned, each
    of which uses up a length (a few thousand rows for 2,048 lengths).
    """
    spark: SparkSession = pieces.sparkSession
    per_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = per_task.select(
        F.col("length").alias("_length"), F.col("task").alias("_task"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before")
    )
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = spark.createDataFrame(
        slots(plan_bins(counts, capacity)), "_at long, _first long, _last long, _bin long, _offset long"
    )
    ranked = pieces.join(firsts, (F.col("length") == F.col("_length")) & (F.col("task") == F.col("_task"))).withColumn(
        "_rank", F.col("task_rank") + F.col("_before")
    )
    here = (F.col("length") == F.col("_at")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_last"))
    return ranked.join(F.broadcast(places), here).select(
        *pieces.columns, (F.col("_bin") + F.col("_rank") - F.col("_first")).alias("sequence_id"), F.col("_offset").alias("offset")
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Every document's pieces with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = stored(token_pieces(docs, tokenizer_path, capacity), "pieces")
    return pack_pieces(pieces, capacity).drop("task", "task_rank")
