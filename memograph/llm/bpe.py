"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

An automaton over the vocabulary gives, for every position of a word, the tokens that end there. For each
prefix exactly one of them can be last: the one that the last token of the prefix before it does not merge
with. That token is kept per prefix, and the kept tokens are followed back from the whole word. The ids are
those that merging by rank gives, without running the merges.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memograph.llm.common import Known, byte_letters

CACHED_WORDS = 300_000
#: Fixed values of the tokenizer file's format: its word pattern, and white space as its pattern language has it.
SPACE = r"\t-\r \x85\xa0  -     　"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^" + SPACE + r"\p{L}\p{N}]+"
ENCODED_FIELDS = "doc_id long, n_tokens long, ids binary, decoded string"
DIGEST_FIELDS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class WordBpe:
    """Encoder of a tokenizer file of byte-level merges with a word-end mark, lower case, white space dropped."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        end = model["end_of_word_suffix"]
        known = model["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (max(known.values()) + 1)
        for token, i in known.items():
            self.tokens[i] = token
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        letters = byte_letters()
        self.inside = {b: letters[b] for b in range(256)}
        # A letter that ends a word is another letter: shifted, so that tokens stay plain strings.
        self.last = {b: chr(ord(letters[b]) + 4096) for b in range(256)}

        def plain(token: str) -> str:
            return token[: -len(end) - 1] + chr(ord(token[-len(end) - 1]) + 4096) if token.endswith(end) and token != end else token

        self.automaton = ahocorasick.Automaton()
        for token, i in model["vocab"].items():
            self.automaton.add_word(plain(token), (i, len(plain(token))))
        self.automaton.make_automaton()
        vocab = model["vocab"]
        self.merged, self.parts, self.rank = {}, {}, {}
        for rank, (left, right) in enumerate(model["merges"]):
            whole, pair = vocab[left + right], (vocab[left], vocab[right])
            self.merged[pair], self.parts[whole], self.rank[whole] = rank, pair, rank
        self.find = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.spaces = regex.compile(f"[{SPACE}]+").split
        # Separators that Python splits at and the pattern doesn't; beyond ASCII both agree.
        self.control = regex.compile("[\x1c-\x1f]").search
        self.fits = Known(self._fits, CACHED_WORDS)
        self.words = Known(self._word, CACHED_WORDS)
        self.chunks = Known(self._chunk, CACHED_WORDS)

    def _fits(self, pair: tuple[int, int]) -> bool:
        """Whether the two tokens stay apart side by side.

        From the whole tokens back in time, the later made of the two at the seam is taken apart. They would have
        joined if their merge comes before either is built into the larger token it is part of.
        """
        left, right = pair
        left_until = right_until = len(self.merged)
        while True:
            rank = self.merged.get((left, right))
            if rank is not None and rank < left_until and rank <= right_until:
                return False
            made_left, made_right = self.rank.get(left, -1), self.rank.get(right, -1)
            if made_left < 0 and made_right < 0:
                return True
            if made_right >= made_left:
                right_until, right = made_right, self.parts[right][0]
            else:
                left_until, left = made_left, self.parts[left][1]

    def _word(self, word: str) -> tuple[int, ...]:
        """Ids of one word of the pattern."""
        raw = word.encode("utf-8", "surrogatepass")
        letters = "".join(self.inside[b] for b in raw[:-1]) + self.last[raw[-1]]
        final, fits = [None] * len(letters), self.fits
        for at, (token, length) in self.automaton.iter(letters):
            before = at - length
            if final[at] is None and (before < 0 or final[before] is not None and fits[final[before][0], token]):
                final[at] = (token, before)
        ids, at = [], len(letters) - 1
        while at >= 0:
            token, at = final[at]
            ids.append(token)
        return tuple(reversed(ids))

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a part without white space; letters are composed and lowered one by one."""
        chunk = unicodedata.normalize("NFC", chunk)
        lowered = "".join(map(str.lower, chunk)) if "Σ" in chunk else chunk.lower()
        return array("I", [i for word in self.find(lowered) for i in self.words[word]]).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as unsigned 32-bit little-endian integers."""
        made = []
        for n, part in enumerate(self.cut(text) if self.cut and "<|" in text else [text]):
            if n % 2:
                made.append(array("I", [self.special[part]]).tobytes())
            else:
                chunks = filter(None, self.spaces(part)) if self.control(part) else part.split()
                made.extend(map(self.chunks.__getitem__, chunks))
        return b"".join(made)

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.tokens.__getitem__, array("I", ids)))


_ENCODERS: dict[str, WordBpe] = {}


def word_bpe(path: str) -> WordBpe:
    """One per Python worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordBpe(path)
    return _ENCODERS[path]


def encode(docs: DataFrame, tokenizer_path: str, digests: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, and the ids with the decoded text, or with ``digests`` the SHA-256 of both.

    A null text is encoded as an empty one: no ids, and the digest of nothing. Every row is encoded on its own,
    so repeated rows, null ids and other columns change nothing.
    """
    fields = DIGEST_FIELDS if digests else ENCODED_FIELDS
    kinds = [pa.int64(), pa.int64(), pa.string() if digests else pa.binary(), pa.string()]
    schema = pa.schema([pa.field(f.split()[0], k) for f, k in zip(fields.split(", "), kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_bpe(tokenizer_path)
        for batch in batches:
            counts, left, right = [], [], []
            for text in batch.column(1):
                ids = coder.encode(text.as_py() or "")
                decoded = coder.decode(ids)
                counts.append(len(ids) // 4)
                left.append(hashlib.sha256(ids).hexdigest() if digests else ids)
                right.append(hashlib.sha256(decoded.encode()).hexdigest() if digests else decoded)
            made = [batch.column(0), pa.array(counts, kinds[1]), pa.array(left, kinds[2]), pa.array(right, kinds[3])]
            yield pa.RecordBatch.from_arrays(made, schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, fields)
