"""Text normalisation, tokenisation and cutting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from memograph import schema as S

# Every character Python regards as whitespace: Unicode white space and the four separators
# below the space. Once as a pattern, once as the characters themselves for trimming.
BLANK = r"(?U:[\s\x1C-\x1F])"
BLANK_CHARACTERS = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\x{2028}\x{2029}]"

# Words ignored when scoring memo entries and chunks.
SEARCH_STOPWORDS = "a an and are as at be by for from in is it of on or the to what which who with".split()

# Words ignored when checking lexical support of known facts.
KNOWLEDGE_STOPWORDS = (
    "a an and are as at be by for from how in is it its of on or that the this to was "
    "what when where which who why with mentioned provided text number special magic"
).split()


def _text(value: Column | str) -> Column:
    column = F.col(value) if isinstance(value, str) else value
    return F.coalesce(column, F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``, also inside its lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(value: Column | str) -> Column:
    return F.btrim(_text(value), F.lit(BLANK_CHARACTERS))


def normalize_text(value: Column | str) -> Column:
    """Lower-case, with every run of blanks collapsed to one space."""
    return F.trim(F.regexp_replace(F.lower(_text(value)), f"{BLANK}+", " "))


def search_tokens(value: Column | str) -> Column:
    """Search terms in text order, duplicates kept."""
    found = F.regexp_extract_all(F.lower(_text(value)), F.lit("[a-z0-9][a-z0-9_-]*"), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(SEARCH_STOPWORDS))


def knowledge_tokens(value: Column | str) -> Column:
    """Distinct terms of three characters or more."""
    found = F.regexp_extract_all(F.lower(_text(value)), F.lit("[a-z0-9][a-z0-9_-]{2,}"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: ~t.isin(KNOWLEDGE_STOPWORDS)))


def overlap_ratio(query_tokens: Column, other_tokens: Column) -> Column:
    """Share of the distinct query tokens that also occur on the other side; 0 for no tokens."""

    def share(wanted: Column) -> Column:
        shared = F.size(F.array_intersect(wanted, other_tokens))
        return F.try_divide(shared.cast("double"), F.size(wanted).cast("double"))

    return F.coalesce(let(F.array_distinct(query_tokens), share), F.lit(0.0))


def lexical_support(query: Column, candidate: Column) -> Column:
    """Share of query terms found in the candidate: no query terms 1.0, no candidate terms 0.0."""

    def share(both: Column) -> Column:
        wanted, offered = both["wanted"], both["offered"]
        return (
            F.when(F.size(wanted) == 0, F.lit(1.0))
            .when(F.size(offered) == 0, F.lit(0.0))
            .otherwise(F.size(F.array_intersect(wanted, offered)) / F.size(wanted))
        )

    tokens = F.struct(knowledge_tokens(query).alias("wanted"), knowledge_tokens(candidate).alias("offered"))
    return let(tokens, share)


def words(value: Column | str) -> Column:
    return F.array_remove(F.split(_text(value), f"{BLANK}+"), "")


def count_words(value: Column | str) -> Column:
    """How many ``words`` there are, without listing them: inside stripped text every run of blanks parts two words."""
    text = strip(value)
    return F.when(text == "", 0).otherwise(F.size(F.split(text, f"{BLANK}+"))).cast("bigint")


def join_slice(items: Column, start: Column, length: Column | int, separator: str = " ") -> Column:
    """Items [start, start + length) of an array, zero based, joined."""
    length = F.lit(length) if isinstance(length, int) else length
    return F.array_join(F.slice(items, start.cast("int") + 1, length.cast("int")), separator)


def pack(items: Column, size: int, separator: str = " ") -> Column:
    """Join consecutive groups of ``size`` array items; empty input gives an empty array."""

    def groups(bound: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(bound) - 1, F.lit(size))
        return F.when(
            F.size(bound) > 0, F.transform(starts, lambda i: join_slice(bound, i, size, separator))
        ).otherwise(F.array().cast("array<string>"))

    return let(items, groups)


def word_chunks(value: Column | str, words_per_chunk: int) -> Column:
    """Chunks of a fixed number of words; a text without words is its own single chunk."""
    return let(pack(words(value), words_per_chunk), lambda p: F.when(F.size(p) > 0, p).otherwise(F.array(_text(value))))


def sentences(value: Column | str) -> Column:
    parts = F.split(strip(value), f"(?<=[.!?]){BLANK}+")
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def sentence_chunks(value: Column | str, sentences_per_chunk: int) -> Column:
    return let(pack(sentences(value), sentences_per_chunk), lambda p: F.when(F.size(p) > 0, p).otherwise(F.array(_text(value))))


def char_windows(
    value: Column,
    size: int = S.INGEST_CHARS,
    overlap: int = S.INGEST_OVERLAP,
    min_chars: int = S.INGEST_MIN_CHARS,
) -> Column:
    """Overlapping character windows as array<struct<char_start, text>>; short tails are dropped."""

    def cut(text: Column) -> Column:
        starts = F.sequence(F.lit(0), F.length(text) - 1, F.lit(size - overlap))
        pieces = F.transform(
            starts,
            lambda i: F.struct(
                i.cast("bigint").alias("char_start"), F.substring(text, i + 1, F.lit(size)).alias("text")
            ),
        )
        return F.when(F.length(text) > 0, F.filter(pieces, lambda w: F.length(w["text"]) >= min_chars))

    return let(value, cut)


def bounded(value: Column, limit: int | None) -> Column:
    """struct<text, truncated>: at most ``limit`` characters; None or negative is unlimited."""
    if limit is None or limit < 0:
        return F.struct(value.alias("text"), F.lit(False).alias("truncated"))
    return F.struct(
        F.substring(value, 1, limit).alias("text"), (F.length(value) > limit).alias("truncated")
    )


def estimate_tokens(value: Column) -> Column:
    return F.floor(F.length(value) / 4).cast("bigint")


def clean_generation(value: Column | str) -> Column:
    """Drop closed reasoning blocks and everything after an unclosed one."""
    closed = F.regexp_replace(_text(value), r"(?s)<think>.*?</think>", "")
    return strip(F.substring_index(closed, "<think>", 1))


def last_line(value: Column) -> Column:
    return strip(F.substring_index(strip(value), "\n", -1))
