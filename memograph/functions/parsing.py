"""Parsing of model output, prompts, paths and small settings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from memograph.functions.text import LINE_BREAK, let, strip

# Openings that mark the last line of a prompt as its question.
QUESTION_OPENINGS = "^(?:what|which|who|where|when|how) "
FALLBACK_QUESTION = "Answer the question from the provided context."

# Lower-case query fragments that are cheap enough for the small model.
CHEAP_KEYWORDS = ["classify", "extract", "find", "count", "identify", "list", "check"]


def json_object_text(value: Column) -> Column:
    """Text from the first ``{`` to the last ``}`` if that is valid JSON, else ``{}``."""
    cut = F.regexp_extract(value, r"(?s)\{.*\}", 0)
    # Parsers stop at the end of the first value; as the only item of an array it must be all.
    alone = F.concat(F.lit("["), cut, F.lit("]"))
    valid = F.try_parse_json(alone).isNotNull() & (F.size(F.from_json(alone, "array<string>")) == 1)
    return F.when((cut != "") & valid, cut).otherwise(F.lit("{}"))


def planner_response(value: Column, fallback_ids: Column) -> Column:
    """struct<action, answer, used_entry_ids, confidence, reason>, recovering cut-off JSON."""
    parsed = json_object_text(value)
    whole = ~parsed.rlike(r"^\{\s*\}$")
    answer_pattern = r'(?s)"answer"\s*:\s*"([^"\\]*(?:\\.[^"\\]*)*)"'
    partial = value.rlike(answer_pattern)
    raw = F.regexp_extract(value, answer_pattern, 1)
    decoded = F.get(F.from_json(F.concat(F.lit('["'), raw, F.lit('"]')), "array<string>"), 0)
    ids = F.regexp_extract_all(value, F.lit('"([a-f0-9]{24})"'), F.lit(1))
    stated = F.regexp_extract(value, r'"confidence"\s*:\s*([0-9.]+)', 1).try_cast("double")

    def field(name: str) -> Column:
        return F.get_json_object(parsed, f"$.{name}")

    def build(action: Column, answer: Column, used: Column, confidence: Column, reason: Column) -> Column:
        return F.struct(
            action.alias("action"), answer.alias("answer"), used.alias("used_entry_ids"),
            confidence.alias("confidence"), reason.alias("reason"),
        )

    return (
        F.when(
            whole,
            build(
                F.coalesce(field("action"), F.lit("answer")),
                F.coalesce(field("answer"), field("result"), F.lit("")),
                F.coalesce(F.from_json(field("used_entry_ids"), "array<string>"), fallback_ids),
                F.coalesce(field("confidence").try_cast("double"), F.lit(0.75)),
                F.coalesce(field("reason"), F.lit("model returned structured plan")),
            ),
        )
        .when(
            partial,
            build(
                F.lit("answer"),
                F.coalesce(decoded, raw),
                F.when(F.size(ids) > 0, ids).otherwise(fallback_ids),
                F.coalesce(stated, F.lit(0.6)),
                F.lit("model returned partial JSON; extracted answer field"),
            ),
        )
        .otherwise(
            build(F.lit("answer"), value, fallback_ids, F.lit(0.5), F.lit("model returned non-json answer"))
        )
    )


def split_prompt(value: Column, may_ask: Column | bool = True) -> Column:
    """struct<context, question> of a prompt that carries both.

    Where ``may_ask`` is false the prompt is known to be context only: it stays whole, whatever its last line looks like.
    """
    return let(strip(value), lambda text: _split_prompt(text, F.lit(may_ask) if isinstance(may_ask, bool) else may_ask))


def _split_prompt(text: Column, may_ask: Column) -> Column:
    marked = r"(?s)^(.*)\nText:(.*)$"
    head = strip(F.regexp_extract(text, marked, 1))
    lines = F.filter(F.split(text, LINE_BREAK), lambda line: strip(line) != "")
    last = strip(F.get(lines, F.size(lines) - 1))
    before = strip(F.array_join(F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0))), "\n"))
    asks = last.endswith("?") | F.lower(last).rlike(QUESTION_OPENINGS)

    def pair(context: Column, question: Column) -> Column:
        return F.struct(context.alias("context"), question.alias("question"))

    return (
        F.when(text == "", pair(F.lit(""), F.lit("")))
        .when(~may_ask, pair(text, F.lit(FALLBACK_QUESTION)))
        .when(head != "", pair(head, strip(F.concat(F.lit("Text:"), F.regexp_extract(text, marked, 2)))))
        .when((F.size(lines) >= 2) & asks & (before != ""), pair(before, last))
        .otherwise(pair(text, F.lit(FALLBACK_QUESTION)))
    )


def task_from_path(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.coalesce(strip(F.try_element_at(parts, F.lit(-2))), F.lit(""))


def length_from_path(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.regexp_extract(strip(F.try_element_at(parts, F.lit(-3))), r"_(\d+)$", 1)


def safe_segment(value: Column, max_len: int = 180) -> Column:
    """A path segment made of safe characters only; never empty."""
    replaced = F.regexp_replace(strip(value), "[^a-zA-Z0-9._-]+", "_")
    trimmed = F.regexp_replace(replaced, "^[._-]+|[._-]+$", "")
    return F.left(F.coalesce(F.nullif(trimmed, F.lit("")), F.lit("default")), F.lit(max_len))


def parse_lengths(value: Column, distinct: bool = True, positive_only: bool = True) -> Column:
    """array<bigint> from a list such as ``8k, 16000``; malformed items raise."""
    items = F.filter(F.transform(F.split(value, ","), lambda p: F.lower(strip(p))), lambda t: t != "")
    numbers = F.transform(
        items,
        lambda t: F.when(
            t.endswith("k"), (F.regexp_replace(t, "k$", "").cast("double") * 1000).cast("bigint")
        ).otherwise(t.cast("bigint")),
    )
    if positive_only:
        numbers = F.filter(numbers, lambda n: n > 0)
    return F.array_distinct(numbers) if distinct else numbers


def depth_values(intervals: Column) -> Column:
    """Evenly spaced depths in percent from 0 to 100; one interval or fewer gives just 0."""
    steps = F.sequence(F.lit(0), F.greatest(intervals.cast("int") - 1, F.lit(0)))
    return F.when(
        intervals > 1,
        F.transform(steps, lambda i: F.round(i * (F.lit(100.0) / (intervals.cast("double") - 1)), 6)),
    ).otherwise(F.array(F.lit(0.0)))


def fill_template(template: Column, arguments: Column) -> Column:
    """Replace ``{1}``, ``{2}``, ... by the arguments, in order."""
    numbered = F.transform(arguments, lambda a, i: F.struct((i + 1).alias("n"), a.alias("v")))
    return F.aggregate(
        numbered,
        strip(template),
        lambda text, a: F.replace(text, F.concat(F.lit("{"), a["n"].cast("string"), F.lit("}")), a["v"]),
    )


def data_kind(needle_path: Column, haystack_path: Column) -> Column:
    joined = F.concat_ws(" ", needle_path, haystack_path)
    return (
        F.when(F.contains(joined, F.lit("benchmark_fixtures")), F.lit("fixture"))
        .when(F.contains(joined, F.lit("benchmark_data")), F.lit("official_or_downloaded"))
        .otherwise(F.lit("custom"))
    )


def route_model(query: Column, cheap: str = "small", strong: str = "large") -> Column:
    """Keyword routing by substring."""
    lowered = F.lower(query)
    easy = F.lit(False)
    for keyword in CHEAP_KEYWORDS:
        easy = easy | F.contains(lowered, F.lit(keyword))
    return F.when(easy, F.lit(cheap)).otherwise(F.lit(strong))


def first_text(*candidates: Column) -> Column:
    """First candidate with visible text, stripped; empty string if there is none."""
    return F.coalesce(*[F.nullif(strip(c), F.lit("")) for c in candidates], F.lit(""))
