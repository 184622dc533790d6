"""Canonical JSON and content-derived identities."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from memograph.functions.text import let, normalize_text, strip
from memograph.session import allow_repeated_keys


def json_string(value: Column) -> Column:
    """A JSON string literal, non-ASCII characters kept as they are."""
    wrapped = F.to_json(F.array(F.coalesce(value, F.lit(""))))
    return F.substring(wrapped, 2, F.length(wrapped) - 2)


def ascii_json_string(value: Column) -> Column:
    r"""A JSON string literal in which every non-ASCII character is written as ``\uXXXX``."""
    literal = json_string(value)

    def unit(code: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(code), 4, "0")))

    def escape(ch: Column) -> Column:
        code = F.ascii(ch)
        high = F.lit(0xD800) + F.shiftright(code - 0x10000, 10)
        low = F.lit(0xDC00) + (code - 0x10000).bitwiseAND(F.lit(0x3FF))
        return (
            F.when(code < 128, ch)
            .when(code < 0x10000, unit(code))
            .otherwise(F.concat(unit(high), unit(low)))
        )

    return F.when(
        literal.rlike(r"[^\x00-\x7F]"), F.array_join(F.transform(F.split(literal, ""), escape), "")
    ).otherwise(literal)


def json_object(**fields: Column) -> Column:
    """Compact JSON object from already encoded values; keys are written in sorted order."""
    parts: list[Column] = []
    for i, key in enumerate(sorted(fields)):
        parts += [F.lit(f'{"," if i else "{"}"{key}":'), fields[key]]
    return F.concat(*parts, F.lit("}"))


def json_array(values: Column) -> Column:
    return F.to_json(values)


#: Stands before numbers that a VARIANT would write in another way; a private character no text should hold.
KEPT = "\uf8f0"
STRING = r'"(?:[^"\\]|\\.)*+"'
NUMBER = r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?"


def float_text(token: Column) -> Column:
    """A number with fraction or exponent in its shortest form: plain from 0.0001 to below 1e16, else like ``1e-05``."""

    def written(java: Column) -> Column:
        value = java.cast("double")
        size = F.abs(value)
        sign = F.when(F.startswith(java, F.lit("-")), F.lit("-")).otherwise("")
        plain = F.regexp_replace(F.regexp_replace(java.try_cast("decimal(38,21)").cast("string"), "0+$", ""), r"\.$", ".0")
        power = F.regexp_extract(java, r"E-?(\d+)$", 1)
        mark = F.when(F.contains(java, F.lit("E-")), F.lit("e-")).otherwise("e+")
        short = F.concat(F.regexp_replace(F.regexp_extract(java, r"^(-?[0-9.]+)E", 1), r"\.0$", ""), mark, F.when(F.length(power) < 2, F.lpad(power, 2, "0")).otherwise(power))
        return (
            F.when(size == float("inf"), F.concat(sign, F.lit("Infinity"))).when(size == 0, F.concat(sign, F.lit("0.0")))
            .when((size >= 1e-4) & (size < 1e16), plain).otherwise(short)
        )

    return let(token.try_cast("double").cast("string"), written)


def canonical_json(value: Column) -> Column:
    """JSON text in one form: keys sorted at every depth, no blanks, characters beyond ASCII as they are.

    Of a repeated key the last value counts. Null stays null; what is no JSON is an error. Values are read as VARIANT, which
    sorts keys by their UTF-16 units; this differs from code points only beyond the basic plane. Numbers with a fraction
    or exponent, and whole ones of many digits, are put past it as text, as it would turn 1.0 into 1.
    """
    if session := SparkSession.getActiveSession():
        allow_repeated_keys(session)

    def past(token: Column) -> Column:
        number = F.rlike(token, F.lit(f"^{NUMBER}$"))
        broken = F.rlike(token, F.lit("[.eE]"))
        kept = F.concat(F.lit(f'"{KEPT}'), F.when(broken, float_text(token)).otherwise(token), F.lit('"'))
        return F.when(number & (broken | (F.length(token) > 18)), kept).otherwise(token)

    tokens = F.regexp_extract_all(value, F.lit(rf'{STRING}|{NUMBER}|[^"\d-]+|[\s\S]'), F.lit(0))
    sorted_keys = F.to_json(F.parse_json(F.array_join(F.transform(tokens, past), "")))
    return F.regexp_replace(sorted_keys, f'"{KEPT}([^"]*)"', "$1")


def digest(value: Column, length: int) -> Column:
    return F.substring(F.sha2(value, 256), 1, length)


def task_json(prompt: Column, task_type: Column, output_contract: Column, constraints_json: Column, raw: bool = False) -> Column:
    """Canonical task. Constraints arrive as canonical JSON, or with ``raw`` as any JSON (null: none)."""
    return json_object(
        constraints=F.coalesce(canonical_json(constraints_json), F.lit("{}")) if raw else constraints_json,
        output_contract=json_string(normalize_text(output_contract)),
        prompt=json_string(normalize_text(prompt)),
        task_type=json_string(normalize_text(task_type)),
    )


def task_signature(prompt: Column, task_type: Column, output_contract: Column, constraints_json: Column, raw: bool = False) -> Column:
    return digest(task_json(prompt, task_type, output_contract, constraints_json, raw), 16)


def scope_json(
    corpus_id: Column, document_id: Column, start: Column, end: Column, unit: Column, content_hash: Column
) -> Column:
    return json_object(
        content_hash=json_string(content_hash),
        corpus_id=json_string(corpus_id),
        document_id=json_string(document_id),
        start=start.cast("string"),
        end=end.cast("string"),
        unit=json_string(unit),
    )


def scope_signature(
    corpus_id: Column, document_id: Column, start: Column, end: Column, unit: Column, content_hash: Column
) -> Column:
    return digest(scope_json(corpus_id, document_id, start, end, unit, content_hash), 16)


def entry_id(
    task: Column, scope: Column, result: Column, result_type: Column, reusable_as: Column, dependencies: Column
) -> Column:
    """Identity of an entry from the canonical task and scope JSON and its own outcome.

    Evidence, confidence, metadata and verifier state are deliberately left out.
    """
    return digest(
        json_object(
            task=task,
            scope=scope,
            result=json_string(result),
            result_type=json_string(result_type),
            reusable_as=json_array(reusable_as),
            dependencies=json_array(dependencies),
        ),
        24,
    )


def chunk_hash(value: Column) -> Column:
    return F.md5(strip(value))


def sample_document_id(mode: str, sample_id: Column, test_name: Column, haystack: Column, depth_index: Column) -> Column:
    """The stable form leaves the length out, so that shorter runs seed longer ones."""
    if mode != "stable":
        return sample_id
    depth = F.lpad(depth_index.cast("string"), 2, "0")
    return F.concat_ws("__", test_name, haystack, F.concat(F.lit("D"), depth))


def sample_content_hash(
    mode: str, context: Column, test_name: Column, haystack_hash: Column, needle: Column, depth_index: Column
) -> Column:
    if mode == "none":
        return F.lit("")
    if mode != "source":
        return digest(context, 16)
    payload = F.concat(
        F.lit('{"depth_index": '), depth_index.cast("string"),
        F.lit(', "haystack_hash": '), ascii_json_string(haystack_hash),
        F.lit(', "needle": '), ascii_json_string(needle),
        F.lit(', "test_name": '), ascii_json_string(test_name),
        F.lit("}"),
    )
    return digest(payload, 16)
