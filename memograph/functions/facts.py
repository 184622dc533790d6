"""Checks on quantitative statements: provenance, agreement, triples, guarding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from memograph import schema as S
from memograph.functions.text import estimate_tokens, let, strip

# What counts as a quantitative statement, tried in this order.
FIGURE_PATTERNS = [
    r"\$[\d,]+\.?\d*[MBKTmkbt]?",
    r"\d+\.?\d*\s*%",
    r"\b\d{1,3}(?:,\d{3})+\b",
    r"\b\d+\.\d+[MBKTmkbt]\b",
]


def figures(value: Column) -> Column:
    """Distinct figures in order of pattern, then of position."""
    found = [F.regexp_extract_all(value, F.lit(p), F.lit(0)) for p in FIGURE_PATTERNS]
    return F.array_distinct(F.concat(*found))


def missing_from(facts: Column, source: Column) -> Column:
    return F.filter(facts, lambda f: ~F.contains(source, f))


def grounding(result: Column, source: Column) -> Column:
    """struct<grounding, verified, unverified> of a result against the text it came from."""

    def judged(checked: Column) -> Column:
        verified, unverified = checked["verified"], checked["unverified"]
        label = (
            F.when(F.size(unverified) == 0, F.lit("GROUNDED"))
            .when(F.size(verified) == 0, F.lit("INFERRED"))
            .otherwise(F.lit("PARTIAL"))
        )
        return F.struct(label.alias("grounding"), verified.alias("verified"), unverified.alias("unverified"))

    def sorted_out(found: Column) -> Column:
        verified = F.filter(found, lambda f: F.contains(source, f))
        return F.struct(verified.alias("verified"), missing_from(found, source).alias("unverified"))

    return let(let(figures(result), sorted_out), judged)


def consensus(primary: Column, second: Column) -> Column:
    """struct<consensus, primary_facts, second_facts, divergent> of two independent answers."""

    def judged(seen: Column) -> Column:
        agreed = F.size(seen["divergent"]) == 0
        return F.struct(
            F.when(agreed, F.lit("AGREED")).otherwise(F.lit("DISPUTED")).alias("consensus"),
            seen["facts"].alias("primary_facts"), figures(second).alias("second_facts"), seen["divergent"].alias("divergent"),
        )

    def compared(found: Column) -> Column:
        return F.struct(found.alias("facts"), missing_from(found, second).alias("divergent"))

    return let(let(figures(primary), compared), judged)


def guard(result: Column) -> Column:
    """How a cached result may enter a context: pass, ephemeral or summarise."""
    tokens = estimate_tokens(result)
    return (
        F.when(tokens > S.SUMMARISE_TOKENS, F.lit("summarise"))
        .when(tokens > S.EPHEMERAL_TOKENS, F.lit("ephemeral"))
        .otherwise(F.lit("pass"))
    )


def triples(value: Column) -> Column:
    """array<struct<subject, relation, object>> from lines of the form ``a | b | c``."""
    rows = F.transform(
        F.split(strip(value), "\n"), lambda line: F.transform(F.split(line, r"\|"), strip)
    )
    return F.transform(
        F.filter(rows, lambda parts: F.size(parts) >= 3),
        lambda p: F.struct(p[0].alias("subject"), p[1].alias("relation"), p[2].alias("object")),
    )


def gate_reasons(
    top_score: Column, margin: Column, fact_count: Column, support: Column, always: bool = False
) -> Column:
    """Why a known-fact candidate needs a second look; an empty array means it does not."""
    checks = [
        (F.lit(always), "always_on"),
        (top_score < S.SCORE_TRIGGER, "near_score_threshold"),
        (margin < S.MARGIN_TRIGGER, "low_margin"),
        (fact_count > 1, "multi_fact_candidate"),
        (support < S.MIN_LEXICAL_SUPPORT, "weak_lexical_support"),
    ]
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in checks]))
