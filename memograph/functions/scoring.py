"""Scores of a prediction against its accepted answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from memograph.functions.text import last_line, let


def _score(hit: Column) -> Column:
    return F.when(hit, F.lit(1.0)).otherwise(F.lit(0.0))


def exact_match(prediction: Column, gold: Column) -> Column:
    return _score(F.array_contains(gold, prediction))


def contains_any(prediction: Column, gold: Column) -> Column:
    return _score(F.exists(gold, lambda g: F.contains(prediction, g)))


def last_line_match(prediction: Column, gold: Column) -> Column:
    return let(last_line(prediction), lambda line: exact_match(line, gold))


def last_line_contains(prediction: Column, gold: Column) -> Column:
    return let(last_line(prediction), lambda line: contains_any(line, gold))


def mentions_any(answer: Column, gold: Column) -> Column:
    return let(F.lower(answer), lambda text: F.exists(gold, lambda g: F.contains(text, F.lower(g))))


def mentions_all(answer: Column, gold: Column) -> Column:
    return let(F.lower(answer), lambda text: F.forall(gold, lambda g: F.contains(text, F.lower(g))))


METRICS = {
    "EM": exact_match,
    "contains": contains_any,
    "lastline_EM": last_line_match,
    "lastline_contains": last_line_contains,
}
