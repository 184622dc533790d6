"""Predicates and classifications of memo entries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from memograph import schema as S
from memograph.functions.text import strip


def is_rejected(status: Column | str = "verifier_status") -> Column:
    return (F.col(status) if isinstance(status, str) else status) == S.REJECTED


def offers(mode: str, modes: Column | str = "reusable_as") -> Column:
    return F.array_contains(modes, mode)


def is_negative(modes: Column | str = "reusable_as", result_type: Column | str = "result_type") -> Column:
    kind = F.col(result_type) if isinstance(result_type, str) else result_type
    return offers(S.RULED_OUT, modes) | (kind == S.NOT_FOUND)


def can_cover(modes: Column | str = "reusable_as", status: Column | str = "verifier_status") -> Column:
    column = F.col(modes) if isinstance(modes, str) else modes
    return ~is_rejected(status) & F.arrays_overlap(column, F.array(*map(F.lit, S.COVER_MODES)))


def fragment_kind(modes: Column | str = "reusable_as", result_type: Column | str = "result_type") -> Column:
    """Role of an entry for the planner; the first matching role wins."""
    kind = F.col(result_type) if isinstance(result_type, str) else result_type
    role = F.when(is_negative(modes, result_type), F.lit("ruled_out_region"))
    for mode in (S.SEARCH_HINT, S.SUPPORTING_FACT, S.AGGREGATION_COMPONENT, S.EXACT_ANSWER):
        role = role.when(offers(mode, modes), F.lit(mode))
    return role.otherwise(F.coalesce(F.nullif(kind, F.lit("")), F.lit("unknown")))


def compatible_hash(left: Column, right: Column) -> Column:
    """An empty content hash on either side matches anything. Not transitive: never group by it."""
    return (left == right) | (left == "") | (right == "")


def _unit_interval(value: Column) -> Column:
    return F.when(F.isnan(value), F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def coerce_confidence(value: Column, default: float = 1.0) -> Column:
    """Confidence in [0, 1] from a label, a percentage or a number given as text."""
    label = F.lower(strip(value))
    named = F.lit(None).cast("double")
    for name, number in {**S.CONFIDENCE_LABELS, "unknown": float(default)}.items():
        named = F.when(label == name, F.lit(number)).otherwise(named)
    share = F.when(label.endswith("%"), strip(F.regexp_replace(label, "%$", "")).try_cast("double") / 100)
    number = F.coalesce(label.try_cast("double"), F.lit(float(default)))
    scaled = F.when((number > 1) & (number <= 100), number / 100).otherwise(number)
    return _unit_interval(F.coalesce(named, share, scaled))


def in_active_scope(scope_hash: Column, active: str | None) -> Column:
    """Rows of the active data scope; without an active scope everything qualifies."""
    return F.lit(True) if not active else scope_hash == active
