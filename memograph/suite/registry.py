"""Registration of queries and assembly of their checking SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from memograph.sources.views import Views
from memograph.suite.oracle_views import VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _with_views(body: str) -> str:
    """Prepend the common table expressions a statement uses, in dependency order."""
    needed: list[str] = []

    def visit(text: str, inside: tuple[str, ...] = ()) -> None:
        for name in VIEWS:
            if name not in needed and name not in inside and re.search(rf"\b{name}\b", text):
                visit(VIEWS[name], (*inside, name))
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body
    parts = ",\n".join(f"{name} AS ({VIEWS[name].strip()})" for name in needed)
    rest = f",\n{body[4:].lstrip()}" if body.startswith("WITH") else f"\n{body}"
    return f"WITH RECURSIVE {parts}{rest}"


def query(name: str, oracle: str | None = None):
    """Register a function of the views as a query; SQL names views with a ``v_`` prefix."""

    def register(function: Callable[[Views], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return function(Views(spark, folder))

        run.__name__ = name
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = _with_views(oracle.strip())
        return function

    return register


def load_all() -> None:
    from memograph.suite import (  # noqa: F401
        composites,
        counting,
        graphs,
        joining,
        ranking,
        scalars,
        scanning,
        stretches,
    )
