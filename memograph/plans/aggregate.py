"""Answers made by a callback from the pieces of a request.

The callback gets a query and pieces in order and returns a text, or a dict with ``result`` and, if it likes,
``confidence``, ``used_entry_ids``, ``evidence`` and ``metadata``. A request of more than ``fan_in`` pieces is folded as a
tree: stretches of pieces first, then what came of them, so no task ever holds more than ``fan_in`` pieces, whatever
the request. Such a callback has to accept its own results as pieces.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memograph import schema as S
from memograph.functions import entries as E
from memograph.operators.folding import SEGMENT, with_row_index
from memograph.session import ensure_checkpointing, spread

Aggregate = Callable[[str, list[dict]], str | dict]
PIECE = f"""
    query STRING, result STRING, confidence STRING, negative BOOLEAN, used ARRAY<STRING>, entry_ids ARRAY<STRING>,
    evidence {S.EVIDENCE}, metadata_json STRING
"""
ORDER = ["request_id", "negative", "scope_start", "scope_end", "entry_id"]


def _outcome(raw: str | dict, pieces: list[dict]) -> dict:
    """A piece from what the callback returned; ids it was not given are left out, the others keep their order."""
    raw = raw if isinstance(raw, dict) else {"result": str(raw), "used_entry_ids": None}
    named = raw.get("used_entry_ids")
    every = [i for p in pieces for i in p["entry_ids"]]
    given = [i for p in pieces for i in p["used"]]
    wanted = None if named is None else {str(i) for i in named}
    metadata = raw.get("metadata")
    return {
        "result": str(raw.get("result", "")), "confidence": str(raw.get("confidence", 1.0)), "negative": False,
        "used": given if wanted is None else [i for i in every if i in wanted], "entry_ids": every,
        "evidence": [{k: e.get(k) for k in ("document_id", "start", "end", "unit", "text")} for e in raw.get("evidence") or []],
        "metadata_json": json.dumps(metadata, sort_keys=True, separators=(",", ":"), ensure_ascii=False) if metadata else None,
    }


def aggregated(pieces: DataFrame, aggregate: Aggregate, fan_in: int = SEGMENT) -> DataFrame:
    """``request_id, result, confidence, used, evidence, metadata_json``: the outcome per request with pieces.

    ``pieces`` has the columns of ORDER, ``query``, ``result`` and ``confidence``; reusable pieces come before negative
    ones, each in document order. ``used`` holds the ids that count as dependencies: those the callback named, all if it
    named none. Evidence is what the callback gave, which may be none. Every level is checkpointed: no call is repeated
    because a task was lost.
    """
    ensure_checkpointing(pieces.sparkSession)
    placed = with_row_index(pieces.select(*ORDER, "query", "result", "confidence"), ORDER, "n")
    first = placed.groupBy("request_id").agg(F.min("n").alias("first"))
    own = F.array("entry_id")
    level = placed.join(first, "request_id").select(
        "request_id", (F.col("n") - F.col("first")).alias("place"), "query", "result", F.col("confidence").cast("string").alias("confidence"),
        "negative", own.alias("used"), own.alias("entry_ids"), F.array().cast(S.EVIDENCE).alias("evidence"), F.lit(None).cast("string").alias("metadata_json"),
    ).checkpoint()
    key = level.schema["request_id"].dataType.simpleString()
    schema = level.limit(0).toArrow().schema
    last = level.agg(F.max("place")).first()[0]
    if last is None:
        last = 0

    def fold(whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def made_of(rows: list[dict]) -> dict:
            made = {k: v for k, v in rows[0].items() if k != "part"} | {"place": rows[0]["part"]}
            if whole or len(rows) > 1:
                given = [{k: r[k] for k in ("result", "negative", "entry_ids", "used", "evidence")} | {"confidence": float(r["confidence"])} for r in rows]
                made |= _outcome(aggregate(rows[0]["query"], given), rows)
            return made

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # Rows come sorted, many stretches to a batch; the last one may go on in the next batch.
            kept: list[dict] = []
            for batch in batches:
                stretches = [list(rows) for _, rows in groupby(kept + batch.to_pylist(), key=lambda r: (r["request_id"], r["part"]))]
                kept = stretches.pop() if stretches else []
                yield pa.RecordBatch.from_pylist([made_of(rows) for rows in stretches], schema=schema)
            if kept:
                yield pa.RecordBatch.from_pylist([made_of(kept)], schema=schema)

        return run

    first_level = True
    while first_level or last > 0:
        parts = spread(level.withColumn("part", F.floor(F.col("place") / fan_in)), "request_id", "part").sortWithinPartitions("request_id", "part", "place")
        folded = parts.mapInArrow(fold(first_level), f"request_id {key}, place BIGINT, {PIECE}")
        # Confidences may be labels or percentages; what the next level is given is a number.
        level = folded.withColumn("confidence", E.coerce_confidence(F.col("confidence")).cast("string")).checkpoint()
        first_level, last = False, last // fan_in
    used = F.when(F.size("used") == 0, F.col("entry_ids")).otherwise(F.col("used"))
    return level.select("request_id", "result", F.col("confidence").cast("double").alias("confidence"), used.alias("used"), "evidence", "metadata_json")
