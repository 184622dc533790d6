"""Candidate packets, retrieval, search and answering from the memo."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memograph import schema as S
from memograph.functions import entries as E
from memograph.functions import facts
from memograph.functions import text as T
from memograph.operators import matching, ranking
from memograph.sources.lexical_index import LexicalIndex

NO_DOCUMENTS = "No relevant documents found."
SOURCE_SEPARATOR = "\n\n---\n\n"


def ranked_entries(requests: DataFrame, entries: DataFrame, limit: int = S.PACKET_LIMIT) -> DataFrame:
    """Best entries of any task inside the scope of each request, for its own prompt."""
    termed = entries.withColumn("entry_terms", F.array_distinct(T.search_tokens(ranking.candidate_text())))
    # Requests bring their prompt along: pairs are scored where they meet, and the terms of entries go no further.
    pairs = matching.candidates(requests, termed, ["reusable_as", "confidence", "entry_terms"], same_task=False, asked=["prompt"])
    return ranking.rank_entries(pairs, "prompt", True, limit).select(
        "request_id", "rank", "entry_id", "score", "matched_terms"
    )


def packets(
    ranked: DataFrame, entries: DataFrame,
    result_chars: int | None = S.PACKET_RESULT_CHARS, evidence_chars: int | None = S.PACKET_EVIDENCE_CHARS,
) -> DataFrame:
    """Compact form of ranked entries: bounded texts, few evidence spans, derived flags."""
    result = T.bounded(F.col("result"), result_chars)

    def span(e):
        cut = T.bounded(e["text"], evidence_chars)
        return F.struct(
            e["document_id"].alias("document_id"), e["start"].alias("start"), e["end"].alias("end"), e["unit"].alias("unit"),
            cut["text"].alias("text"), F.length(e["text"]).alias("text_chars"), cut["truncated"].alias("text_truncated"),
        )

    return ranked.join(entries, "entry_id").select(
        "request_id", "rank", "entry_id", "score", "matched_terms", "prompt", "task_type", "output_contract",
        "scope_start", "scope_end", (F.col("scope_end") - F.col("scope_start")).alias("scope_length"),
        E.fragment_kind().alias("fragment_kind"), E.can_cover().alias("can_cover_scope"),
        E.is_negative().alias("is_negative"),
        result["text"].alias("result"), F.length("result").alias("result_chars"),
        result["truncated"].alias("result_truncated"), "result_type", "reusable_as", "confidence", "dependencies",
        F.transform(F.slice("evidence", 1, S.PACKET_EVIDENCE_SPANS), span).alias("evidence"),
        F.size("evidence").alias("evidence_count"), "metadata_json",
    )


def context_packets(
    requests: DataFrame, chunks: DataFrame, limit: int = S.PACKET_LIMIT, text_chars: int | None = S.PACKET_CONTEXT_CHARS,
    index: LexicalIndex | None = None,
) -> DataFrame:
    """Best raw chunks of the document of each request, for its prompt.

    The whole document is searched, not only the requested range. With an ``index`` of the chunks only those that a token
    occurs in are met, else every chunk of a document meets every request of it.
    """
    if index is not None:
        best = index.search_documents(requests, chunks, "prompt", limit)
    else:
        texts = chunks.withColumnRenamed("content_hash", "stored_hash")
        asked = requests.select("request_id", *S.SCOPE_KEYS, "content_hash")
        pairs = texts.join(asked, S.SCOPE_KEYS).filter(E.compatible_hash(F.col("content_hash"), F.col("stored_hash")))
        best = ranking.search_scoped_chunks(requests, pairs, "prompt", limit)
    cut = T.bounded(F.col("text"), text_chars)
    return best.select(
        "request_id", "rank", "document_id", "chunk_index", "score", "matched_terms",
        cut["text"].alias("text"), F.length("text").alias("text_chars"), cut["truncated"].alias("text_truncated"),
    )


def reuse_packets(
    requests: DataFrame, entries: DataFrame, chunks: DataFrame, limit: int = S.PACKET_LIMIT, index: LexicalIndex | None = None
) -> DataFrame:
    """Per request, its at most ``limit`` memo packets and context packets, best first."""
    memo = packets(ranked_entries(requests, entries, limit), entries)
    context = context_packets(requests, chunks, limit, index=index)

    def gathered(df: DataFrame, name: str) -> DataFrame:
        rest = [c for c in df.columns if c not in ("request_id", "rank")]
        return df.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("rank", *rest))).alias(name))

    return (
        requests.select("request_id", "prompt", "document_id", "start", "end")
        .join(gathered(memo, "memo_packets"), "request_id", "left")
        .join(gathered(context, "context_packets"), "request_id", "left")
    )


DECISION = "action STRING, answer STRING, used_entry_ids ARRAY<STRING>, confidence DOUBLE, reason STRING"
Planner = Callable[[DataFrame], DataFrame]


def first_packet_planner(asked: DataFrame) -> DataFrame:
    """Answer with the result of the best packet that is an answer; ``answer_entry_id`` names its entry."""
    usable = F.get(F.filter("packets", lambda p: (p["result_type"] == "answer") & (p["result"] != "")), F.lit(0))
    found = usable.isNotNull()
    return asked.withColumns(
        {
            "action": F.when(found, "answer").otherwise("solve"),
            "answer": F.coalesce(usable["result"], F.lit("")),
            "answer_entry_id": usable["entry_id"],
            "used_entry_ids": F.when(found, F.array(usable["entry_id"])).otherwise(F.array().cast("array<string>")),
            "confidence": F.coalesce(usable["confidence"], F.lit(0.0)),
            "reason": F.lit("best packet"),
        }
    )


def python_planner(decide: Callable[[str, list], dict]) -> Planner:
    """Wrap a callback that gets a query and its packets and returns a decision dict."""

    names = ["action", "answer", "used_entry_ids", "confidence", "reason"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for row in batch.itertuples(index=False):
                raw = decide(row.prompt, [] if row.packets is None else list(row.packets))
                raw = raw if isinstance(raw, dict) else {"action": "unknown", "reason": str(raw)}
                made.append(
                    (
                        str(raw.get("action", "unknown")), str(raw.get("answer") or raw.get("result") or ""),
                        [str(i) for i in raw.get("used_entry_ids") or raw.get("use_entry_ids") or []],
                        float(raw.get("confidence", 1.0)), str(raw.get("reason", "")),
                    )
                )
            yield pd.concat([batch, pd.DataFrame(made, columns=names, index=batch.index)], axis=1)

    def plan(asked: DataFrame) -> DataFrame:
        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asked.schema)
        return asked.mapInPandas(run, f"{fields}, {DECISION}")

    return plan


def answer_from_memo(
    requests: DataFrame, entries: DataFrame, planner: Planner = first_packet_planner, limit: int = S.PACKET_LIMIT
) -> DataFrame:
    """Replay a request, or let a planner answer it from candidate entries.

    Dependencies are the ids the planner used that were really among its candidates. Evidence
    is taken from their packets. Packets hold shortened results; where a planner names the entry whose result it
    answers with, the answer is that entry's whole result.
    """
    exact = matching.exact_replays(requests, entries)
    stored = entries.select(F.col("entry_id").alias("exact_entry_id"), F.col("result").alias("stored_answer"))
    replayed = requests.select("request_id").join(exact.join(stored, "exact_entry_id"), "request_id").select(
        "request_id", F.lit("exact").alias("memo_type"), F.col("stored_answer").alias("answer"),
        F.array("exact_entry_id").alias("dependencies"), F.lit(1.0).alias("confidence"),
        F.array().cast(S.EVIDENCE).alias("evidence"), F.lit(0).cast("bigint").alias("planner_calls"),
    )
    pending = requests.join(exact, "request_id", "left_anti")
    best = packets(ranked_entries(pending, entries, limit), entries)
    listed = best.groupBy("request_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "entry_id", "result", "result_type", "confidence", "evidence"))).alias("packets")
    )
    asked = pending.select("request_id", "prompt").join(listed, "request_id", "left")
    decided = planner(asked)
    if "answer_entry_id" in decided.columns:
        whole = entries.select(F.col("entry_id").alias("answer_entry_id"), F.col("result").alias("whole_answer"))
        decided = decided.join(whole, "answer_entry_id", "left").withColumn("answer", F.coalesce("whole_answer", "answer"))
    accepted = F.lower("action").isin("answer", "final_answer") & (F.col("answer") != "")
    known = F.coalesce(F.transform("packets", lambda p: p["entry_id"]), F.array().cast("array<string>"))
    used = F.filter("used_entry_ids", lambda i: F.array_contains(known, i))
    spans = F.flatten(F.transform(F.filter("packets", lambda p: F.array_contains(used, p["entry_id"])), lambda p: p["evidence"]))
    plain = F.transform(spans, lambda e: F.struct(e["document_id"], e["start"], e["end"], e["unit"], e["text"]))
    planned = decided.select(
        "request_id",
        F.when(accepted, "memo_context_answer").otherwise("planner_action").alias("memo_type"),
        F.when(accepted, F.col("answer")).otherwise("").alias("answer"),
        F.when(accepted, used).otherwise(F.array().cast("array<string>")).alias("dependencies"),
        E.coerce_confidence(F.col("confidence").cast("string")).alias("confidence"),
        F.coalesce(F.when(accepted, plain.cast(S.EVIDENCE)), F.array().cast(S.EVIDENCE)).alias("evidence"),
        F.lit(1).cast("bigint").alias("planner_calls"),
    )
    return replayed.unionByName(planned)


def retrieve(
    queries: DataFrame, vectors: DataFrame, texts: DataFrame, top_k: int = S.RETRIEVE_TOP_K,
    rerank_top: int | None = S.RERANK_TOP, threshold: float = S.RERANK_THRESHOLD,
) -> DataFrame:
    """Vector candidates, resolved to texts, re-scored and gated.

    ``queries`` has ``query_id, query, embedding``; ``vectors`` ``vec_id, embedding``; ``texts``
    ``vec_id, text``. Without re-scoring all candidates are returned.
    """
    near = ranking.nearest(queries, vectors, "query_id", "vec_id", top_k)
    found = near.join(texts, "vec_id").join(queries.select("query_id", "query"), "query_id")
    if rerank_top is None:
        return found
    return ranking.rerank(found.drop("rank"), "query_id", "query", "text", "vec_id", rerank_top, threshold)


Synthesiser = Callable[[DataFrame], DataFrame]


def first_source(asked: DataFrame) -> DataFrame:
    """Deterministic stand-in for a model: the answer is the last line of the sources."""
    return asked.withColumn("answer", T.last_line(F.col("source_text")))


def top_sources(hits: DataFrame, order: list, count: int = 3) -> DataFrame:
    """``query_id, source_text``: the texts of the first hits, joined."""
    best = ranking.top_k(hits.drop("rank"), ["query_id"], order, count)
    return best.groupBy("query_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda s: s["text"]), SOURCE_SEPARATOR
        ).alias("source_text"),
        F.count("*").alias("sources"),
    )


def search(
    requests: DataFrame, entries: DataFrame, queries: DataFrame, vectors: DataFrame, texts: DataFrame,
    synthesise: Synthesiser = first_source, second_opinion: Synthesiser | None = None, active_scope: str | None = None, **retrieval,
) -> DataFrame:
    """Replay what is stored for a task; retrieve, synthesise and cross-check the rest.

    ``requests`` has ``request_id, task_signature`` and equals ``queries`` by id. With an active data scope only answers
    stored for it, by their content hash, are replayed.
    """
    if active_scope:
        entries = entries.filter(E.in_active_scope(F.col("content_hash"), active_scope))
    exact = matching.exact_replays_any_scope(requests, entries)
    stored = entries.select(F.col("entry_id").alias("exact_entry_id"), "result")
    known = exact.join(stored, "exact_entry_id").select(
        F.col("request_id").alias("query_id"), F.lit("memo_exact").alias("source"), F.col("result").alias("answer"),
        F.lit(0).cast("bigint").alias("sources"), F.lit("AGREED").alias("consensus"),
    )
    open_queries = queries.join(exact.select(F.col("request_id").alias("query_id")), "query_id", "left_anti")
    hits = retrieve(open_queries, vectors, texts, **retrieval)
    order = [F.desc("rerank_score"), F.asc("vec_id")] if "rerank_score" in hits.columns else [F.desc("score"), F.asc("vec_id")]
    asked = open_queries.select("query_id", "query").join(top_sources(hits, order), "query_id", "left")
    answered = synthesise(asked)
    checker = second_opinion or synthesise
    checked = checker(asked).select("query_id", F.col("answer").alias("second_answer"))
    fresh = answered.join(checked, "query_id").select(
        "query_id", F.when(F.col("source_text").isNull(), "nothing").otherwise("retrieved").alias("source"),
        F.when(F.col("source_text").isNull(), NO_DOCUMENTS).otherwise(F.col("answer")).alias("answer"),
        F.coalesce("sources", F.lit(0)).cast("bigint").alias("sources"),
        F.coalesce(facts.consensus(F.col("answer"), F.col("second_answer"))["consensus"], F.lit("AGREED")).alias("consensus"),
    )
    return known.unionByName(fresh)
