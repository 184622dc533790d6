"""Scans, stored-table maintenance and entry predicates."""

from pyspark.sql import functions as F

from memograph import schema as S
from memograph.functions import entries as E
from memograph.functions import identity as I
from memograph.functions import text as T
from memograph.operators import graph, ranking, samples
from memograph.plans import retrieval
from memograph.sources.tables import KEYS, upsert
from memograph.suite import oracle_views as O
from memograph.suite.registry import query

SCOPE_ROW = ["entry_id", "document_id", "scope_start", "scope_end"]


@query("scan_documents", rf"""
SELECT doc_id, source, length({O.strip('text')})::BIGINT AS n_text, sha256({O.strip('text')}) AS text_hash
FROM documents WHERE {O.strip('text')} <> ''
""")
def scan_documents(v):
    text = T.strip("text")
    return v.table("documents").filter(text != "").select(
        "doc_id", "source", F.length(text).cast("bigint").alias("n_text"), F.sha2(text, 256).alias("text_hash")
    )


@query("memo_json_roundtrip", """
SELECT entry_id, prompt, document_id, scope_start, scope_end, array_to_string(reusable_as, ',') AS modes,
    n_evidence::BIGINT AS evidence_spans, len(dependencies)::BIGINT AS dependency_count, confidence, metadata_json
FROM v_memo
""")
def memo_json_roundtrip(v):
    written = v.memo.select(F.to_json(F.struct("*")).alias("line"))
    read = written.select(F.from_json("line", S.MEMO_ENTRIES).alias("e")).select("e.*")
    return read.select(
        "entry_id", "prompt", "document_id", "scope_start", "scope_end",
        F.array_join("reusable_as", ",").alias("modes"), F.size("evidence").cast("bigint").alias("evidence_spans"),
        F.size("dependencies").cast("bigint").alias("dependency_count"), "confidence", "metadata_json",
    )


@query("memo_all_entries", """
SELECT created_at, entry_id, document_id, scope_start, scope_end, result, result_type, verifier_status, task_signature
FROM v_memo ORDER BY created_at, entry_id
""")
def memo_all_entries(v):
    return v.outline.select(
        "created_at", *SCOPE_ROW, "result", "result_type", "verifier_status", "task_signature"
    ).orderBy("created_at", "entry_id")


@query("memo_upsert_latest", """
SELECT entry_id, 'not_required' AS verifier_status,
    CASE WHEN verifier_status = 'rejected' THEN '{"again":true}' ELSE metadata_json END AS metadata_json, confidence
FROM v_memo
""")
def memo_upsert_latest(v):
    again = v.fragments.filter(E.is_rejected()).withColumns(
        {"verifier_status": F.lit(S.NOT_REQUIRED), "metadata_json": F.lit('{"again":true}')}
    )
    merged = upsert(v.memo, again, KEYS["memo_entries"])
    return merged.select("entry_id", "verifier_status", "metadata_json", "confidence")


@query("edge_upsert", """
SELECT parent_entry_id, child_entry_id, 'depends_on' AS edge_type,
    CASE WHEN parent_entry_id IN (SELECT entry_id FROM v_fulls WHERE content_hash = 'v1') THEN '{"batch":2}' ELSE '{}' END AS metadata_json
FROM v_edges
UNION ALL
SELECT substr(sha256('summary:' || d.source), 1, 24), f.entry_id, 'summarizes', '{"batch":2}'
FROM v_fulls f JOIN v_docs d USING (document_id)
""")
def edge_upsert(v):
    second = graph.depends_on(v.fulls.filter("content_hash = 'v1'"))
    of_source = v.documents.select("document_id", "source")
    summary = v.fulls.join(of_source, "document_id").select(
        I.digest(F.concat(F.lit("summary:"), "source"), 24).alias("parent_entry_id"),
        F.col("entry_id").alias("child_entry_id"), F.lit("summarizes").alias("edge_type"), "created_at",
        F.lit("{}").alias("metadata_json"),
    )
    incoming = second.unionByName(summary).withColumn("metadata_json", F.lit('{"batch":2}'))
    return upsert(v.edges, incoming, KEYS["memo_edges"]).drop("created_at")


@query("chunk_upsert", """
SELECT document_id, chunk_index, content_hash,
    md5(CASE WHEN content_hash = 'v1' THEN 'second ' ELSE '' END || text) AS text_hash
FROM v_chunks
UNION ALL
SELECT document_id, chunk_index + n_chunks, '', md5(text)
FROM v_chunks JOIN (SELECT document_id, n_chunks FROM v_docs) USING (document_id) WHERE content_hash = ''
""")
def chunk_upsert(v):
    replaced = v.chunks.filter("content_hash = 'v1'").withColumn("text", F.concat(F.lit("second "), "text"))
    size = v.documents.select("document_id", "n_chunks")
    appended = v.chunks.filter("content_hash = ''").join(size, "document_id").withColumn(
        "chunk_index", F.col("chunk_index") + F.col("n_chunks")
    ).drop("n_chunks")
    stored = upsert(v.chunks, replaced.unionByName(appended), KEYS["context_chunks"])
    return stored.select("document_id", "chunk_index", "content_hash", F.md5("text").alias("text_hash"))


@query("vector_scan", """
SELECT vec_id, label, len(embedding)::BIGINT AS dim,
    round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm
FROM embeddings
""")
def vector_scan(v):
    return v.vectors.select(
        "vec_id", "label", F.size("embedding").cast("bigint").alias("dim"),
        F.round(F.sqrt(ranking.dot(F.col("embedding"), F.col("embedding"))), 6).alias("norm"),
    )


TURN_TASK = (
    """'{"constraints":{},"output_contract":"short answer","prompt":' || to_json(""" + O.normalize("text")
    + """)::VARCHAR || ',"task_type":' || to_json(role)::VARCHAR || '}'"""
)


@query("task_signature", f"SELECT conv_id, turn, substr(sha256({TURN_TASK}), 1, 16) AS signature FROM conversations")
def task_signature(v):
    return v.table("conversations").select(
        "conv_id", "turn",
        I.task_signature(F.col("text"), F.col("role"), F.lit("  Short\nAnswer"), F.lit("{}")).alias("signature"),
    )


CANONICAL_CONSTRAINTS = """'{"conv":{"a":[],"b":{"c":' || conv_id || ',"d":2000.0}},"said":{"by":[{"x":null,"y":' || turn || '.5},true],"role":'
  || to_json(role)::VARCHAR || '},"turn":1,"été":' || to_json(text)::VARCHAR || '}'"""


@query("canonical_json", f"""
SELECT conv_id, turn, canonical, substr(sha256('{{"constraints":' || canonical || ',"output_contract":"short answer","prompt":' ||
    to_json({O.normalize('text')})::VARCHAR || ',"task_type":' || to_json(role)::VARCHAR || '}}'), 1, 16) AS signature
FROM (SELECT *, {CANONICAL_CONSTRAINTS} AS canonical FROM conversations)
""")
def canonical_json(v):
    """Nested constraints with keys out of order, one of them twice, escapes and blanks."""
    turns = v.table("conversations")
    raw = F.concat(
        F.lit('{"turn": '), "turn", F.lit(', "said" : {"role":'), I.json_string(F.col("role")), F.lit(', "by": [ {"y": '), "turn",
        F.lit('.50, "x": null}, true ]},\n  "turn": 1, "\\u00e9t\\u00e9": '), I.json_string(F.col("text")),
        F.lit(', "conv": {"b": {"d": 2e3, "c": '), "conv_id", F.lit('}, "a": []}}'),
    )
    signature = I.task_signature(F.col("text"), F.col("role"), F.lit("  Short\nAnswer"), F.col("raw"), raw=True)
    return turns.withColumn("raw", raw).select("conv_id", "turn", I.canonical_json(F.col("raw")).alias("canonical"), signature.alias("signature"))


@query("scope_signature", f"""
SELECT request_id, substr(sha256({O.scope_json('r_start', 'r_end')}), 1, 16) AS signature FROM v_requests
""")
def scope_signature(v):
    scope = map(F.col, ["corpus_id", "document_id", "start", "end", "unit", "content_hash"])
    return v.requests.select("request_id", I.scope_signature(*scope).alias("signature"))


@query("negative_filter", f"SELECT entry_id, result_type FROM v_memo WHERE {O.NEGATIVE}")
def negative_filter(v):
    return v.outline.filter(E.is_negative()).select("entry_id", "result_type")


@query("fragment_kind_projection", f"SELECT entry_id, {O.KIND} AS fragment_kind FROM v_memo")
def fragment_kind_projection(v):
    return v.outline.select("entry_id", E.fragment_kind().alias("fragment_kind"))


@query("cover_filter", f"SELECT entry_id, scope_start, scope_end FROM v_memo WHERE {O.COVERS}")
def cover_filter(v):
    return v.outline.filter(E.can_cover()).select("entry_id", "scope_start", "scope_end")


@query("entry_id_derivation", f"""
SELECT conv_id, turn, substr(sha256('{{"dependencies":[],"result":' || to_json(text)::VARCHAR ||
    ',"result_type":"answer","reusable_as":["exact_answer"],"scope":{{"content_hash":"","corpus_id":"talk","document_id":"' ||
    conv_id || '","end":' || (turn + 1) || ',"start":' || turn || ',"unit":"turn"}},"task":' || {TURN_TASK} || '}}'), 1, 24) AS entry_id
FROM conversations
""")
def entry_id_derivation(v):
    task = I.task_json(F.col("text"), F.col("role"), F.lit("short answer"), F.lit("{}"))
    scope = I.scope_json(
        F.lit("talk"), F.col("conv_id").cast("string"), F.col("turn"), F.col("turn") + 1, F.lit("turn"), F.lit("")
    )
    modes = F.array_distinct(F.array(F.lit(S.EXACT_ANSWER), F.lit(S.EXACT_ANSWER)))
    derived = I.entry_id(task, scope, F.col("text"), F.lit("answer"), modes, F.array().cast("array<string>"))
    return v.table("conversations").select("conv_id", "turn", derived.alias("entry_id"))


@query("coerce_confidence", """
SELECT event_id, round(CASE event_type WHEN 'signup' THEN 0.95 WHEN 'click' THEN 0.7
    WHEN 'purchase' THEN least(1.0, value / 100) WHEN 'view' THEN CASE WHEN value > 1 AND value <= 100 THEN value / 100 ELSE least(value, 1.0) END
    ELSE 0.0 END, 6)::DOUBLE AS confidence
FROM events
""")
def coerce_confidence(v):
    kind = F.col("event_type")
    stated = (
        F.when(kind == "signup", F.lit(" Very High "))
        .when(kind == "click", F.lit("not-a-number"))
        .when(kind == "purchase", F.concat(F.col("value").cast("string"), F.lit(" %")))
        .when(kind == "view", F.col("value").cast("string"))
        .otherwise(F.concat(F.lit("-"), F.col("value").cast("string")))
    )
    return v.table("events").select("event_id", F.round(E.coerce_confidence(stated, 0.7), 6).alias("confidence"))


@query("bounded_text", """
SELECT doc_id, length(substr(text, 1, 800))::BIGINT AS kept_chars, length(text) > 800 AS truncated, md5(substr(text, 1, 800)) AS kept_hash
FROM documents
""")
def bounded_text(v):
    cut = T.bounded(F.col("text"), S.PACKET_RESULT_CHARS)
    return v.table("documents").select(
        "doc_id", F.length(cut["text"]).cast("bigint").alias("kept_chars"), cut["truncated"].alias("truncated"),
        F.md5(cut["text"]).alias("kept_hash"),
    )


@query("active_scope_filter", """
SELECT 'scope-a' AS active, cache_id FROM v_cache WHERE data_scope_hash = 'scope-a'
UNION ALL SELECT 'none', cache_id FROM v_cache
""")
def active_scope_filter(v):
    kept = [
        v.cache.filter(E.in_active_scope(F.col("data_scope_hash"), active)).select(
            F.lit(active or "none").alias("active"), "cache_id"
        )
        for active in ("scope-a", None)
    ]
    return kept[0].unionByName(kept[1])


@query("sample_filter", """
SELECT sample_id, task, length FROM v_predictions WHERE task = 'qa_long' AND length IN ('1000', '2000')
""")
def sample_filter(v):
    chosen = samples.select_samples(v.predictions, ["QA_LONG"], ["1000", "2000"])
    return chosen.select("sample_id", "task", "length")


RANKED = f"""
SELECT * FROM (
    SELECT r.request_id, e.*, r_start, r_end,
        list_sort(list_intersect(list_distinct({O.search_tokens('r.prompt')}), {O.search_tokens('''
            e.prompt || ' document_qa supported_answer ' || e.result || ' ' || array_to_string(e.reusable_as, ' ') || ' ' || e.evidence_text
            || ' ' || CASE WHEN e.metadata_json = '{}' THEN '' ELSE e.metadata_json END''')})) AS terms
    FROM v_requests r JOIN v_memo e ON e.document_id = r.document_id AND {O.hash_ok('e.content_hash', 'r.content_hash')}
        AND scope_start < r_end AND scope_end > r_start
    WHERE e.verifier_status <> 'rejected'
)
"""
SCORED = f"""
SELECT *, len(terms) + CASE WHEN scope_start = r_start AND scope_end = r_end THEN 3.0 ELSE 2.0 END::DOUBLE
    + CASE WHEN list_contains(reusable_as, 'exact_answer') THEN 0.25 ELSE 0 END::DOUBLE
    + CASE WHEN list_contains(reusable_as, 'supporting_fact') THEN 0.25 ELSE 0 END::DOUBLE AS score
FROM ({RANKED})
"""
TOP_ENTRIES = f"""
SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, confidence DESC, scope_start, entry_id DESC) AS rank
FROM ({SCORED}) QUALIFY rank <= 12
"""


@query("memo_text_topk", f"""
SELECT request_id, rank::INTEGER AS rank, entry_id, score, array_to_string(terms, ' ') AS matched_terms FROM ({TOP_ENTRIES})
""")
def memo_text_topk(v):
    ranked = retrieval.ranked_entries(v.requests, v.memo)
    return ranked.withColumn("matched_terms", F.array_join("matched_terms", " "))


@query("memo_packets", f"""
SELECT request_id, rank::INTEGER AS rank, entry_id, score, scope_end - scope_start AS scope_length, {O.KIND} AS fragment_kind,
    length(result)::BIGINT AS result_chars, length(result) > 800 AS result_truncated, n_evidence::BIGINT AS evidence_count,
    length(evidence_text)::BIGINT AS evidence_chars, substr(evidence_text, 1, 240) AS evidence_text
FROM ({TOP_ENTRIES})
""")
def memo_packets(v):
    made = retrieval.packets(retrieval.ranked_entries(v.requests, v.memo), v.memo)
    first = F.get("evidence", F.lit(0))
    return made.select(
        "request_id", "rank", "entry_id", "score", "scope_length", "fragment_kind",
        F.col("result_chars").cast("bigint").alias("result_chars"), "result_truncated",
        F.col("evidence_count").cast("bigint").alias("evidence_count"),
        F.coalesce(first["text_chars"], F.lit(0)).cast("bigint").alias("evidence_chars"),
        F.coalesce(first["text"], F.lit("")).alias("evidence_text"),
    )
