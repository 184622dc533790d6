"""DuckDB counterparts of the derived views, as common table expressions."""

from memograph.functions.text import KNOWLEDGE_STOPWORDS, SEARCH_STOPWORDS
from memograph.sources.views import AS_OF, PROMPTS, REWORDED


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def search_tokens(text: str) -> str:
    return (
        f"list_filter(regexp_extract_all(lower({text}), '[a-z0-9][a-z0-9_-]*'), "
        f"lambda t: length(t) > 1 AND NOT list_contains({_list(SEARCH_STOPWORDS)}, t))"
    )


def knowledge_tokens(text: str) -> str:
    """As a sorted distinct list."""
    return (
        f"list_sort(list_distinct(list_filter(regexp_extract_all(lower({text}), '[a-z0-9][a-z0-9_-]{{2,}}'), "
        f"lambda t: NOT list_contains({_list(KNOWLEDGE_STOPWORDS)}, t))))"
    )


def strip(text: str) -> str:
    return rf"regexp_replace({text}, '^\s+|\s+$', '', 'g')"


def normalize(text: str) -> str:
    return rf"trim(regexp_replace(lower({text}), '\s+', ' ', 'g'))"


def figures(text: str) -> str:
    """Distinct figures in order of pattern and position."""
    patterns = [r"\$[\d,]+\.?\d*[MBKTmkbt]?", r"\d+\.?\d*\s*%", r"\b\d{1,3}(?:,\d{3})+\b", r"\b\d+\.\d+[MBKTmkbt]\b"]
    found = " || ".join(f"regexp_extract_all({text}, '{p}')" for p in patterns)
    return f"list_filter(({found}), lambda f, i: list_position(({found}), f) = i)"


def by_document(options: list[str]) -> str:
    a, b, c = options
    return f"CASE WHEN substr(doc_key, 2, 1) < '5' THEN '{a}' WHEN substr(doc_key, 2, 1) < 'a' THEN '{b}' ELSE '{c}' END"


def task_json(prompt: str) -> str:
    return (
        """'{"constraints":{"chunk_size":4},"output_contract":"supported_answer","prompt":"' || """
        f"""{normalize(prompt)} || '","task_type":"document_qa"}}'"""
    )


def scope_json(start: str, end: str) -> str:
    return (
        """'{"content_hash":"' || content_hash || '","corpus_id":"docs","document_id":"' || document_id || """
        f"""'","end":' || {end} || ',"start":' || {start} || ',"unit":"chunk"}}'"""
    )


def id_list(ids: str) -> str:
    return f"""'[' || array_to_string(list_transform({ids}, lambda x: '"' || x || '"'), ',') || ']'"""


ENTRY_ID = (
    """substr(sha256('{"dependencies":' || """ + id_list("dependencies") + """ || ',"result":"' || result || """
    """'","result_type":"' || result_type || '","reusable_as":' || """ + id_list("reusable_as") + """ || ',"scope":' || """
    + scope_json("scope_start", "scope_end") + """ || ',"task":' || """ + task_json("prompt") + """ || '}'), 1, 24)"""
)

COVERS = "verifier_status <> 'rejected' AND list_has_any(reusable_as, ['exact_answer','supporting_fact','aggregation_component','ruled_out'])"
NEGATIVE = "(list_contains(reusable_as, 'ruled_out') OR result_type = 'not_found')"
KIND = f"""CASE WHEN {NEGATIVE} THEN 'ruled_out_region'
    WHEN list_contains(reusable_as, 'search_hint') THEN 'search_hint'
    WHEN list_contains(reusable_as, 'supporting_fact') THEN 'supporting_fact'
    WHEN list_contains(reusable_as, 'aggregation_component') THEN 'aggregation_component'
    WHEN list_contains(reusable_as, 'exact_answer') THEN 'exact_answer'
    ELSE coalesce(nullif(result_type, ''), 'unknown') END"""


def hash_ok(a: str, b: str) -> str:
    return f"({a} = {b} OR {a} = '' OR {b} = '')"


VIEWS = {
    "v_docs": r"""
SELECT doc_id, lang, source, words, len(words)::BIGINT AS n_words, ((len(words) + 79) // 80)::BIGINT AS n_chunks,
    md5(doc_id::VARCHAR) AS doc_key, doc_id::VARCHAR AS document_id,
    CASE WHEN substr(md5(doc_id::VARCHAR), 1, 1) < '4' THEN '' ELSE 'v1' END AS content_hash
FROM (SELECT doc_id, lang, source, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS words FROM documents)
WHERE len(words) > 0
""",
    "v_chunks": """
SELECT document_id, content_hash, i::BIGINT AS chunk_index, array_to_string(words[i*80+1 : (i+1)*80], ' ') AS text
FROM (SELECT *, unnest(generate_series(0, n_chunks - 1)) AS i FROM v_docs)
""",
    "v_windows": """
SELECT *, 4 * w AS w_start, least(4 * w + 4, n_chunks) AS w_end, md5(document_id || ':' || w) AS window_key
FROM (SELECT *, unnest(generate_series(0, (n_chunks - 1) // 4)) AS w FROM v_docs)
""",
    "v_spans": """
SELECT *, w_start AS scope_start, w_end AS scope_end FROM v_windows WHERE window_key >= '50'
UNION ALL
SELECT *, w_start + 2, least(w_end + 2, n_chunks) FROM v_windows WHERE window_key >= 'd0' AND w_start + 2 < least(w_end + 2, n_chunks)
""",
    "v_fragments": f"""
SELECT *, {ENTRY_ID} AS entry_id, substr(sha256({task_json('prompt')}), 1, 16) AS task_signature, '{AS_OF}' AS created_at
FROM (
    SELECT doc_id, document_id, content_hash, scope_start, scope_end, {by_document(PROMPTS)} AS prompt,
        CASE WHEN m < '2' THEN ['ruled_out'] WHEN m < '3' THEN ['search_hint']
            WHEN m < '5' THEN ['supporting_fact', 'aggregation_component'] ELSE ['aggregation_component'] END AS reusable_as,
        CASE WHEN m < '2' THEN 'not_found' WHEN m < '3' THEN 'hint' ELSE 'answer' END AS result_type,
        CASE WHEN m < '2' THEN 'not_found' ELSE 'chunks ' || scope_start || '-' || scope_end || ' words ' || wc END AS result,
        array_to_string(words[scope_start*80+1 : scope_end*80], ' ') AS evidence_text, 1 AS n_evidence,
        []::VARCHAR[] AS dependencies,
        strpos('0123456789abcdef', substr(window_key, 4, 1)) / 16.0::DOUBLE AS confidence,
        coalesce(status, 'not_required') AS verifier_status, '{{"words":' || wc || '}}' AS metadata_json
    FROM (
        SELECT s.*, substr(window_key, 3, 1) AS m, least(n_words, scope_end*80) - scope_start*80 AS wc, l.status
        FROM v_spans s LEFT JOIN (SELECT doc_id, 'rejected' AS status FROM labels WHERE toxic = 1) l USING (doc_id)
    )
)
""",
    "v_fulls": f"""
SELECT *, {ENTRY_ID} AS entry_id, substr(sha256({task_json('prompt')}), 1, 16) AS task_signature, '{AS_OF}' AS created_at
FROM (
    SELECT d.doc_id, d.document_id, d.content_hash, 0::BIGINT AS scope_start, n_chunks AS scope_end,
        CASE WHEN substr(doc_key, 3, 1) < '4' THEN {by_document(PROMPTS)} ELSE {by_document(REWORDED)} END AS prompt,
        ['exact_answer'] AS reusable_as, 'answer' AS result_type,
        'document ' || d.document_id || ' has ' || n_chunks || ' chunks' AS result,
        '' AS evidence_text, 0 AS n_evidence, coalesce(ids, []::VARCHAR[]) AS dependencies, 1.0::DOUBLE AS confidence,
        'not_required' AS verifier_status, '{{}}' AS metadata_json
    FROM v_docs d LEFT JOIN (
        SELECT document_id, list(entry_id ORDER BY scope_start, scope_end, entry_id) AS ids FROM v_fragments GROUP BY 1
    ) f ON f.document_id = d.document_id
    WHERE substr(doc_key, 3, 1) < '7'
)
""",
    "v_memo": "SELECT * FROM v_fragments UNION ALL BY NAME SELECT * FROM v_fulls",
    "v_summaries": """
SELECT substr(sha256('summary:' || source), 1, 24) AS entry_id, source, 'source:' || source AS document_id,
    0::BIGINT AS scope_start, count(*) AS scope_end
FROM v_docs GROUP BY source
""",
    "v_edges": """
SELECT entry_id AS parent_entry_id, unnest(dependencies) AS child_entry_id FROM v_fulls
UNION ALL
SELECT substr(sha256('summary:' || d.source), 1, 24), f.entry_id FROM v_fulls f JOIN v_docs d USING (document_id)
""",
    "v_nodes": """
SELECT entry_id, document_id, scope_start, scope_end, verifier_status FROM v_memo
UNION ALL SELECT entry_id, document_id, scope_start, scope_end, 'not_required' FROM v_summaries
""",
    "v_requests": f"""
SELECT doc_id * 2 + part AS request_id, prompt, substr(sha256({task_json('prompt')}), 1, 16) AS task_signature,
    document_id, r_start, r_end, content_hash
FROM (
    SELECT doc_id, document_id, part, {by_document(PROMPTS)} AS prompt,
        CASE WHEN part = 0 THEN 0 ELSE n_chunks // 4 END::BIGINT AS r_start,
        CASE WHEN part = 0 THEN n_chunks ELSE n_chunks * 3 // 4 END::BIGINT AS r_end,
        CASE WHEN substr(doc_key, 5, 1) < '5' THEN '' WHEN substr(doc_key, 5, 1) < 'd' THEN 'v1' ELSE 'v2' END AS content_hash
    FROM (SELECT *, unnest([0, 1]) AS part FROM v_docs)
)
""",
    "v_exact": f"""
SELECT request_id, arg_min(e.entry_id, e.created_at || e.entry_id) AS exact_entry_id
FROM v_requests r JOIN v_memo e ON e.task_signature = r.task_signature AND e.document_id = r.document_id
    AND e.scope_start = r.r_start AND e.scope_end = r.r_end AND {hash_ok('e.content_hash', 'r.content_hash')}
WHERE e.verifier_status <> 'rejected' AND list_contains(e.reusable_as, 'exact_answer')
GROUP BY request_id
""",
    "v_pending": "SELECT * FROM v_requests WHERE request_id NOT IN (SELECT request_id FROM v_exact)",
    "v_candidates": f"""
SELECT r.request_id, r.r_start, r.r_end, e.*, greatest(r_start, scope_start) AS c_start, least(r_end, scope_end) AS c_end,
    {COVERS} AS covers, {NEGATIVE} AS negative, {KIND} AS kind, list_contains(reusable_as, 'search_hint') AS hint
FROM v_pending r JOIN v_memo e ON e.task_signature = r.task_signature AND e.document_id = r.document_id
    AND {hash_ok('e.content_hash', 'r.content_hash')} AND scope_start < r_end AND scope_end > r_start
WHERE verifier_status <> 'rejected'
""",
    "v_reusable": """
SELECT * FROM v_candidates WHERE NOT negative AND covers
QUALIFY row_number() OVER (PARTITION BY request_id, scope_start, scope_end, content_hash
    ORDER BY list_contains(reusable_as, 'exact_answer') DESC, len(dependencies) DESC, confidence DESC, entry_id) = 1
""",
    "v_positions": """
SELECT DISTINCT request_id, unnest(generate_series(c_start, c_end - 1)) AS p FROM v_candidates WHERE covers
""",
    "v_covered": """
SELECT request_id, min(p) AS "start", max(p) + 1 AS "end"
FROM (SELECT *, p - row_number() OVER (PARTITION BY request_id ORDER BY p) AS island FROM v_positions)
GROUP BY request_id, island
""",
    "v_holes": """
SELECT request_id, min(p) AS "start", max(p) + 1 AS "end"
FROM (
    SELECT *, p - row_number() OVER (PARTITION BY request_id ORDER BY p) AS island
    FROM (
        SELECT request_id, unnest(generate_series(r_start, r_end - 1)) AS p FROM v_pending
        EXCEPT SELECT request_id, p FROM v_positions
    )
)
GROUP BY request_id, island
""",
    "v_changed": "SELECT document_id, w_start, w_end FROM v_windows WHERE window_key < '18'",
    "v_reach": """
SELECT DISTINCT e.entry_id, 0 AS depth FROM v_changed c JOIN v_memo e
    ON e.document_id = c.document_id AND e.scope_start < c.w_end AND e.scope_end > c.w_start
WHERE e.verifier_status <> 'rejected'
UNION
SELECT g.parent_entry_id, r.depth + 1 FROM v_reach r JOIN v_edges g ON g.child_entry_id = r.entry_id
    JOIN v_nodes n ON n.entry_id = g.parent_entry_id AND n.verifier_status <> 'rejected'
""",
    "v_calls": """
SELECT event_id, ts, user_id, event_type,
    CASE WHEN event_type IN ('purchase', 'signup') THEN 'sonnet-large' WHEN event_type IN ('view', 'click') THEN 'haiku-small'
        ELSE 'local-base' END AS model,
    floor(value * 10)::BIGINT AS input_tokens, json_extract_string(props, '$.k')::BIGINT AS output_tokens,
    event_type IN ('view', 'click') AS from_cache, value AS latency_ms
FROM events
""",
    "v_costs": """
SELECT *, CASE WHEN model LIKE '%haiku%' THEN input_tokens * 0.00025::DOUBLE / 1000 + output_tokens * 0.00125::DOUBLE / 1000
    WHEN model LIKE '%sonnet%' THEN input_tokens * 0.003::DOUBLE / 1000 + output_tokens * 0.015::DOUBLE / 1000
    ELSE 0.0::DOUBLE END AS cost
FROM v_calls
""",
    "v_predictions": r"""
SELECT a.conv_id * 1000 + a.turn AS sample_id,
    CASE WHEN length(u.text) < 120 THEN 'qa_short' ELSE 'qa_long' END AS task,
    CASE WHEN length(a.text) < 200 THEN '1000' WHEN length(a.text) < 400 THEN '2000' ELSE '4000' END AS length,
    u.text AS question, a.text AS prediction,
    list_filter(u.long_words, lambda x, i: list_position(u.long_words, x) = i) AS gold
FROM conversations a JOIN (
    SELECT *, list_filter(regexp_split_to_array(text, '\s+'), lambda x: length(x) >= 6) AS long_words FROM conversations
) u ON u.conv_id = a.conv_id AND u.turn + 1 = a.turn
WHERE a.role = 'assistant' AND u.role = 'user'
""",
    "v_answers": """
SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority,
    CASE WHEN p = '5' THEN 'Order ' || o_orderkey || ' has no figures' ELSE
        'Order ' || o_orderkey || ' totals $' || money || ', up ' || share || '%, volume ' || volume || ' and 48.7M.' END AS answer,
    CASE WHEN p = '2' THEN 'nothing on record' ELSE
        'Order ' || o_orderkey || ' totals $' || CASE WHEN p IN ('1', '2') THEN '0.5' ELSE money END || ', up ' ||
        CASE WHEN p IN ('2', '3') THEN 'x' ELSE share END || '%, volume ' || volume || ' and 48.7M.' END AS source_text
FROM (
    SELECT *, substr(o_orderpriority, 1, 1) AS p, o_totalprice::DECIMAL(18,2)::VARCHAR AS money,
        (o_custkey / 10)::DECIMAL(10,1)::VARCHAR AS share,
        floor(o_totalprice / 1000)::BIGINT || ',' || lpad((o_custkey % 1000)::VARCHAR, 3, '0') AS volume
    FROM orders
)
""",
    "v_cache": """
SELECT o_orderkey AS cache_id, 'What is the total of order ' || o_orderkey || '?' AS query, answer AS result,
    source_text AS source_context, md5('Ledger of customer ' || o_custkey) AS chunk_hash,
    CASE WHEN o_orderstatus = 'F' THEN 'scope-a' ELSE '' END AS data_scope_hash
FROM v_answers WHERE o_orderstatus <> 'P'
""",
    "v_lookups": """
SELECT o_orderkey AS lookup_id, md5('Ledger of customer ' || o_custkey) AS chunk_hash,
    CASE substr(o_orderpriority, 1, 1) WHEN '2' THEN 'order ' || o_orderkey || ' total'
        WHEN '3' THEN 'delivery date of order ' || o_orderkey
        ELSE '  what is the TOTAL of order ' || o_orderkey || '? ' END AS query
FROM orders
""",
}
