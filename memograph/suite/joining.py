"""Joins between requests, stored entries, chunks and cached rows."""

from pyspark.sql import functions as F

from memograph import schema as S
from memograph.functions import facts
from memograph.operators import graph, matching, samples
from memograph.plans import cache as caching
from memograph.plans import solve
from memograph.sources.views import AS_OF
from memograph.suite import oracle_views as O
from memograph.suite.registry import query

LIVE_OVERLAP = f"""
FROM v_requests r JOIN v_memo e ON e.document_id = r.document_id AND {O.hash_ok('e.content_hash', 'r.content_hash')}
    AND scope_start < r_end AND scope_end > r_start
WHERE e.verifier_status <> 'rejected'
"""


@query("exact_replay", "SELECT request_id, exact_entry_id FROM v_exact")
def exact_replay(v):
    return matching.exact_replays(v.requests, v.outline)


@query("exact_replay_global", """
SELECT request_id, exact_entry_id FROM v_requests JOIN (
    SELECT task_signature, arg_min(entry_id, created_at || entry_id) AS exact_entry_id FROM v_memo
    WHERE verifier_status <> 'rejected' AND list_contains(reusable_as, 'exact_answer') GROUP BY 1
) USING (task_signature)
""")
def exact_replay_global(v):
    return matching.exact_replays_any_scope(v.requests, v.outline)


@query("candidates_interval_join", f"""
SELECT r.request_id, e.entry_id, scope_start, scope_end {LIVE_OVERLAP} AND e.task_signature = r.task_signature
""")
def candidates_interval_join(v):
    return matching.candidates(v.requests, v.outline).select("request_id", "entry_id", "scope_start", "scope_end")


@query("scope_candidates_join", f"SELECT r.request_id, e.entry_id, scope_start, scope_end {LIVE_OVERLAP}")
def scope_candidates_join(v):
    found = matching.candidates(v.requests, v.outline, same_task=False)
    return found.select("request_id", "entry_id", "scope_start", "scope_end")


@query("scope_contains_join", f"""
SELECT r.request_id, e.entry_id {LIVE_OVERLAP} AND scope_start <= r_start AND scope_end >= r_end
""")
def scope_contains_join(v):
    return matching.containing(matching.candidates(v.requests, v.outline, same_task=False)).select("request_id", "entry_id")


@query("scope_overlap_join", """
SELECT w.document_id, w.w AS window_no, e.entry_id FROM v_windows w JOIN v_memo e
    ON e.document_id = w.document_id AND scope_start < w_end AND scope_end > w_start
""")
def scope_overlap_join(v):
    windows = v.windows.select(
        F.lit("docs").alias("corpus_id"), "document_id", F.lit("chunk").alias("unit"), "content_hash",
        F.col("w").cast("bigint").alias("window_no"), "start", "end",
    )
    stored = v.outline.select("entry_id", *S.SCOPE_KEYS, "scope_start", "scope_end", "content_hash")
    return matching.overlapping(windows, stored).select("document_id", "window_no", "entry_id")


@query("scope_clip", f"""
SELECT r.request_id, e.entry_id, greatest(scope_start, r_start) AS clip_start, least(scope_end, r_end) AS clip_end,
    least(scope_end, r_end) - greatest(scope_start, r_start) AS clip_length {LIVE_OVERLAP}
""")
def scope_clip(v):
    cut = matching.clipped(matching.candidates(v.requests, v.outline, same_task=False))
    return cut.select(
        "request_id", "entry_id", "clip_start", "clip_end", (F.col("clip_end") - F.col("clip_start")).alias("clip_length")
    )


@query("fetch_context_range", f"""
SELECT r.request_id, c.chunk_index, md5(c.text) AS text_hash FROM v_requests r JOIN v_chunks c
    ON c.document_id = r.document_id AND {O.hash_ok('c.content_hash', 'r.content_hash')}
    AND chunk_index >= r_start AND chunk_index < r_end
""")
def fetch_context_range(v):
    ranges = v.requests.select("request_id", *S.SCOPE_KEYS, "start", "end", "content_hash")
    found = matching.context_range(ranges, v.chunks)
    return found.select("request_id", "chunk_index", F.md5("text").alias("text_hash"))


def _terms(prompt: str) -> str:
    return f"list_distinct({O.search_tokens(prompt)})"


@query("semantic_reuse_join", f"""
SELECT request_id, min(entry_id) AS source_entry_id, arg_min(result, entry_id) AS answer FROM (
    SELECT r.request_id, e.entry_id, e.result, len(list_intersect({_terms('r.prompt')}, {_terms('e.prompt')})) AS shared,
        len({_terms('r.prompt')}) + len({_terms('e.prompt')}) AS total
    FROM v_requests r JOIN v_memo e ON e.document_id = r.document_id AND {O.hash_ok('e.content_hash', 'r.content_hash')}
        AND scope_start = r_start AND scope_end = r_end AND e.task_signature <> r.task_signature
    WHERE e.verifier_status <> 'rejected' AND list_contains(e.reusable_as, 'exact_answer')
) WHERE shared >= 0.8 * (total - shared) GROUP BY request_id
""")
def semantic_reuse_join(v):
    found = solve.semantic_reuse(v.requests, v.outline, 0.8)
    return found.select("request_id", "source_entry_id", F.col("result").alias("answer"))


WARM_QUERIES = ["What is the total of the passage?", "Who is named in the passage?"]


@query("prewarm_grid", f"""
SELECT document_id, chunk_index, md5(text) AS chunk_hash, query
FROM (SELECT *, unnest({WARM_QUERIES}) AS query FROM v_chunks)
WHERE NOT (content_hash = '' AND query LIKE 'What%')
""")
def prewarm_grid(v):
    from memograph.functions import identity as I

    known = v.chunks.filter("content_hash = ''").select(
        I.chunk_hash(F.col("text")).alias("chunk_hash"), F.lit(f"  {WARM_QUERIES[0].upper()} ").alias("query"), "document_id"
    )
    of_document = v.chunks.select("document_id", "chunk_index", "text", "content_hash")
    warm = caching.to_warm(of_document.filter("content_hash = ''"), WARM_QUERIES, known).unionByName(
        caching.to_warm(of_document.filter("content_hash <> ''"), WARM_QUERIES)
    )
    return warm.select("document_id", "chunk_index", "chunk_hash", "query")


@query("case_expansion", """
SELECT lpad(item_id::VARCHAR, 4, '0') || '_' || t || '_' || q AS test_name, q AS question_type, item_id AS seed_offset,
    md5(text || ' The keeper of passage ' || item_id || ' is ' || name || '.') AS needle_hash,
    CASE q WHEN 'direct' THEN 'Who keeps passage ' || item_id || '?' ELSE 'Which passage does ' || name || ' keep?' END AS retrieval_question,
    name AS gold, CASE q WHEN 'direct' THEN 'Nobody keeps passage ' || item_id || ' any more.' END AS distractor
FROM (
    SELECT *, CASE t WHEN '01' THEN 'Ada' ELSE 'Bo' END || item_id AS name
    FROM (SELECT *, unnest(['01', '02']) AS t FROM (SELECT *, unnest(['direct', 'reverse']) AS q FROM benchmark))
)
""")
def case_expansion(v):
    return samples.expand_cases(v.experiments).select(
        "test_name", "question_type", "seed_offset", F.md5("needle").alias("needle_hash"), "retrieval_question",
        F.array_join("gold_answers", ",").alias("gold"), "distractor",
    )


SWEEP_LENGTHS = [250, 1000]
SWEEP_TESTS = ["0001_01_direct", "0002_01_direct"]


@query("sample_sweep", f"""
SELECT test || '__' || haystack || '__L' || len || '__D' || lpad(d::VARCHAR, 2, '0') AS sample_id, len::BIGINT AS length,
    d::INTEGER AS depth_index, d * 25.0::DOUBLE AS depth_percent, haystack_hash
FROM (
    SELECT *, unnest(generate_series(0, 4)) AS d FROM (
        SELECT *, unnest({SWEEP_LENGTHS}) AS len FROM (
            SELECT 'doc_' || lpad(doc_id::VARCHAR, 8, '0') AS haystack, sha256(text) AS haystack_hash,
                unnest({SWEEP_TESTS}) AS test
            FROM documents WHERE {O.strip('text')} <> ''
        )
    )
)
""")
def sample_sweep(v):
    cases = v.haystacks.select(
        "haystack", "haystack_hash", F.explode(F.array(*map(F.lit, SWEEP_TESTS))).alias("test_name")
    )
    return samples.sweep(cases, SWEEP_LENGTHS, 5).select(
        "sample_id", "length", "depth_index", "depth_percent", "haystack_hash"
    )


@query("dependency_semi_join", f"""
SELECT document_id, entry_id FROM v_memo WHERE {O.COVERS}
    AND entry_id IN (SELECT unnest(dependencies) FROM v_fulls)
""")
def dependency_semi_join(v):
    from memograph.functions import entries as E

    used = v.fulls.select(F.explode("dependencies").alias("entry_id"))
    return v.outline.filter(E.can_cover()).join(used, "entry_id", "left_semi").select("document_id", "entry_id")


def _cache_entry_id(task_type: str, contract: str, prompt: str, result: str, mode: str) -> str:
    return (
        """substr(sha256('{"dependencies":[],"result":' || to_json(""" + result + """)::VARCHAR || ',"result_type":"answer","reusable_as":["""
        + f'"{mode}"' + """],"scope":{"content_hash":"' || CASE data_scope_hash WHEN '' THEN chunk_hash ELSE data_scope_hash END
        || '","corpus_id":"default","document_id":"' || CASE data_scope_hash WHEN '' THEN 'legacy_cache:' || chunk_hash ELSE 'active_search_corpus' END
        || '","end":1,"start":0,"unit":"' || CASE data_scope_hash WHEN '' THEN 'legacy_cache_entry' ELSE 'scope' END
        || '"},"task":{"constraints":{},"output_contract":\"""" + contract + """\","prompt":' || to_json(""" + O.normalize(prompt)
        + """)::VARCHAR || ',"task_type":\"""" + task_type + """\"}}'), 1, 24)"""
    ).replace('\\"', '"')


@query("migrate_legacy_anti_join", f"""
SELECT {_cache_entry_id('retrieval_search', 'synthesized_answer', 'query', 'result', 'exact_answer')} AS entry_id,
    result, substr(source_context, 1, 500) AS evidence_text
FROM v_cache WHERE data_scope_hash = ''
""")
def migrate_legacy_anti_join(v):
    nothing = v.outline.filter("false")
    stored = caching.migrate_cache(v.cache.filter("data_scope_hash <> ''"), nothing, AS_OF)
    fresh = caching.migrate_cache(v.cache, stored, AS_OF)
    return fresh.select("entry_id", "result", F.left(F.get("evidence", F.lit(0))["text"], F.lit(500)).alias("evidence_text"))


NOTES_SQL = """
SELECT o_orderkey AS cache_id, 'Order ' || o_orderkey AS subject, rel AS relation,
    CASE rel WHEN 'customer' THEN o_custkey::VARCHAR ELSE o_orderstatus END AS object
FROM (SELECT *, unnest(['customer', 'status']) AS rel FROM orders)
"""


def _notes(v):
    """Lines about each order, some of which are triples."""
    name = F.concat(F.lit("Order "), F.col("o_orderkey"))
    text = F.concat(
        F.lit("\n  "), name, F.lit(" | customer | "), F.col("o_custkey"), F.lit(" \nno triple | here\n"),
        name, F.lit("|status|"), F.col("o_orderstatus"), F.lit("| trailing\n"),
    )
    return v.table("orders").select(F.col("o_orderkey").alias("cache_id"), F.inline(facts.triples(text)))


@query("parse_triples", NOTES_SQL)
def parse_triples(v):
    return _notes(v)


@query("fact_source_join", f"""
SELECT cache_id, subject, relation, object, chunk_hash, data_scope_hash FROM ({NOTES_SQL}) JOIN v_cache USING (cache_id)
""")
def fact_source_join(v):
    return _notes(v).join(v.cache.select("cache_id", "chunk_hash", "data_scope_hash"), "cache_id")


@query("migrate_facts", f"""
SELECT {_cache_entry_id('legacy_knowledge_fact', 'fact_triple', 'fact', 'fact', 'supporting_fact')} AS entry_id, fact AS result
FROM (SELECT *, subject || ' ' || relation || ' ' || object AS fact FROM ({NOTES_SQL}) JOIN v_cache USING (cache_id))
""")
def migrate_facts(v):
    moved = caching.migrate_facts(_notes(v), v.cache, v.outline.filter("false"), AS_OF)
    return moved.select("entry_id", "result")


@query("hash_bucket_lookup", rf"""
SELECT lookup_id, cache_id FROM v_lookups l JOIN v_cache c ON c.chunk_hash = l.chunk_hash
    AND lower({O.strip('c.query')}) = lower({O.strip('l.query')})
""")
def hash_bucket_lookup(v):
    return caching.bucket_matches(v.lookups, v.cache).select("lookup_id", "cache_id")


@query("graph_parents", """
SELECT child_entry_id, parent_entry_id, document_id FROM v_edges JOIN v_nodes ON entry_id = parent_entry_id
""")
def graph_parents(v):
    return graph.parents(v.edges, v.nodes).select("child_entry_id", "parent_entry_id", "document_id")


@query("graph_children", """
SELECT parent_entry_id, child_entry_id, document_id, scope_start FROM v_edges JOIN v_nodes ON entry_id = child_entry_id
""")
def graph_children(v):
    return graph.children(v.edges, v.nodes).select("parent_entry_id", "child_entry_id", "document_id", "scope_start")
