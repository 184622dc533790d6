"""Lineage, invalidation and incremental solving."""

from pyspark.sql import functions as F

from memograph.operators import graph
from memograph.operators.reports import count_where, ratio
from memograph.plans import solve
from memograph.sources.views import AS_OF
from memograph.suite import oracle_views as O
from memograph.suite.registry import query


def _graph_entries(v):
    """All stored entries plus the source summaries, as far as invalidation needs them."""
    summaries = v.summaries.select(
        "entry_id", F.lit("docs").alias("corpus_id"), "document_id", F.lit("source").alias("unit"),
        "scope_start", "scope_end", F.lit("").alias("content_hash"), F.lit("not_required").alias("verifier_status"),
    )
    return v.outline.select(*summaries.columns).unionByName(summaries)


@query("invalidate_closure", "SELECT entry_id, min(depth)::INTEGER AS depth FROM v_reach GROUP BY 1")
def invalidate_closure(v):
    return graph.invalidated(v.changed, _graph_entries(v), v.edges)


@query("lineage_closure", """
SELECT root_id, entry_id, min(depth)::INTEGER AS depth FROM (
    SELECT entry_id AS root_id, entry_id, 0 AS depth FROM v_summaries
    UNION ALL SELECT s.entry_id, g.child_entry_id, 1 FROM v_summaries s JOIN v_edges g ON g.parent_entry_id = s.entry_id
    UNION ALL SELECT s.entry_id, h.child_entry_id, 2 FROM v_summaries s JOIN v_edges g ON g.parent_entry_id = s.entry_id
        JOIN v_edges h ON h.parent_entry_id = g.child_entry_id
) GROUP BY 1, 2
""")
def lineage_closure(v):
    return graph.lineage(v.summaries.select("entry_id"), v.edges)


@query("lineage_tree", """
WITH walk AS (
    SELECT entry_id AS root_id, entry_id, 0 AS depth, []::VARCHAR[] AS path FROM v_summaries
    UNION ALL
    SELECT w.root_id, g.child_entry_id, w.depth + 1, list_append(w.path, g.child_entry_id)
    FROM walk w JOIN (SELECT DISTINCT parent_entry_id, child_entry_id FROM v_edges) g ON g.parent_entry_id = w.entry_id
    WHERE w.depth < 10 AND g.child_entry_id IN (SELECT entry_id FROM v_nodes)
)
SELECT root_id, row_number() OVER (PARTITION BY root_id ORDER BY path) - 1 AS position, depth, entry_id, depth < 10 AS expanded FROM walk
""")
def lineage_tree(v):
    """What each source summary rests on; here every entry has one parent, so each is met once."""
    return graph.lineage_tree(v.summaries.select("entry_id"), v.edges, v.nodes)


@query("reject_entries", """
SELECT entry_id, CASE WHEN entry_id IN (SELECT entry_id FROM v_reach) THEN 'rejected' ELSE verifier_status END AS verifier_status,
    CASE WHEN entry_id IN (SELECT entry_id FROM v_reach) THEN
        CASE metadata_json WHEN '{}' THEN '{' ELSE substr(metadata_json, 1, length(metadata_json) - 1) || ',' END
        || '"rejected_at":"2024-01-01T00:00:00Z","rejection_reason":"text changed"}' ELSE metadata_json END AS metadata_json
FROM v_memo
""")
def reject_entries(v):
    stale = graph.invalidated(v.changed, _graph_entries(v), v.edges)
    return graph.reject(v.outline, stale, "text changed", AS_OF).select("entry_id", "verifier_status", "metadata_json")


@query("incremental_resolve", f"""
WITH live AS (
    SELECT * FROM v_memo WHERE verifier_status <> 'rejected' AND entry_id NOT IN (SELECT entry_id FROM v_reach)
), exact AS (
    SELECT DISTINCT request_id FROM v_requests r JOIN live e ON e.task_signature = r.task_signature AND e.document_id = r.document_id
        AND scope_start = r_start AND scope_end = r_end AND {O.hash_ok('e.content_hash', 'r.content_hash')} AND list_contains(reusable_as, 'exact_answer')
), windows AS (
    SELECT *, r_start + 4 * w AS a, least(r_start + 4 * w + 4, r_end) AS z FROM (
        SELECT *, unnest(generate_series(0, (r_end - r_start - 1) // 4)) AS w FROM v_requests
        WHERE r_end > r_start AND request_id NOT IN (SELECT request_id FROM exact)
    )
), held AS (
    SELECT DISTINCT request_id, unnest(generate_series(greatest(scope_start, r_start), least(scope_end, r_end) - 1)) AS p
    FROM v_requests r JOIN live e ON e.task_signature = r.task_signature AND e.document_id = r.document_id
        AND scope_start < r_end AND scope_end > r_start AND {O.hash_ok('e.content_hash', 'r.content_hash')}
    WHERE {O.COVERS}
), states AS (
    SELECT t.request_id, w, z - a AS size, count(h.p) AS have FROM windows t LEFT JOIN held h
        ON h.request_id = t.request_id AND h.p >= a AND h.p < z GROUP BY ALL
)
SELECT request_id, count(*) AS windows, sum((have = size)::INT)::BIGINT AS reused_windows, sum((have < size)::INT)::BIGINT AS missing_windows,
    round(sum(have)::DOUBLE / sum(size), 6) AS initial_ratio
FROM states GROUP BY 1
""")
def incremental_resolve(v):
    from memograph.plans.reuse import plan_reuse

    stale = graph.invalidated(v.changed, _graph_entries(v), v.edges)
    live = v.outline.join(stale, "entry_id", "left_anti")
    pending = plan_reuse(v.requests, live).pending
    states = solve.window_states(solve.windows_of(pending, 4), live)
    size = F.col("end") - F.col("start")
    return states.groupBy(F.col("parent_id").alias("request_id")).agg(
        F.count("*").alias("windows"), count_where(F.col("is_complete")).alias("reused_windows"),
        count_where(~F.col("is_complete")).alias("missing_windows"),
        ratio(F.sum(size - F.col("missing_length")), F.sum(size)).alias("initial_ratio"),
    )
