"""Coverage, gaps, windows and anchors."""

from pyspark.sql import functions as F

from memograph.functions import entries as E
from memograph.functions import facts
from memograph.functions import text as T
from memograph.operators import folding, ranking, samples, spans
from memograph.operators.reports import count_where, ratio
from memograph.plans.reuse import KINDS, condensed, plan_reuse
from memograph.suite import oracle_views as O
from memograph.suite.registry import query


def islands(source: str, key: str) -> str:
    """Maximal runs of the integer column ``p`` of a query, per key."""
    return f"""
    SELECT {key}, min(p) AS "start", max(p) + 1 AS "end" FROM (
        SELECT {key}, p, p - row_number() OVER (PARTITION BY {key} ORDER BY p) AS island FROM ({source})
    ) GROUP BY {key}, island
    """


@query("coverage_ratio", f"""
SELECT d.doc_id, n_chunks AS requested_length, coalesce(covered, 0)::BIGINT AS covered_length,
    (n_chunks - coalesce(covered, 0))::BIGINT AS missing_length,
    round(coalesce(covered, 0)::DOUBLE / n_chunks, 6)::DOUBLE AS coverage_ratio, coalesce(n, 0)::BIGINT AS covered_intervals
FROM v_docs d LEFT JOIN (
    SELECT document_id, sum("end" - "start") AS covered, count(*) AS n FROM ({islands(f'''
        SELECT DISTINCT document_id, unnest(generate_series(scope_start, scope_end - 1)) AS p FROM v_fragments WHERE {O.COVERS}''', 'document_id')})
    GROUP BY 1
) c ON c.document_id = d.document_id
""")
def coverage_ratio(v):
    held = v.bare_fragments.filter(E.can_cover()).select(
        "document_id", F.col("scope_start").alias("start"), F.col("scope_end").alias("end")
    )
    documents = v.documents.select("doc_id", "document_id", "n_chunks")
    length = F.col("end") - F.col("start")
    covered = spans.merge(held, ["document_id"]).groupBy("document_id").agg(
        F.sum(length).alias("covered"), F.count("*").alias("n")
    )
    done = F.coalesce("covered", F.lit(0)).cast("bigint")
    return documents.join(covered, "document_id", "left").select(
        "doc_id", F.col("n_chunks").alias("requested_length"), done.alias("covered_length"),
        (F.col("n_chunks") - done).alias("missing_length"), ratio(done, F.col("n_chunks")).alias("coverage_ratio"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("covered_intervals"),
    )


@query("interval_merge", islands(
    "SELECT DISTINCT document_id, unnest(generate_series(scope_start, scope_end - 1)) AS p FROM v_fragments", "document_id"))
def interval_merge(v):
    held = v.bare_fragments.select("document_id", F.col("scope_start").alias("start"), F.col("scope_end").alias("end"))
    return spans.merge(held, ["document_id"])


@query("covered_intervals", """
SELECT request_id, "start", "end" FROM v_covered
UNION ALL SELECT request_id, r_start, r_end FROM v_requests WHERE request_id IN (SELECT request_id FROM v_exact) AND r_end > r_start
""")
def covered_intervals(v):
    return plan_reuse(v.requests, v.outline).covered


@query("missing_scopes", 'SELECT request_id, "start", "end" FROM v_holes')
def missing_scopes(v):
    return plan_reuse(v.requests, v.outline).missing


@query("dedupe_covering", f"""
SELECT document_id, content_hash, scope_start, scope_end, entry_id FROM v_memo WHERE {O.COVERS} AND NOT {O.NEGATIVE}
QUALIFY row_number() OVER (PARTITION BY task_signature, document_id, content_hash, scope_start, scope_end
    ORDER BY list_contains(reusable_as, 'exact_answer') DESC, len(dependencies) DESC, confidence DESC, entry_id) = 1
""")
def dedupe_covering(v):
    return condensed(v.outline).filter("best IS NOT NULL").select(
        "document_id", "content_hash", "scope_start", "scope_end", "best.entry_id"
    )


COUNTED = ["reusable", "negative", "hint", "evidence_spans", "dependency_edges"]
TELEMETRY = """
SELECT r.request_id, r.r_end - r.r_start AS scope_length, x.exact_entry_id IS NOT NULL AS has_exact_replay,
    CASE WHEN x.exact_entry_id IS NOT NULL THEN r_end - r_start ELSE coalesce(covered, 0) END::BIGINT AS covered_length,
    CASE WHEN x.exact_entry_id IS NOT NULL THEN 0 ELSE r_end - r_start - coalesce(covered, 0) END::BIGINT AS missing_length,
    CASE WHEN x.exact_entry_id IS NOT NULL THEN (r_end > r_start)::INT ELSE coalesce(n_covered, 0) END::BIGINT AS covered_intervals,
    CASE WHEN x.exact_entry_id IS NOT NULL THEN 0 ELSE coalesce(n_missing, 0) END::BIGINT AS missing_scopes,
    x.exact_entry_id,
    CASE WHEN x.exact_entry_id IS NOT NULL THEN 1 ELSE coalesce(n_reusable, 0) END::BIGINT AS reusable,
    coalesce(n_negative, 0)::BIGINT AS negative, coalesce(n_hint, 0)::BIGINT AS hint,
    CASE WHEN x.exact_entry_id IS NOT NULL THEN e.n_evidence ELSE coalesce(u.ev, 0) + coalesce(k.ev, 0) END::BIGINT AS evidence_spans,
    CASE WHEN x.exact_entry_id IS NOT NULL THEN len(e.dependencies) ELSE coalesce(u.dep, 0) + coalesce(k.dep, 0) END::BIGINT AS dependency_edges
FROM v_requests r
LEFT JOIN v_exact x USING (request_id)
LEFT JOIN v_memo e ON e.entry_id = x.exact_entry_id
LEFT JOIN (SELECT request_id, sum("end" - "start") AS covered, count(*) AS n_covered FROM v_covered GROUP BY 1) c ON c.request_id = r.request_id
LEFT JOIN (SELECT request_id, count(*) AS n_missing FROM v_holes GROUP BY 1) m ON m.request_id = r.request_id
LEFT JOIN (SELECT request_id, count(*) AS n_reusable, sum(n_evidence) AS ev, sum(len(dependencies)) AS dep FROM v_reusable GROUP BY 1) u
    ON u.request_id = r.request_id
LEFT JOIN (SELECT request_id, sum(negative::INT) AS n_negative, sum(hint::INT) AS n_hint,
        sum(n_evidence * (negative::INT + hint::INT)) AS ev, sum(len(dependencies) * (negative::INT + hint::INT)) AS dep
    FROM v_candidates GROUP BY 1) k ON k.request_id = r.request_id
"""


@query("plan_telemetry", f"""
SELECT *, missing_length = 0 AS is_complete,
    CASE WHEN scope_length <= 0 THEN 1.0 ELSE round(covered_length::DOUBLE / scope_length, 6) END::DOUBLE AS coverage_ratio
FROM ({TELEMETRY})
""")
def plan_telemetry(v):
    told = plan_reuse(v.requests, v.outline).telemetry
    kept = [c for c in told.columns if not c.startswith(("kind_", "covering_"))]
    return told.select(*[c for c in kept if c not in ("task_signature", "document_id", "start", "end")])


@query("plan_reuse", f"""
SELECT request_id, has_exact_replay, exact_entry_id, missing_length > 0 AS requires_calls, covered_length, missing_length, reusable
FROM ({TELEMETRY})
""")
def plan_reuse_query(v):
    return plan_reuse(v.requests, v.outline).telemetry.select(
        "request_id", "has_exact_replay", "exact_entry_id", (~F.col("is_complete")).alias("requires_calls"),
        "covered_length", "missing_length", "reusable",
    )


@query("plan_fragment_mix", f"""
SELECT request_id, kind AS fragment_kind, count(*) AS entries FROM (
    SELECT request_id, kind FROM v_reusable
    UNION ALL SELECT request_id, kind FROM v_candidates WHERE negative
    UNION ALL SELECT request_id, kind FROM v_candidates WHERE hint
    UNION ALL SELECT x.request_id, {O.KIND} FROM v_exact x JOIN v_memo e ON e.entry_id = x.exact_entry_id
) GROUP BY 1, 2
""")
def plan_fragment_mix(v):
    told = plan_reuse(v.requests, v.outline).telemetry
    kinds = F.array(*[F.struct(F.lit(k).alias("fragment_kind"), F.col(f"kind_{k}").alias("entries")) for k in KINDS])
    return told.select("request_id", F.inline(kinds)).filter("entries > 0")


@query("plan_union", """
SELECT request_id, entry_id, 'reusable' AS role FROM v_reusable
UNION ALL SELECT request_id, entry_id, 'negative' FROM v_candidates WHERE negative
UNION ALL SELECT request_id, entry_id, 'hint' FROM v_candidates WHERE hint
""")
def plan_union(v):
    plan = plan_reuse(v.requests, v.outline)
    parts = [("reusable", plan.reusable), ("negative", plan.negatives), ("hint", plan.hints)]
    rows = [df.select("request_id", "entry_id", F.lit(role).alias("role")) for role, df in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("compose_answer", """
SELECT request_id, string_agg(result, chr(10) ORDER BY scope_start, scope_end, entry_id) AS answer
FROM v_reusable WHERE result <> '' GROUP BY request_id
""")
def compose_answer(v):
    pieces = plan_reuse(v.requests, v.outline, ["result"]).reusable.filter("result <> ''")
    return folding.ordered_text(
        pieces, ["request_id"], ["scope_start", "scope_end", "entry_id"], F.col("result"), "answer"
    )


@query("compose_answer_udaf", """
SELECT request_id, min(scope_start) AS scope_start, sum(length(result))::BIGINT AS chars,
    string_agg(result, chr(10) ORDER BY scope_start, scope_end, entry_id) AS answer
FROM v_reusable GROUP BY request_id
""")
def compose_answer_udaf(v):
    pieces = plan_reuse(v.requests, v.outline, ["result"]).reusable
    rows = pieces.select(
        "request_id", "scope_start", F.format_string("%012d%s", "scope_end", "entry_id").alias("tie"),
        F.length("result").cast("bigint").alias("chars"), F.col("result").alias("answer"),
    )

    def join_rows(part):
        if len(part) == 1:
            return part
        head = part.iloc[[0]].copy()
        head["chars"] = part["chars"].sum()
        head["answer"] = "\n".join(part["answer"])
        return head

    schema = "request_id BIGINT, scope_start BIGINT, tie STRING, chars BIGINT, answer STRING"
    return folding.fold_in_pandas(rows, "request_id", "scope_start", join_rows, schema, ties=["tie"]).drop("tie")


@query("window_reuse_counts", f"""
SELECT w.document_id, count(*) AS windows, sum((have = w_end - w_start)::INT)::BIGINT AS reused_windows,
    sum((have < w_end - w_start)::INT)::BIGINT AS missing_windows
FROM (
    SELECT w.document_id, w.w, w_start, w_end, count(p.p) AS have FROM v_windows w LEFT JOIN (
        SELECT DISTINCT document_id, unnest(generate_series(scope_start, scope_end - 1)) AS p FROM v_fragments WHERE {O.COVERS}
    ) p ON p.document_id = w.document_id AND p.p >= w_start AND p.p < w_end
    GROUP BY ALL
) w GROUP BY 1
""")
def window_reuse_counts(v):
    from memograph.operators import matching

    windows = v.windows.select(
        "document_id", F.col("w").alias("window_no"), F.lit("").alias("content_hash"), "start", "end"
    )
    held = v.bare_fragments.filter(E.can_cover()).select("document_id", "scope_start", "scope_end", "content_hash")
    cut = matching.clipped(matching.overlapping(windows, held, ["document_id"])).select(
        "document_id", "window_no", F.col("clip_start").alias("start"), F.col("clip_end").alias("end")
    )
    keys = ["document_id", "window_no"]
    gaps = spans.gaps(cut, keys, windows.select(*keys, "start", "end")).select(*keys).distinct().withColumn("open", F.lit(True))
    return windows.join(gaps, keys, "left").groupBy("document_id").agg(
        F.count("*").alias("windows"), count_where(F.col("open").isNull()).alias("reused_windows"),
        count_where(F.col("open").isNotNull()).alias("missing_windows"),
    )


@query("tumbling_chunk_windows", """
SELECT document_id, w AS window_no, w_start AS "start", w_end AS "end", w_end - w_start AS chunks FROM v_windows
""")
def tumbling_chunk_windows(v):
    return v.windows.select(
        "document_id", F.col("w").cast("bigint").alias("window_no"), "start", "end",
        (F.col("end") - F.col("start")).alias("chunks"),
    )


@query("sliding_char_windows", rf"""
SELECT doc_id, char_start, length(piece)::BIGINT AS chars, md5(piece) AS piece_hash,
    row_number() OVER (ORDER BY doc_id, char_start) - 1 AS chunk_index
FROM (
    SELECT doc_id, i AS char_start, substr(t, i + 1, 3000) AS piece
    FROM (SELECT doc_id, t, unnest(generate_series(0, length(t) - 1, 2800)) AS i
        FROM (SELECT doc_id, {O.strip('text')} AS t FROM documents))
) WHERE length(piece) >= 50
""")
def sliding_char_windows(v):
    text = T.strip("text")
    cut = v.spread("documents", "doc_id").select("doc_id", T.char_windows(text).alias("pieces"))
    pieces = cut.select("doc_id", F.inline("pieces")).select(
        "doc_id", "char_start", F.length("text").cast("bigint").alias("chars"), F.md5("text").alias("piece_hash")
    )
    return folding.with_row_index(pieces, ["doc_id", "char_start"], "chunk_index")


MEANS = """
SELECT label, list(m ORDER BY i) AS q FROM (
    SELECT label, i, avg(x) AS m FROM (
        SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings
    ) GROUP BY 1, 2
) GROUP BY 1
"""


@query("top2_margin_gate", f"""
SELECT label::BIGINT AS query_id, top_score, round(top_score - coalesce(second_score, 0), 6)::DOUBLE AS margin,
    array_to_string(list_filter([CASE WHEN top_score < 0.82 THEN 'near_score_threshold' END,
        CASE WHEN top_score - coalesce(second_score, 0) < 0.06 THEN 'low_margin' END,
        CASE WHEN n > 1 THEN 'multi_fact_candidate' END], lambda x: x IS NOT NULL), ',') AS reasons
FROM (
    SELECT label, max(score) AS top_score, min(score) FILTER (rank = 2) AS second_score, count(*) AS n FROM (
        SELECT a.label, round(list_inner_product(q, embedding::DOUBLE[]), 6) AS score,
            row_number() OVER (PARTITION BY a.label ORDER BY round(list_inner_product(q, embedding::DOUBLE[]), 6) DESC, vec_id) AS rank
        FROM ({MEANS}) a, embeddings
    ) WHERE rank <= 2 GROUP BY label
)
""")
def top2_margin_gate(v):
    best = ranking.nearest(_label_means(v), v.vectors, "query_id", "vec_id", 2)
    tops = best.groupBy("query_id").agg(
        F.max("score").alias("top_score"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"),
        F.count("*").alias("n"),
    )
    margin = F.col("top_score") - F.coalesce("second", F.lit(0.0))
    return tops.select(
        "query_id", "top_score", F.round(margin, 6).alias("margin"),
        F.array_join(facts.gate_reasons(F.col("top_score"), margin, F.col("n"), F.lit(1.0)), ",").alias("reasons"),
    )


def _label_means(v):
    return ranking.mean_vectors(v.vectors, "label").select(F.col("label").cast("bigint").alias("query_id"), "embedding")


@query("needle_anchor", r"""
SELECT doc_id, d AS depth_index, coalesce(hit_char, last_char)::BIGINT AS char_pos, coalesce(hit_token, last_token)::BIGINT AS token_pos
FROM (
    SELECT doc_id, d, arg_min(char_pos, (delta, char_pos)) FILTER (delta >= 0) AS hit_char,
        arg_min(token_pos, (delta, char_pos)) FILTER (delta >= 0) AS hit_token,
        max(char_pos) AS last_char, arg_max(token_pos, char_pos) AS last_token
    FROM (
        SELECT *, token_pos / 1001.0::DOUBLE - d * 0.25::DOUBLE AS delta FROM (
            SELECT doc_id, unnest(generate_series(0, 4)) AS d, char_pos, least(token_pos, total - 1) AS token_pos FROM (
                SELECT doc_id, i,
                    coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS char_pos,
                    coalesce(sum(tokens) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS token_pos,
                    sum(tokens) OVER (PARTITION BY doc_id) AS total
                FROM (
                    SELECT doc_id, line, i, len(regexp_extract_all(line, '\S+')) AS tokens
                    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                        generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
                )
            )
        )
    ) GROUP BY doc_id, d
)
""")
def needle_anchor(v):
    places = samples.anchors(v.spread("documents", "doc_id").filter(T.strip("text") != ""), "doc_id", "text")
    asked = places.withColumn("depth_index", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(4).cast("bigint"))))
    return samples.nearest_anchor(asked, ["doc_id", "depth_index"], F.lit(1000.0), F.col("depth_index") * 0.25)
