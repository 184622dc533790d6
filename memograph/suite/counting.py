"""Rollups: store statistics, call ledger, accuracy, workload and signatures."""

from pyspark.sql import functions as F

from memograph.functions import facts, parsing, scoring
from memograph.functions import text as T
from memograph.operators import folding, reports, samples
from memograph.operators.reports import count_where, ratio
from memograph.plans import solve
from memograph.suite import oracle_views as O
from memograph.suite.registry import query


@query("memo_stats", """
SELECT count(*) AS entry_count, sum(len(dependencies))::BIGINT AS dependency_edge_count,
    sum(n_evidence)::BIGINT AS evidence_span_count, round(avg(confidence), 6) AS average_confidence
FROM v_memo
""")
def memo_stats(v):
    return reports.store_totals(v.outline)


@query("memo_stats_by_kind", f"""
SELECT 'fragment_kind' AS facet, {O.KIND} AS value, count(*) AS entries FROM v_memo GROUP BY 2
UNION ALL SELECT 'result_type', result_type, count(*) FROM v_memo GROUP BY 2
UNION ALL SELECT 'verifier_status', verifier_status, count(*) FROM v_memo GROUP BY 2
""")
def memo_stats_by_kind(v):
    return reports.store_counts(v.outline)


@query("memo_stats_by_mode", """
SELECT mode, count(*) AS entries FROM (SELECT unnest(reusable_as) AS mode FROM v_memo) GROUP BY 1
""")
def memo_stats_by_mode(v):
    return reports.store_modes(v.outline)


@query("chunk_count", """
SELECT coalesce(content_hash, 'all') AS content_hash, count(*) AS chunks FROM v_chunks GROUP BY ROLLUP (content_hash)
""")
def chunk_count(v):
    return v.chunks.rollup("content_hash").agg(F.count("*").alias("chunks")).select(
        F.coalesce("content_hash", F.lit("all")).alias("content_hash"), "chunks"
    )


@query("call_ledger_by_model", """
SELECT model, count(*) AS calls, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens,
    round(sum(cost), 6) AS cost_usd FROM v_costs GROUP BY model
""")
def call_ledger_by_model(v):
    return reports.ledger_by_model(v.calls)


GROUNDED = """
SELECT CASE WHEN len(bad) = 0 THEN 'GROUNDED' WHEN len(good) = 0 THEN 'INFERRED' ELSE 'PARTIAL' END AS grounding, len(bad) AS n_bad
FROM (SELECT list_filter(f, lambda x: contains(source_text, x)) AS good, list_filter(f, lambda x: NOT contains(source_text, x)) AS bad
    FROM (SELECT *, """ + O.figures("answer") + """ AS f FROM v_answers))
"""


@query("execution_summary", f"""
WITH totals AS (
    SELECT sum((event_type = 'click')::INT) AS exact, sum((event_type = 'view')::INT) AS close, count(*) AS n FROM v_calls
), found AS (
    SELECT sum((grounding = 'GROUNDED')::INT) AS grounded, sum((grounding = 'PARTIAL')::INT) AS part,
        sum((grounding = 'INFERRED')::INT) AS inferred, sum((n_bad = 0)::INT) AS agreed, count(*) AS n FROM ({GROUNDED})
)
SELECT 'exact_hits' AS metric, exact::DOUBLE AS value FROM totals
UNION ALL SELECT 'semantic_hits', close::DOUBLE FROM totals
UNION ALL SELECT 'cache_misses', (n - exact - close)::DOUBLE FROM totals
UNION ALL SELECT 'total_queries', n::DOUBLE FROM totals
UNION ALL SELECT 'hit_rate_percent', round((exact + close)::DOUBLE / n * 100, 1) FROM totals
UNION ALL SELECT 'grounded', grounded::DOUBLE FROM found
UNION ALL SELECT 'partial', part::DOUBLE FROM found
UNION ALL SELECT 'inferred', inferred::DOUBLE FROM found
UNION ALL SELECT 'grounding_rate_percent', round(grounded::DOUBLE / n * 100, 1) FROM found
UNION ALL SELECT 'consensus_agreed', agreed::DOUBLE FROM found
UNION ALL SELECT 'consensus_disputed', (n - agreed)::DOUBLE FROM found
UNION ALL SELECT 'consensus_rate_percent', round(agreed::DOUBLE / n * 100, 1) FROM found
""")
def execution_summary(v):
    kind = F.col("event_type")
    cached = v.calls.agg(
        count_where(kind == "click").alias("exact_hits"), count_where(kind == "view").alias("semantic_hits"),
        count_where(~kind.isin("click", "view")).alias("cache_misses"), F.count("*").alias("total_queries"),
    ).withColumn(
        "hit_rate_percent", F.round((F.col("exact_hits") + F.col("semantic_hits")) / F.nullif("total_queries", F.lit(0)) * 100, 1)
    )
    label = facts.grounding(F.col("answer"), F.col("source_text"))["grounding"]
    agreed = facts.consensus(F.col("answer"), F.col("source_text"))["consensus"] == "AGREED"
    found = v.answers.select(label.alias("label"), agreed.alias("agreed")).agg(
        count_where(F.col("label") == "GROUNDED").alias("grounded"), count_where(F.col("label") == "PARTIAL").alias("partial"),
        count_where(F.col("label") == "INFERRED").alias("inferred"), count_where(F.col("agreed")).alias("consensus_agreed"),
        count_where(~F.col("agreed")).alias("consensus_disputed"),
    )
    checked = F.col("grounded") + F.col("partial") + F.col("inferred")
    found = found.withColumns(
        {
            "grounding_rate_percent": F.round(F.col("grounded") / F.nullif(checked, F.lit(0)) * 100, 1),
            "consensus_rate_percent": F.round(F.col("consensus_agreed") / F.nullif(checked, F.lit(0)) * 100, 1),
        }
    )

    def long(df):
        pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in df.columns])
        return df.select(F.inline(pairs))

    return long(cached).unionByName(long(found))


@query("metric_deltas", """
WITH days AS (
    SELECT model, ts::DATE AS d, count(*) AS calls, sum(input_tokens)::BIGINT AS input_tokens,
        sum(output_tokens)::BIGINT AS output_tokens FROM v_calls GROUP BY 1, 2
)
SELECT n.model, strftime(n.d, '%Y-%m-%d') AS day, (n.calls - coalesce(p.calls, 0))::BIGINT AS delta_calls,
    (n.input_tokens - coalesce(p.input_tokens, 0))::BIGINT AS delta_input_tokens,
    (n.output_tokens - coalesce(p.output_tokens, 0))::BIGINT AS delta_output_tokens
FROM days n LEFT JOIN days p ON p.model = n.model AND p.d + 1 = n.d
""")
def metric_deltas(v):
    counters = ["calls", "input_tokens", "output_tokens"]
    days = v.calls.groupBy("model", F.to_date("ts").alias("day")).agg(
        F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens")
    )
    before = days.withColumn("day", F.date_add("day", 1))
    return reports.counter_deltas(days, before, ["model", "day"], counters).withColumn(
        "day", F.date_format("day", "yyyy-MM-dd")
    )


CONTAINS = "len(list_filter(gold, lambda g: contains(prediction, g))) > 0"


@query("accuracy_grouping_sets", f"""
SELECT task, length, grouping(task, length)::BIGINT AS level, count(*) AS samples, round(avg(({CONTAINS})::INT::DOUBLE), 6) AS accuracy
FROM v_predictions GROUP BY GROUPING SETS ((length), (task), (task, length), ())
""")
def accuracy_grouping_sets(v):
    scored = v.predictions.withColumn("score", scoring.contains_any(F.col("prediction"), F.col("gold")))
    return reports.accuracy_report(scored, "score")


@query("run_totals", f"""
WITH states AS (
    SELECT r.task_signature, r.request_id, w, least(4, r_end - r_start - 4 * w) AS size, count(DISTINCT p.p) AS have
    FROM (SELECT *, unnest(generate_series(0, (r_end - r_start - 1) // 4)) AS w FROM v_pending WHERE r_end > r_start) r
    LEFT JOIN v_positions p ON p.request_id = r.request_id AND p.p >= r_start + 4 * w AND p.p < least(r_start + 4 * w + 4, r_end)
    GROUP BY ALL
)
SELECT task_signature, count(DISTINCT request_id) AS requests, count(*) AS windows, sum((have = size)::INT)::BIGINT AS reused_windows,
    sum((have < size)::INT)::BIGINT AS missing_windows, round(sum((have = size)::INT)::DOUBLE / count(*), 6) AS window_reuse_ratio,
    round(sum(have)::DOUBLE / sum(size), 6) AS coverage_ratio
FROM states GROUP BY 1
""")
def run_totals(v):
    from memograph.plans.reuse import plan_reuse

    pending = plan_reuse(v.requests, v.outline).pending
    fragments_only = v.outline
    states = solve.window_states(solve.windows_of(pending, 4), fragments_only)
    size = F.col("end") - F.col("start")
    per_request = states.groupBy("task_signature", "parent_id").agg(
        F.count("*").alias("windows"), count_where(F.col("is_complete")).alias("reused"), F.sum(size).alias("size"),
        F.sum(size - F.col("missing_length")).alias("have"),
    )
    totals = per_request.groupBy("task_signature").agg(
        F.count("*").alias("requests"), F.sum("windows").alias("windows"), F.sum("reused").alias("reused_windows"),
        F.sum("size").alias("size"), F.sum("have").alias("have"),
    )
    return totals.select(
        "task_signature", "requests", "windows", "reused_windows",
        (F.col("windows") - F.col("reused_windows")).alias("missing_windows"),
        ratio(F.col("reused_windows"), F.col("windows")).alias("window_reuse_ratio"),
        ratio(F.col("have"), F.col("size")).alias("coverage_ratio"),
    )


@query("cost_projection", """
SELECT count(*) AS samples, round(sum(cost), 8) AS total_cost_usd, round(sum(cost) / count(*), 8) AS avg_cost_usd_per_sample,
    round(sum(cost) / count(*) * 1000, 4) AS projected_cost_usd, round(sum(latency_ms) / count(*), 3) AS avg_latency_ms,
    round(sum(from_cache::INT)::DOUBLE / count(*), 6) AS cache_hit_rate
FROM v_costs
""")
def cost_projection(v):
    cost = reports.call_cost(F.col("model"), F.col("input_tokens"), F.col("output_tokens"))
    return reports.cost_projection(v.calls, cost, 1000)


@query("cache_hit_rate", """
SELECT model, count(*) AS calls, sum(from_cache::INT)::BIGINT AS hits, round(avg(from_cache::INT), 6) AS hit_rate FROM v_calls GROUP BY 1
""")
def cache_hit_rate(v):
    hits = count_where(F.col("from_cache"))
    return v.calls.groupBy("model").agg(F.count("*").alias("calls"), hits.alias("hits")).withColumn(
        "hit_rate", ratio(F.col("hits"), F.col("calls"))
    )


@query("workload_totals", """
SELECT count(*) AS haystacks, min(n_words) AS min_tokens, max(n_words) AS max_tokens, sum(n_words)::BIGINT AS total_tokens,
    sum(10 * ((n_chunks + 3) // 4 + 1))::BIGINT AS calls_cold_total
FROM v_docs
""")
def workload_totals(v):
    work = samples.workload(F.col("n_words"), F.lit(10), 80, 4)
    return v.documents.withColumns(work).agg(
        F.count("*").alias("haystacks"), F.min("n_words").alias("min_tokens"), F.max("n_words").alias("max_tokens"),
        F.sum("n_words").alias("total_tokens"), F.sum("calls_cold_total").alias("calls_cold_total"),
    )


@query("workload_estimate", """
SELECT doc_id, ceil(n_words / 80.0)::BIGINT AS chunks_per_sample, ceil(ceil(n_words / 80.0) / 4.0)::BIGINT AS windows_per_sample,
    (ceil(ceil(n_words / 80.0) / 4.0) + 1)::BIGINT AS calls_per_cold_sample,
    (10 * (ceil(ceil(n_words / 80.0) / 4.0) + 1))::BIGINT AS calls_cold_total,
    round(n_words::DOUBLE / 1000, 3) AS window_multiple, n_words > 1000 AS exceeds_window
FROM v_docs
""")
def workload_estimate(v):
    work = samples.workload(F.col("n_words"), F.lit(10).cast("bigint"), 80, 4, 1000)
    return v.documents.select("doc_id", *[c.alias(name) for name, c in work.items()])


@query("dataset_signature", """
WITH rows AS (
    SELECT task, sha256(concat_ws(chr(31), length, sample_id, question, prediction, array_to_string(gold, chr(30)))) AS d FROM v_predictions
), l0 AS (SELECT task, d AS place, sha256(d || ':' || count(*)) AS d FROM rows GROUP BY task, d),
l1 AS (SELECT task, substr(place, 1, 6) AS place, sha256(string_agg(d, chr(10) ORDER BY d)) AS d FROM l0 GROUP BY 1, 2),
l2 AS (SELECT task, substr(place, 1, 3) AS place, sha256(string_agg(d, chr(10) ORDER BY d)) AS d FROM l1 GROUP BY 1, 2)
SELECT task, substr(sha256(string_agg(d, chr(10) ORDER BY d)), 1, 16) AS signature FROM l2 GROUP BY 1
""")
def dataset_signature(v):
    row = F.concat_ws(
        "\x1f", "length", F.col("sample_id").cast("string"), "question", "prediction", F.array_join("gold", "\x1e")
    )
    return folding.content_signature(v.predictions, ["task"], row)


@query("corpus_signature", f"""
WITH rows AS (SELECT sha256('doc_' || lpad(doc_id::VARCHAR, 8, '0') || chr(31) || sha256(text)) AS d FROM documents WHERE {O.strip('text')} <> ''),
l0 AS (SELECT d AS place, sha256(d || ':' || count(*)) AS d FROM rows GROUP BY rows.d),
l1 AS (SELECT substr(place, 1, 6) AS place, sha256(string_agg(d, chr(10) ORDER BY d)) AS d FROM l0 GROUP BY 1),
l2 AS (SELECT substr(place, 1, 3) AS place, sha256(string_agg(d, chr(10) ORDER BY d)) AS d FROM l1 GROUP BY 1)
SELECT substr(sha256(string_agg(d, chr(10) ORDER BY d)), 1, 16) AS signature FROM l2
""")
def corpus_signature(v):
    return samples.corpus_signature(v.haystacks)


@query("duplicate_ids", """
SELECT md5(text) AS id, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1
""")
def duplicate_ids(v):
    return samples.duplicate_ids(v.table("documents").select(F.md5("text").alias("id")))


@query("namespace_key", """
SELECT source, 'docs__' || string_agg(DISTINCT lang, '-' ORDER BY lang) || '__' || count(DISTINCT n_chars) AS namespace
FROM documents GROUP BY source
""")
def namespace_key(v):
    kinds = v.table("documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    sizes = v.table("documents").select("source", "n_chars").distinct().groupBy("source").agg(F.count("*").alias("sizes"))
    langs = kinds.groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("lang")), "-").alias("langs"))
    key = F.concat(F.lit("docs__"), "langs", F.lit("__"), F.col("sizes"))
    return langs.join(sizes, "source").select("source", parsing.safe_segment(key).alias("namespace"))


@query("context_guard", f"""
SELECT doc_id, length(text) // 4 AS tokens, CASE WHEN length(text) // 4 > 4000 THEN 'summarise' WHEN length(text) // 4 > 2000 THEN 'ephemeral'
    ELSE 'pass' END AS guard
FROM documents
""")
def context_guard(v):
    return v.table("documents").select(
        "doc_id", T.estimate_tokens(F.col("text")).alias("tokens"), facts.guard(F.col("text")).alias("guard")
    )


