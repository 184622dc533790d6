"""Solving, answering, caching, placement and streaming from end to end."""

import re
import uuid

from pyspark.sql import functions as F

from memograph.functions import text as T
from memograph.operators import folding, reports, samples
from memograph.plans import cache as caching
from memograph.plans import cached, retrieval, solve, summarise, verified
from memograph.plans import ingest as ingesting
from memograph.session import shared_dir
from memograph.sources.tables import MemoTables
from memograph.sources.views import AS_OF, PROMPTS, Views
from memograph.streaming import ingest
from memograph.suite import oracle_views as O
from memograph.suite.ranking import LABEL_QUESTIONS, RETRIEVED, label_questions, reranked
from memograph.suite.registry import query
from memograph.suite.scanning import TOP_ENTRIES


def _solver():
    return solve.built_in_solver(F.concat(F.lit("solved "), F.col("start"), F.lit("-"), F.col("end")))


def finished(scopes: str, windows: str) -> str:
    """Report of a batch after ``scopes`` (request_id, s, e) have been solved."""
    return f"""
WITH fresh AS (
    SELECT *, {O.ENTRY_ID} AS entry_id FROM (
        SELECT DISTINCT document_id, content_hash, prompt, task_signature, s AS scope_start, e AS scope_end,
            ['aggregation_component'] AS reusable_as, 'answer' AS result_type, 'solved ' || s || '-' || e AS result,
            []::VARCHAR[] AS dependencies, 1.0::DOUBLE AS confidence
        FROM v_pending JOIN ({scopes}) USING (request_id)
    )
), pool AS (
    SELECT task_signature, document_id, content_hash, scope_start, scope_end, reusable_as, dependencies, confidence, entry_id, result
    FROM v_memo WHERE {O.COVERS} AND NOT {O.NEGATIVE}
    UNION ALL
    SELECT task_signature, document_id, content_hash, scope_start, scope_end, reusable_as, dependencies, confidence, entry_id, result FROM fresh
), chosen AS (
    SELECT r.request_id, p.* FROM v_pending r JOIN pool p ON p.task_signature = r.task_signature AND p.document_id = r.document_id
        AND {O.hash_ok('p.content_hash', 'r.content_hash')} AND p.scope_start < r_end AND p.scope_end > r_start
    QUALIFY row_number() OVER (PARTITION BY r.request_id, p.scope_start, p.scope_end, p.content_hash
        ORDER BY list_contains(reusable_as, 'exact_answer') DESC, len(dependencies) DESC, confidence DESC, p.entry_id) = 1
), answers AS (
    SELECT request_id, string_agg(result, chr(10) ORDER BY scope_start, scope_end, entry_id) AS answer FROM chosen WHERE result <> '' GROUP BY 1
), held AS (SELECT request_id, count(*) AS n FROM v_positions GROUP BY 1)
SELECT r.request_id, CASE WHEN x.request_id IS NULL THEN 'composed' ELSE 'exact' END AS memo_type, {windows}
    round(CASE WHEN x.request_id IS NOT NULL OR r_end <= r_start THEN 1.0 ELSE coalesce(h.n, 0)::DOUBLE / (r_end - r_start) END, 6)::DOUBLE AS initial_ratio,
    1.0::DOUBLE AS final_ratio, coalesce(m.result, a.answer, '') AS answer
FROM v_requests r LEFT JOIN v_exact x USING (request_id) LEFT JOIN v_memo m ON m.entry_id = x.exact_entry_id
LEFT JOIN answers a ON a.request_id = r.request_id LEFT JOIN held h ON h.request_id = r.request_id
"""


STATES = """
    SELECT t.request_id, w, a AS s, z AS e, z - a AS size, count(p.p) AS have FROM (
        SELECT *, r_start + 4 * w AS a, least(r_start + 4 * w + 4, r_end) AS z
        FROM (SELECT *, unnest(generate_series(0, (r_end - r_start - 1) // 4)) AS w FROM v_pending WHERE r_end > r_start)
    ) t LEFT JOIN v_positions p ON p.request_id = t.request_id AND p.p >= a AND p.p < z GROUP BY ALL
"""
WINDOW_COUNTS = ", ".join(
    f"coalesce((SELECT {what} FROM ({STATES}) k WHERE k.request_id = r.request_id), 0)::BIGINT AS {name}"
    for what, name in [("count(*)", "windows"), ("sum((have = size)::INT)", "reused_windows"), ("sum((have < size)::INT)", "missing_windows")]
) + ","


@query("solve_windows", finished(f"SELECT request_id, s, e FROM ({STATES}) WHERE have < size", WINDOW_COUNTS))
def solve_windows(v):
    return solve.solve_windows(v.requests, v.outline, 4, _solver(), AS_OF).report


@query("solve_gaps", finished('SELECT request_id, "start" AS s, "end" AS e FROM v_holes', ""))
def solve_gaps(v):
    return solve.solve_gaps(v.requests, v.outline, _solver(), AS_OF).report


def total_words(query, pieces):
    """Add up the words that pieces report; those that report any are what the answer rests on."""
    found = [(int(m[1]), p) for p in pieces if (m := re.search(r"words (\d+)$", p["result"])) and int(m[1])]
    return {
        "result": f"total words {sum(n for n, _ in found)}", "confidence": min((p["confidence"] for _, p in found), default=1.0),
        "used_entry_ids": [i for _, p in found for i in p["used"]],
    }


@query("aggregate_callback", finished(f"SELECT request_id, s, e FROM ({STATES}) WHERE have < size", "").split("), answers AS (")[0] + f"""
), pieces AS (
    SELECT request_id, 0 AS place, scope_start, scope_end, entry_id, result, confidence, regexp_extract(result, 'words (\\d+)$', 1) AS found FROM chosen
    UNION ALL SELECT request_id, 1, scope_start, scope_end, entry_id, result, confidence, '' FROM v_candidates WHERE negative
), totals AS (
    SELECT request_id, sum(CASE WHEN found <> '' THEN found::BIGINT ELSE 0 END) AS total,
        coalesce(min(CASE WHEN found NOT IN ('', '0') THEN confidence END), 1.0) AS confidence,
        count(*) FILTER (found NOT IN ('', '0')) AS used
    FROM pieces GROUP BY 1
)
SELECT r.document_id, r_start AS scope_start, r_end AS scope_end, 'total words ' || total AS result, t.confidence,
    (SELECT md5(string_agg(p.entry_id, ',' ORDER BY place, p.scope_start, p.scope_end, p.entry_id)) FROM pieces p
        WHERE p.request_id = t.request_id AND (t.used = 0 OR found NOT IN ('', '0'))) AS dependencies
FROM totals t JOIN v_pending r ON r.request_id = t.request_id WHERE r_end > r_start
""")
def aggregate_callback(v):
    """Composites whose answers, confidence and dependencies come from a callback."""
    made = solve.solve_windows(v.requests, v.outline, 4, _solver(), AS_OF, total_words).composites(evidence=False)
    return made.select(
        "document_id", "scope_start", "scope_end", "result", "confidence", F.md5(F.array_join("dependencies", ",")).alias("dependencies")
    )


REWORDED_PAIRS = f"""
    SELECT r.request_id, r.task_signature, e.task_signature AS stored_signature, e.entry_id, e.result,
        len(list_intersect(list_distinct({O.search_tokens('r.prompt')}), list_distinct({O.search_tokens('e.prompt')}))) AS shared,
        len(list_distinct({O.search_tokens('r.prompt')})) + len(list_distinct({O.search_tokens('e.prompt')})) AS total
    FROM v_pending r JOIN v_memo e ON e.document_id = r.document_id AND {O.hash_ok('e.content_hash', 'r.content_hash')}
        AND scope_start = r_start AND scope_end = r_end AND e.task_signature <> r.task_signature
    WHERE e.verifier_status <> 'rejected' AND list_contains(e.reusable_as, 'exact_answer')
"""
ADOPTED = f"SELECT request_id, arg_min(result, entry_id) AS adopted FROM ({REWORDED_PAIRS}) WHERE shared >= 0.8 * (total - shared) GROUP BY 1"
STILL_OPEN = f"SELECT request_id, s, e FROM ({STATES}) WHERE have < size AND request_id NOT IN (SELECT request_id FROM ({ADOPTED}))"


@query("solve_verified", f"""
SELECT run::INTEGER AS run, f.request_id, CASE WHEN a.request_id IS NULL THEN f.memo_type ELSE 'semantic_exact' END AS memo_type,
    coalesce(a.adopted, f.answer) AS answer, initial_ratio,
    CASE run WHEN 1 THEN (SELECT count(DISTINCT task_signature || stored_signature) FROM ({REWORDED_PAIRS})) ELSE 0 END::BIGINT AS verifier_calls
FROM ({finished(STILL_OPEN, "")}) f LEFT JOIN ({ADOPTED}) a ON a.request_id = f.request_id, (VALUES (1), (2)) t(run)
""")
def solve_verified(v):
    """Windows after equivalent tasks, twice over one store of verdicts: the second run asks the verifier nothing."""
    verdicts = verified.Verdicts(v.spark, f"{shared_dir(v.spark)}/memograph/verdicts-{uuid.uuid4().hex}")

    def similar(pairs):
        left, right = (F.array_distinct(T.search_tokens(c)) for c in ("prompt", "stored_prompt"))
        shared = F.size(F.array_intersect(left, right))
        return pairs.withColumn("reuse_as", F.when(shared >= 0.8 * (F.size(left) + F.size(right) - shared), "exact").otherwise("different"))

    made = []
    for run in (1, 2):
        done = verified.solve_verified(v.requests, v.outline, 4, _solver(), AS_OF, similar, verdicts, f"run {run}")
        made.append(done.report.select(
            F.lit(run).alias("run"), "request_id", "memo_type", "answer", "initial_ratio", F.lit(done.calls).cast("bigint").alias("verifier_calls")
        ))
    return made[0].unionByName(made[1])


PYTHON_SOLVED = (
    finished(f"SELECT request_id, s, e FROM ({STATES}) WHERE have < size", "").split("), answers AS (")[0]
    .replace("'solved ' || s || '-' || e", "'fact:' || document_id || ':' || s").replace("1.0::DOUBLE AS confidence", "0.75::DOUBLE AS confidence")
)


@query("composite_entries", PYTHON_SOLVED + f"""
), parts AS (
    SELECT request_id, 0 AS place, scope_start, scope_end, entry_id, result FROM chosen
    UNION ALL SELECT request_id, 1, scope_start, scope_end, entry_id, '' FROM v_candidates WHERE negative
), made AS (
    SELECT request_id, list(entry_id ORDER BY place, scope_start, scope_end, entry_id) AS dependencies,
        string_agg(result, chr(10) ORDER BY scope_start, scope_end, entry_id) FILTER (place = 0 AND result <> '') AS result,
        sum(coalesce(n_evidence, 0))::BIGINT AS evidence_spans
    FROM parts LEFT JOIN (SELECT entry_id, n_evidence FROM v_memo) USING (entry_id) GROUP BY 1
), composed AS (
    SELECT document_id, content_hash, prompt, r_start AS scope_start, r_end AS scope_end, dependencies, result, 'answer' AS result_type,
        ['exact_answer'] AS reusable_as, evidence_spans
    FROM made JOIN v_pending USING (request_id) WHERE r_end > r_start AND result IS NOT NULL
)
SELECT {O.ENTRY_ID.replace("|| result ||", "|| replace(result, chr(10), chr(92) || 'n') ||")} AS entry_id, document_id, scope_start, scope_end, result,
    len(dependencies)::BIGINT AS dependency_count, evidence_spans FROM composed
""")
def composite_entries(v):
    """Composites of a window run with a Python solver, as they would be stored."""
    answer = solve.python_solver(lambda scope: {"result": f"fact:{scope['document_id']}:{scope['start']}", "confidence": 0.75})
    made = solve.solve_windows(v.requests, v.memo, 4, answer, AS_OF).composites()
    return made.select(
        "entry_id", "document_id", "scope_start", "scope_end", "result",
        F.size("dependencies").cast("bigint").alias("dependency_count"),
        F.size("evidence").cast("bigint").alias("evidence_spans"),
    )


CONTEXT_HITS = f"""
SELECT request_id, least(count(*), 12) AS n FROM (
    SELECT request_id, list_sum(list_transform({O.search_tokens('prompt')}, lambda t: (lower(text) LIKE '%' || t || '%')::INT)) AS score
    FROM v_requests r JOIN v_chunks c ON c.document_id = r.document_id AND {O.hash_ok('c.content_hash', 'r.content_hash')}
) WHERE score > 0 GROUP BY 1
"""


@query("reuse_packets", f"""
SELECT r.request_id, coalesce(t.n, 0)::BIGINT AS memo_entries, coalesce(c.n, 0)::BIGINT AS context_chunks, t.best AS best_entry_id
FROM v_requests r LEFT JOIN (SELECT request_id, count(*) AS n, arg_min(entry_id, rank) AS best FROM ({TOP_ENTRIES}) GROUP BY 1) t USING (request_id)
LEFT JOIN ({CONTEXT_HITS}) c ON c.request_id = r.request_id
""")
def reuse_packets(v):
    both = retrieval.reuse_packets(v.requests, v.memo, v.chunks)

    def count(name):
        return F.coalesce(F.size(F.col(name)), F.lit(0)).cast("bigint")

    return both.select(
        "request_id", F.greatest(count("memo_packets"), F.lit(0)).alias("memo_entries"),
        F.greatest(count("context_packets"), F.lit(0)).alias("context_chunks"),
        F.get("memo_packets", F.lit(0))["entry_id"].alias("best_entry_id"),
    )


@query("answer_from_memo", f"""
SELECT r.request_id, CASE WHEN x.request_id IS NOT NULL THEN 'exact' WHEN b.request_id IS NOT NULL THEN 'memo_context_answer' ELSE 'planner_action' END AS memo_type,
    coalesce(m.result, b.answer, '') AS answer, coalesce(x.exact_entry_id, b.used, '') AS dependencies,
    CASE WHEN x.request_id IS NULL THEN 1 ELSE 0 END::BIGINT AS planner_calls
FROM v_requests r LEFT JOIN v_exact x USING (request_id) LEFT JOIN v_memo m ON m.entry_id = x.exact_entry_id
LEFT JOIN (
    SELECT request_id, arg_min(result, rank) AS answer, arg_min(entry_id, rank) AS used
    FROM ({TOP_ENTRIES}) WHERE result_type = 'answer' AND result <> '' GROUP BY 1
) b ON b.request_id = r.request_id
""")
def answer_from_memo(v):
    made = retrieval.answer_from_memo(v.requests, v.memo)
    return made.select("request_id", "memo_type", "answer", F.array_join("dependencies", ",").alias("dependencies"), "planner_calls")


@query("shared_context")
def shared_context(v):
    """Facts are solved once per document, then several questions are answered from them."""
    facts_of = solve.solve_windows(v.requests, v.memo, 4, _solver(), AS_OF)
    known = v.memo.unionByName(facts_of.solved)
    asked = F.array(*[F.struct(F.lit(i).alias("question_no"), F.lit(p).alias("q")) for i, p in enumerate(PROMPTS)])
    questions = v.requests.select("*", F.inline(asked)).select(
        (F.col("request_id") * 10 + F.col("question_no")).alias("request_id"), F.col("q").alias("prompt"),
        "task_type", F.lit("answer").alias("output_contract"), "constraints_json",
        F.xxhash64("q").cast("string").alias("task_signature"), "corpus_id", "document_id", "start", "end", "unit", "content_hash",
    )
    return retrieval.answer_from_memo(questions, known).select("request_id", "memo_type", "answer")


SEARCH_ANSWER = O.strip(f"string_split({O.strip('source_text')}, chr(10))[-1]")


@query("search_answers", f"""
WITH asked AS (
    SELECT label, query, CASE label WHEN 0 THEN '{PROMPTS[0]}' WHEN 1 THEN '{PROMPTS[1]}' WHEN 2 THEN '{PROMPTS[2]}' ELSE query END AS prompt
    FROM ({LABEL_QUESTIONS})
), known AS (
    SELECT substr(sha256({O.task_json('prompt')}), 1, 16) AS signature, arg_min(result, created_at || entry_id) AS result FROM v_memo
    WHERE verifier_status <> 'rejected' AND list_contains(reusable_as, 'exact_answer') GROUP BY 1
), texts AS (
    SELECT label, string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS source_text, count(*) AS n
    FROM ({reranked(RETRIEVED, 'label', 'vec_id', 5, 0.2)}) WHERE rank <= 3 GROUP BY 1
)
SELECT a.label::BIGINT AS query_id, CASE WHEN k.result IS NOT NULL THEN 'memo_exact' WHEN t.n IS NULL THEN 'nothing' ELSE 'retrieved' END AS source,
    CASE WHEN k.result IS NOT NULL THEN k.result WHEN t.n IS NULL THEN 'No relevant documents found.' ELSE {SEARCH_ANSWER} END AS answer,
    CASE WHEN k.result IS NOT NULL THEN 0 ELSE coalesce(t.n, 0) END::BIGINT AS sources, 'AGREED' AS consensus
FROM asked a LEFT JOIN known k ON k.signature = substr(sha256({O.task_json('a.prompt')}), 1, 16) AND a.label IN (0, 1, 2)
LEFT JOIN texts t ON t.label = a.label
""")
def search_answers(v):
    from memograph.functions import identity as I
    from memograph.sources.views import CONSTRAINTS, OUTPUT_CONTRACT, TASK_TYPE

    questions = label_questions(v)
    prompt = F.col("query")
    for label, text in enumerate(PROMPTS):
        prompt = F.when(F.col("query_id") == label, F.lit(text)).otherwise(prompt)
    signature = I.task_signature(prompt, F.lit(TASK_TYPE), F.lit(OUTPUT_CONTRACT), F.lit(CONSTRAINTS))
    requests = questions.select(F.col("query_id").alias("request_id"), signature.alias("task_signature"))
    texts = v.table("documents").select(F.col("doc_id").alias("vec_id"), "text")
    return retrieval.search(requests, v.memo, questions, v.vectors, texts, threshold=0.2)


LOOKUP_SQL = rf"""
SELECT l.lookup_id, coalesce(h.outcome, 'miss') AS outcome, h.cache_id, c.result, CASE WHEN h.cache_id IS NULL THEN NULL ELSE 'pass' END AS guard, g.grounding
FROM v_lookups l LEFT JOIN (
    SELECT lookup_id, arg_min(outcome, outcome) AS outcome, arg_min(cache_id, outcome || lpad(cache_id::VARCHAR, 12, '0')) AS cache_id FROM (
        SELECT l.lookup_id, c.cache_id, 'exact' AS outcome FROM v_lookups l JOIN v_cache c ON c.chunk_hash = l.chunk_hash
            AND lower({O.strip('c.query')}) = lower({O.strip('l.query')})
        UNION ALL
        SELECT lookup_id, cache_id, 'semantic' FROM (
            SELECT l.lookup_id, c.cache_id, len(list_intersect(list_distinct({O.search_tokens('l.query')}), list_distinct({O.search_tokens('c.query')}))) AS shared,
                len(list_distinct({O.search_tokens('l.query')})) + len(list_distinct({O.search_tokens('c.query')})) AS total
            FROM v_lookups l JOIN v_cache c ON c.chunk_hash = l.chunk_hash
        ) WHERE shared >= 0.8 * (total - shared)
    ) GROUP BY 1
) h USING (lookup_id)
LEFT JOIN v_cache c ON c.cache_id = h.cache_id
LEFT JOIN (
    SELECT o_orderkey, CASE WHEN len(list_filter(f, lambda x: NOT contains(source_text, x))) = 0 THEN 'GROUNDED'
        WHEN len(list_filter(f, lambda x: contains(source_text, x))) = 0 THEN 'INFERRED' ELSE 'PARTIAL' END AS grounding
    FROM (SELECT *, {O.figures('answer')} AS f FROM v_answers)
) g ON g.o_orderkey = h.cache_id
"""


@query("cache_lookup", LOOKUP_SQL)
def cache_lookup(v):
    return caching.lookup(v.lookups, v.cache)


@query("cached_query", f"""
WITH asked AS (SELECT lookup_id, chunk_hash, lower({O.strip('query')}) AS plain FROM v_lookups),
firsts AS (SELECT chunk_hash, plain, min(lookup_id) AS asked_by FROM asked GROUP BY 1, 2)
SELECT run::INTEGER AS run, lookup_id, CASE run WHEN 1 THEN 'miss' ELSE 'exact' END AS outcome, run = 2 AS from_cache, run = 1 AND lookup_id = asked_by AS executed,
    'run 1:' || asked_by AS cache_id, plain || ' | is settled at | $' || length(plain) || '.5M' AS result, 'pass' AS guard, 'INFERRED' AS grounding,
    CASE WHEN run = 1 THEN 'AGREED' END AS consensus
FROM asked JOIN firsts USING (chunk_hash, plain), (VALUES (1), (2)) t(run)
""")
def cached_query(v):
    """All lookups through an empty cache, twice: the second run executes nothing."""
    context = v.table("orders").select(F.col("o_orderkey").alias("lookup_id"), F.concat(F.lit("Ledger of customer "), "o_custkey").alias("context"))
    lookups = v.lookups.drop("chunk_hash").join(context, "lookup_id")
    store = cached.CacheStore(v.spark, f"{shared_dir(v.spark)}/memograph/answers-{uuid.uuid4().hex}")

    def execute(asked):
        return asked.withColumn("result", F.concat("plain", F.lit(" | is settled at | $"), F.length("plain"), F.lit(".5M")))

    runs = [cached.cached_query(lookups, store, execute, f"run {n}", AS_OF).withColumn("run", F.lit(n)) for n in (1, 2)]
    return runs[0].unionByName(runs[1]).drop("model", "divergent")


@query("ingest_corpus", f"""
WITH found AS (SELECT 'doc_' || doc_id AS filename, lang, coalesce({O.strip('text')}, '') AS t FROM documents),
rounds AS (
    SELECT 1 AS round, filename, 'added' AS state, length(t) AS n FROM found
    UNION ALL
    SELECT 2, filename, CASE lang WHEN 'fr' THEN 'removed' WHEN 'de' THEN 'changed' ELSE 'same' END,
        CASE lang WHEN 'fr' THEN 0 WHEN 'de' THEN length('Revised edition. ' || t) ELSE length(t) END FROM found
), cut AS (SELECT *, CASE WHEN n >= 50 THEN (n - 50) // 2800 + 1 ELSE 0 END AS windows FROM rounds)
SELECT round::INTEGER AS round, filename, state, windows::INTEGER AS windows, (CASE state WHEN 'same' THEN 0 ELSE windows END)::INTEGER AS embedded FROM cut
""")
def ingest_corpus(v):
    """All documents into an empty corpus, then again with one language revised and one gone."""
    corpus = ingesting.Corpus(v.spark, f"{shared_dir(v.spark)}/memograph/corpus-{uuid.uuid4().hex}")
    first = v.spread("documents", "doc_id").select(
        F.concat(F.lit("doc_"), "doc_id").alias("filename"), "lang", F.coalesce(T.strip("text"), F.lit("")).alias("text")
    )
    revised = F.when(F.col("lang") == "de", F.concat(F.lit("Revised edition. "), "text")).otherwise(F.col("text"))
    second = first.filter("lang IS DISTINCT FROM 'fr'").withColumn("text", revised)
    made = []
    for n, texts in enumerate((first, second), 1):
        found = texts.select("filename", "text", F.sha2("text", 256).alias("content_hash"), F.length("text").cast("bigint").alias("total_chars"))
        made.append(ingesting.ingest(found, corpus, f"round {n}").select(F.lit(n).alias("round"), "filename", "state", "windows", "embedded"))
    return made[0].unionByName(made[1])


@query("cache_lookup_scoped", LOOKUP_SQL.replace("JOIN v_cache c", "JOIN (SELECT * FROM v_cache WHERE data_scope_hash = 'scope-a') c"))
def cache_lookup_scoped(v):
    """Only rows made for the active data scope may answer."""
    return caching.lookup(v.lookups, v.cache, active_scope="scope-a")


@query("recursive_summarize", """
SELECT doc_id, levels::INTEGER AS levels, length(summary)::BIGINT AS chars, md5(summary) AS summary_hash FROM (
    SELECT doc_id, 0 AS levels, text AS summary FROM documents WHERE length(text) // 4 <= 4000
    UNION ALL
    SELECT doc_id, 1, string_agg(substr(text, i + 1, 200), chr(10) ORDER BY i) FROM (
        SELECT doc_id, text, unnest(generate_series(0, length(text) - 1, 4000)) AS i FROM documents WHERE length(text) // 4 > 4000
    ) GROUP BY doc_id
)
""")
def recursive_summarize(v):
    made = summarise.condense(v.spread("documents", "doc_id"), "doc_id", "text", summarise.leading_text())
    return made.select(
        "doc_id", "levels", F.length("summary").cast("bigint").alias("chars"), F.md5("summary").alias("summary_hash")
    )


def central_level(texts: str) -> str:
    """SQL of one level: doc_id and the summaries of the pieces of the long texts of ``texts``."""
    return f"""
    SELECT doc_id, string_agg(summary, chr(10) ORDER BY i) AS text FROM (
        SELECT doc_id, i, coalesce(string_agg(substr(sentence, 1, 2000), ' ' ORDER BY spot) FILTER (WHERE total <= 2000 OR rank = 1), '') AS summary FROM (
            SELECT *, sum(length(sentence) + 1) OVER best_first AS total, row_number() OVER best_first AS rank FROM (
                SELECT doc_id, i, spot, sentence, sum(others) * 1000 // max(n) AS score FROM (
                    SELECT *, count(*) OVER (PARTITION BY doc_id, i, word) - 1 AS others FROM (
                        SELECT doc_id, i, spot, sentence, len(words) AS n, unnest(words) AS word FROM (
                            SELECT *, list_distinct(list_filter(string_split(sentence, ' '), lambda w: w <> '')) AS words FROM (
                                SELECT doc_id, i, unnest(found) AS sentence, generate_subscripts(found, 1) AS spot FROM (
                                    SELECT doc_id, i, list_filter(list_transform(regexp_extract_all(substr(text, i + 1, 4000), '([^.!?\\s][^.!?\\n]*[.!?]*)', 1), lambda s: trim(s)), lambda s: s <> '') AS found
                                    FROM (SELECT doc_id, text, unnest(generate_series(0, length(text) - 1, 4000)) AS i FROM {texts} WHERE length(text) // 4 > 4000)
                                )
                            )
                        )
                    )
                ) GROUP BY ALL
            ) WINDOW best_first AS (PARTITION BY doc_id, i ORDER BY score DESC, spot)
        ) GROUP BY doc_id, i
    ) GROUP BY doc_id"""


LEVELS = 5


@query("summarize_central", f"""
WITH level0 AS (SELECT doc_id, text FROM documents), {", ".join(f"level{n} AS MATERIALIZED ({central_level(f'level{n - 1}')})" for n in range(1, LEVELS + 1))}
SELECT doc_id, levels::INTEGER AS levels, length(text)::BIGINT AS chars, md5(text) AS summary_hash
FROM ({" UNION ALL ".join(f"SELECT doc_id, text, {n} AS levels FROM level{n}" for n in range(LEVELS + 1))}) WHERE length(text) // 4 <= 4000
""")
def summarize_central(v):
    """Long documents condensed by their most central sentences, level by level; every sentence is read."""
    made = summarise.condense(v.spread("documents", "doc_id"), "doc_id", "text", summarise.central_sentences())
    return made.select("doc_id", "levels", F.length("summary").cast("bigint").alias("chars"), F.md5("summary").alias("summary_hash"))


@query("manifest_summary", """
SELECT 'run/' || model AS manifest, model, count(*) AS samples, round(avg(from_cache::INT), 6) AS initial_coverage_ratio,
    count(*) FILTER (NOT from_cache) AS model_calls, count(*) AS memo_entries
FROM v_calls GROUP BY model
""")
def manifest_summary(v):
    runs = v.calls.groupBy("model").agg(
        F.count("*").alias("n"), reports.count_where(~F.col("from_cache")).alias("calls"),
        F.round(F.avg(F.col("from_cache").cast("int")), 6).alias("share"),
    )
    body = F.to_json(
        F.struct(
            F.lit("ledger").alias("benchmark"), "model",
            F.struct(
                F.col("n").alias("questions"), F.col("calls").alias("model_calls"),
                F.col("share").alias("fact_initial_coverage_ratio"),
            ).alias("totals"),
            F.struct(F.col("n").alias("entry_count")).alias("memo_stats"),
        )
    )
    manifests = runs.select(F.concat(F.lit("run/"), "model").alias("manifest"), body.alias("body"))
    return reports.summarize_manifests(manifests).select(
        "manifest", "model", "samples", "initial_coverage_ratio", "model_calls", "memo_entries"
    )


@query("needle_placement", """
WITH cases AS (
    SELECT item_id AS seed_offset, text || ' The keeper of passage ' || item_id || ' is Ada' || item_id || '.' AS needle,
        'Nobody keeps passage ' || item_id || ' any more.' AS distractor, lpad(item_id::VARCHAR, 4, '0') || '_01_direct' AS test_name,
        row_number() OVER (ORDER BY item_id) - 1 AS case_no, count(*) OVER () AS cases
    FROM benchmark
), books AS (
    SELECT 'doc_' || lpad(doc_id::VARCHAR, 8, '0') AS haystack, doc_id, text, regexp_extract_all(text, '\\S+') AS words,
        string_split_regex(text, '\\S+') AS gaps
    FROM documents WHERE regexp_matches(text, '\\S')
), lines AS (
    SELECT haystack, char_pos, least(token_pos, total - 1) AS token_pos, total FROM (
        SELECT haystack, coalesce(sum(length(line) + 1) OVER before, 0) AS char_pos, coalesce(sum(n) OVER before, 0) AS token_pos,
            sum(n) OVER (PARTITION BY haystack) AS total
        FROM (SELECT *, len(regexp_extract_all(line, '\\S+')) AS n FROM (
            SELECT haystack, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM books))
        WINDOW before AS (PARTITION BY haystack ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    )
), asked AS (
    SELECT *, unnest(generate_series(0, 4)) AS d FROM (SELECT *, unnest([250, 1000]) AS len FROM lines)
), spots AS (
    SELECT haystack, len, d, max(total)::BIGINT AS total,
        coalesce(arg_min(char_pos, (delta, char_pos)) FILTER (delta >= 0), max(char_pos))::BIGINT AS char_pos,
        coalesce(arg_min(token_pos, (delta, char_pos)) FILTER (delta >= 0), arg_max(token_pos, char_pos))::BIGINT AS token_pos
    FROM (SELECT *, token_pos / (len + 1.0::DOUBLE) - d * 0.25::DOUBLE AS delta FROM asked) GROUP BY ALL
), cut AS (
    SELECT *, greatest(least(token_pos - round_even(len * d * 0.25::DOUBLE, 0)::BIGINT, total - least(len, total)), 0) AS first_token,
        test_name || '__' || haystack || '__L' || len || '__D' || lpad(d::VARCHAR, 2, '0') AS sample_id
    FROM spots JOIN books USING (haystack) JOIN cases ON cases.case_no = books.doc_id % cases.cases
), sliced AS (
    SELECT *, length(array_to_string(words[1:first_token], '')) + length(array_to_string(gaps[1:first_token + 1], '')) AS low,
        length(array_to_string(words[1:first_token + least(len, total)], '')) + length(array_to_string(gaps[1:first_token + least(len, total)], '')) AS high
    FROM cut
), ends AS (SELECT *, greatest(low, least(char_pos, high)) AS c FROM sliced
), halves AS (SELECT *, substr(text, low + 1, c - low) AS head, substr(text, c + 1, high - c) AS tail FROM ends
), lined AS (SELECT *, regexp_replace(head, '[^' || chr(10) || ']*$', '') AS whole_lines FROM halves
), placed AS (
    SELECT *, trim(CASE WHEN whole_lines = '' THEN head ELSE whole_lines END || ' ' || needle || chr(10) || tail, E' \\n\\t\\r') AS body,
        ('0x' || substr(md5((42 + seed_offset) || '|' || sample_id || '|distractor'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
    FROM lined
), moved AS (
    SELECT *, regexp_extract_all(body, '\\S+') AS w, string_split_regex(body, '\\S+') AS g,
        CASE WHEN rb + ra <= 0 THEN CASE WHEN z <= 0.5 THEN 0.8 ELSE 0.2 END WHEN u * (rb + ra) <= rb THEN u * (rb + ra) + 0.2::DOUBLE
            ELSE z + 0.2::DOUBLE + u * (rb + ra) - rb END AS place
    FROM (SELECT *, d * 0.25::DOUBLE AS z, greatest(d * 0.25::DOUBLE - 0.4::DOUBLE, 0) AS rb, greatest(1 - d * 0.25::DOUBLE - 0.4::DOUBLE, 0) AS ra FROM placed)
), spotted AS (
    SELECT *, greatest(least(round_even(place * greatest(len(w) - 1, 1), 0)::BIGINT, len(w) - 1), 0) AS k FROM moved
), put AS (
    SELECT *, length(array_to_string(w[1:k], '')) + length(array_to_string(g[1:k + 1], '')) AS k_char FROM spotted
)
SELECT sample_id, len::VARCHAR AS length, d * 25.0::DOUBLE AS depth_percent, round(token_pos::DOUBLE / total, 9) AS static_depth,
    greatest(token_pos - first_token, 0)::BIGINT AS token_depth, round(place, 6) AS distractor_depth,
    md5(trim(substr(body, 1, k_char) || ' ' || distractor || chr(10) || substr(body, k_char + 1), E' \\n\\t\\r')) AS context_hash
FROM put
""")
def needle_placement(v):
    """Every haystack with one of the benchmark's needles, by its number, at every length and depth."""
    cases = samples.expand_cases(v.experiments).filter("test_name LIKE '%_01_direct'").withColumn("item_id", F.col("seed_offset"))
    numbered = folding.with_row_index(cases.select("item_id"), ["item_id"], "case_no").join(cases, "item_id")
    chosen = v.haystacks.withColumn("case_no", F.pmod("doc_id", F.lit(max(v.table("benchmark").count(), 1))))
    placed = samples.place_needles(chosen.join(numbered, "case_no"), [250, 1000], 5, seed=42)
    return placed.select(
        "sample_id", "length", "depth_percent", F.round("static_depth", 9).alias("static_depth"), "token_depth", "distractor_depth",
        F.md5("context").alias("context_hash"),
    )


class _Streamed(Views):
    """The same views with driver tables read as streams."""

    def table(self, name):
        return ingest.stream_table(self.spark, self.folder, name)


def _new_folder(v: Views, name: str) -> str:
    import uuid

    return f"{shared_dir(v.spark)}/memograph/{v.spark.sparkContext.applicationId}/streams/{name}-{uuid.uuid4().hex}"


@query("stream_call_ledger", """
SELECT model, count(*) AS calls, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens,
    round(sum(cost), 6) AS cost_usd FROM v_costs GROUP BY model
""")
def stream_call_ledger(v):
    folder = _new_folder(v, "ledger")
    ingest.ingest_calls(_Streamed(v.spark, v.folder).calls, f"{folder}/rows", f"{folder}/checkpoint").awaitTermination()
    return ingest.ledger(v.spark, f"{folder}/rows")


@query("stream_memo_upsert", """
SELECT verifier_status, count(*) AS entries FROM (
    SELECT CASE WHEN entry_id IN (SELECT entry_id FROM v_reach) THEN 'rejected' ELSE verifier_status END AS verifier_status FROM v_memo
) GROUP BY 1
""")
def stream_memo_upsert(v):
    """Stored entries arrive as a stream, then the changed scopes reject what is stale."""
    folder = _new_folder(v, "memo")
    tables = MemoTables(v.spark, f"{folder}/tables", "docs")
    v.memo.write.parquet(f"{folder}/arriving/memo.parquet")
    v.changed.write.parquet(f"{folder}/changes/changed.parquet")

    def stream(path, schema):
        return v.spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(path)

    ingest.ingest_entries(stream(f"{folder}/arriving", v.memo.schema), tables, f"{folder}/c1").awaitTermination()
    ingest.apply_changes(
        stream(f"{folder}/changes", v.changed.schema), tables, f"{folder}/c2", "text changed", AS_OF
    ).awaitTermination()
    return tables.read("memo_entries").groupBy("verifier_status").agg(F.count("*").alias("entries"))


@query("sample_runs", r"""
SELECT sample_id, task, length, windows AS delta_calls, 0.0::DOUBLE AS initial_ratio,
    (SELECT string_agg('solved ' || (2 * i) || '-' || least(2 * i + 2, chunks), chr(10) ORDER BY i) FROM unnest(generate_series(0, windows - 1)) t(i)) AS prediction
FROM (
    SELECT *, ((chunks + 1) // 2)::BIGINT AS windows FROM (
        SELECT *, ((greatest(len(list_filter(regexp_split_to_array(prediction, '\s+'), lambda x: x <> '')), 1) + 19) // 20)::BIGINT AS chunks
        FROM v_predictions
    )
)
""")
def sample_runs(v):
    from memograph.plans.runs import run_samples

    made = v.predictions.select(
        "sample_id", "task", "length", "question", "gold", F.col("prediction").alias("context"),
        F.col("sample_id").cast("string").alias("document_id"), F.lit("").alias("content_hash"),
    )
    rows, _ = run_samples(made, v.memo.filter("false"), _solver(), "talk", 20, 2, AS_OF)
    return rows.select("sample_id", "task", "length", "delta_calls", "initial_ratio", "prediction")
