"""Top-k retrieval, re-scoring and ordered listings."""

import uuid

from pyspark.sql import functions as F

from memograph.functions import text as T
from memograph.operators import ranking
from memograph.plans import retrieval
from memograph.session import shared_dir
from memograph.sources.lexical_index import LexicalIndex
from memograph.sources.vector_index import VectorIndex
from memograph.suite import oracle_views as O
from memograph.suite.registry import query
from memograph.suite.stretches import MEANS, _label_means

CHUNK_QUERIES = ["Which backup channel should launch use?", "the thing and the rest of his station", "nicht ohne die leau_re"]
_LISTED = ", ".join(f"({i}, '{q}')" for i, q in enumerate(CHUNK_QUERIES))


CHUNK_SEARCH = f"""
WITH asked AS (SELECT query_no, {O.search_tokens('q')} AS tokens FROM (VALUES {_LISTED}) t(query_no, q))
SELECT query_no, document_id, chunk_index, score, rank::INTEGER AS rank,
    array_to_string(list_filter(tokens, lambda t: contains(lower(text), t)), ' ') AS matched_terms
FROM (
    SELECT *, row_number() OVER (PARTITION BY query_no ORDER BY score DESC, document_id, chunk_index) AS rank FROM (
        SELECT query_no, tokens, document_id, chunk_index, text,
            list_sum(list_transform(tokens, lambda t: (lower(text) LIKE '%' || t || '%')::INT))::DOUBLE AS score
        FROM v_chunks, asked
    ) WHERE score > 0
) WHERE rank <= 20
"""


@query("chunk_search_topk", CHUNK_SEARCH)
def chunk_search_topk(v):
    found = ranking.search_chunks(v.chunks, CHUNK_QUERIES, 20)
    return found.select(
        "query_no", "document_id", "chunk_index", "score", "rank", F.array_join("matched_terms", " ").alias("matched_terms")
    )


CONTEXT_PACKETS = f"""
SELECT request_id, document_id, chunk_index, score, rank::INTEGER AS rank, md5(substr(text, 1, 1000)) AS text_hash, length(text) > 1000 AS text_truncated
FROM (
    SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, document_id, chunk_index) AS rank FROM (
        SELECT request_id, c.document_id, chunk_index, text,
            list_sum(list_transform({O.search_tokens('prompt')}, lambda t: (lower(text) LIKE '%' || t || '%')::INT))::DOUBLE AS score
        FROM v_requests r JOIN v_chunks c ON c.document_id = r.document_id AND {O.hash_ok('c.content_hash', 'r.content_hash')}
    ) WHERE score > 0
) WHERE rank <= 12
"""


@query("context_packets", CONTEXT_PACKETS)
def context_packets(v):
    made = retrieval.context_packets(v.requests, v.chunks)
    return made.select("request_id", "document_id", "chunk_index", "score", "rank", F.md5("text").alias("text_hash"), "text_truncated")


def _lexical_index(v):
    """An index of all chunks in two batches, the second one appended."""
    index = LexicalIndex(v.spark, f"{shared_dir(v.spark)}/memograph/terms-{uuid.uuid4().hex}")
    for batch in (0, 1):
        index.add(v.chunks.filter(F.pmod(F.crc32("document_id"), F.lit(2)) == batch), f"batch {batch}")
    return index


@query("chunk_search_indexed", CHUNK_SEARCH)
def chunk_search_indexed(v):
    found = _lexical_index(v).search(CHUNK_QUERIES, v.chunks, 20)
    return found.select(
        "query_no", "document_id", "chunk_index", "score", "rank", F.array_join("matched_terms", " ").alias("matched_terms")
    )


@query("context_packets_indexed", CONTEXT_PACKETS)
def context_packets_indexed(v):
    made = retrieval.context_packets(v.requests, v.chunks, index=_lexical_index(v))
    return made.select("request_id", "document_id", "chunk_index", "score", "rank", F.md5("text").alias("text_hash"), "text_truncated")


VECTOR_TOPK = f"""
SELECT label::BIGINT AS query_id, vec_id, score, rank::INTEGER AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM (
        SELECT a.label, vec_id, round(list_inner_product(q, embedding::DOUBLE[]), 6) AS score FROM ({MEANS}) a, embeddings
    )
) WHERE rank <= 20
"""


@query("vector_topk", VECTOR_TOPK)
def vector_topk(v):
    return ranking.nearest(_label_means(v), v.vectors, "query_id", "vec_id", 20)


@query("vector_index_topk", VECTOR_TOPK)
def vector_index_topk(v):
    """The same from a stored index of two batches, the second one appended."""
    index = VectorIndex(v.spark, f"{shared_dir(v.spark)}/memograph/vectors-{uuid.uuid4().hex}")
    for batch in (0, 1):
        index.add(v.vectors.filter(F.pmod("vec_id", F.lit(2)) == batch), f"batch {batch}")
    return index.nearest(_label_means(v), 20)


@query("bucket_vector_topk", f"""
SELECT label, vec_id, score, rank::INTEGER AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM (
        SELECT e.label, vec_id, round(list_inner_product(q, embedding::DOUBLE[]), 6) AS score FROM ({MEANS}) a JOIN embeddings e ON e.label = a.label
    )
) WHERE rank <= 5
""")
def bucket_vector_topk(v):
    asked = ranking.mean_vectors(v.vectors, "label").withColumnRenamed("embedding", "wanted")
    scored = v.vectors.join(asked, "label").select(
        "label", "vec_id", F.round(ranking.dot(F.col("wanted"), F.col("embedding")), 6).alias("score")
    )
    return ranking.top_k(scored, ["label"], [F.desc("score"), F.asc("vec_id")], 5)


OVERLAP = f"""len(list_intersect(list_distinct({O.search_tokens('query')}), {O.search_tokens('text')}))::DOUBLE
    / nullif(len(list_distinct({O.search_tokens('query')})), 0)"""


def reranked(source: str, key: str, tie: str, top: int, threshold: float) -> str:
    return f"""
    SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY rerank_score DESC, {tie}) AS rank
        FROM (SELECT *, round(coalesce({OVERLAP}, 0.0), 6)::DOUBLE AS rerank_score FROM ({source}))
    ) WHERE rank <= {top} AND rerank_score >= {threshold}
    """


def _first_sentence(v):
    """First sentence of every document as the query about it."""
    return v.spread("documents", "doc_id").select(
        F.col("doc_id").cast("string").alias("document_id"), F.get(T.sentences("text"), F.lit(0)).alias("query")
    ).filter("query IS NOT NULL")


FIRST_SENTENCE = rf"""
SELECT doc_id::VARCHAR AS document_id, string_split(regexp_replace({O.strip('text')}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))[1] AS query
FROM documents WHERE {O.strip('text')} <> ''
"""


@query("rerank_gate", f"""
SELECT document_id, chunk_index, rerank_score, rank::INTEGER AS rank
FROM ({reranked(f"SELECT c.document_id, chunk_index, text, query FROM v_chunks c JOIN ({FIRST_SENTENCE}) q USING (document_id)", 'document_id', 'chunk_index', 5, 0.5)})
""")
def rerank_gate(v):
    pairs = v.chunks.join(_first_sentence(v), "document_id")
    kept = ranking.rerank(pairs, "document_id", "query", "text", "chunk_index")
    return kept.select("document_id", "chunk_index", "rerank_score", "rank")


def label_questions(v):
    """Per label: the mean vector, and the first sentence of its first text as the question."""
    texts = _first_sentence(v).select(F.col("document_id").cast("bigint").alias("vec_id"), "query")
    first = v.vectors.join(texts, "vec_id").groupBy(F.col("label").cast("bigint").alias("query_id")).agg(
        F.min_by("query", "vec_id").alias("query")
    )
    return _label_means(v).join(first, "query_id")


LABEL_QUESTIONS = f"""
SELECT m.label, q AS vec, question AS query FROM ({MEANS}) m JOIN (
    SELECT label, arg_min(query, vec_id) AS question FROM embeddings JOIN ({FIRST_SENTENCE}) s ON s.document_id = vec_id::VARCHAR GROUP BY 1
) f ON f.label = m.label
"""
RETRIEVED = f"""
SELECT label, query, vec_id, text FROM (
    SELECT label, query, vec_id FROM (
        SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS near FROM (
            SELECT a.label, a.query, vec_id, round(list_inner_product(vec, embedding::DOUBLE[]), 6) AS score FROM ({LABEL_QUESTIONS}) a, embeddings
        )
    ) WHERE near <= 20
) JOIN documents ON doc_id = vec_id
"""


@query("retrieve_rerank", f"""
SELECT label::BIGINT AS query_id, vec_id, rerank_score, rank::INTEGER AS rank
FROM ({reranked(RETRIEVED, 'label', 'vec_id', 5, 0.2)})
""")
def retrieve_rerank(v):
    texts = v.table("documents").select(F.col("doc_id").alias("vec_id"), "text")
    found = retrieval.retrieve(label_questions(v), v.vectors, texts, threshold=0.2)
    return found.select("query_id", "vec_id", "rerank_score", "rank")


@query("top3_source_context", f"""
SELECT label::BIGINT AS query_id, count(*) AS sources, md5(string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS context_hash
FROM ({reranked(RETRIEVED, 'label', 'vec_id', 3, 0.0)}) GROUP BY 1
""")
def top3_source_context(v):
    texts = v.table("documents").select(F.col("doc_id").alias("vec_id"), "text")
    hits = retrieval.retrieve(label_questions(v), v.vectors, texts, threshold=0.0)
    joined = retrieval.top_sources(hits, [F.desc("rerank_score"), F.asc("vec_id")])
    return joined.select("query_id", "sources", F.md5("source_text").alias("context_hash"))


@query("limit_offset", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 10
""")
def limit_offset(v):
    orders = v.table("orders").select("o_orderkey", "o_totalprice")
    return orders.orderBy(F.desc("o_totalprice"), "o_orderkey").offset(10).limit(25)


@query("topn_per_group", """
SELECT task, sample_id, position::INTEGER AS position FROM (
    SELECT task, sample_id, row_number() OVER (PARTITION BY task ORDER BY sample_id) AS position FROM v_predictions
) WHERE position <= 7
""")
def topn_per_group(v):
    first = ranking.top_k(v.predictions.select("task", "sample_id"), ["task"], [F.asc("sample_id")], 7)
    return first.withColumnRenamed("rank", "position")


@query("graph_edges_sorted", """
SELECT parent_entry_id, child_entry_id, 'depends_on' AS edge_type FROM v_edges ORDER BY 1, 2, 3
""")
def graph_edges_sorted(v):
    return v.edges.orderBy("created_at", "parent_entry_id", "child_entry_id", "edge_type").select(
        "parent_entry_id", "child_entry_id", "edge_type"
    )
