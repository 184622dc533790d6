"""Row schemas and fixed values of the memo data model."""

from __future__ import annotations

# Reuse modes a stored entry can offer.
EXACT_ANSWER = "exact_answer"
SUPPORTING_FACT = "supporting_fact"
SEARCH_HINT = "search_hint"
AGGREGATION_COMPONENT = "aggregation_component"
RULED_OUT = "ruled_out"

# Modes that account for a stretch of the document. Hints do not.
COVER_MODES = [EXACT_ANSWER, SUPPORTING_FACT, AGGREGATION_COMPONENT, RULED_OUT]

# Verifier states.
NOT_REQUIRED = "not_required"
UNVERIFIED = "unverified"
SUPPORTED = "supported"
REJECTED = "rejected"

NOT_FOUND = "not_found"

# Numeric meaning of confidence labels.
CONFIDENCE_LABELS = {
    "very high": 0.95,
    "high": 0.9,
    "medium": 0.6,
    "moderate": 0.6,
    "low": 0.3,
    "very low": 0.1,
    "none": 0.0,
}

# Price in USD per 1000 tokens (input, output), matched by substring of the model name.
PRICES_PER_1K = {"sonnet": (0.003, 0.015), "haiku": (0.00025, 0.00125)}

# Thresholds of retrieval, reuse gating and result guarding.
TOP_K_CANDIDATES = 5
RETRIEVE_TOP_K = 20
RERANK_TOP = 5
RERANK_THRESHOLD = 0.5
MIN_SCORE = 0.78
MIN_MARGIN = 0.03
SCORE_TRIGGER = 0.82
MARGIN_TRIGGER = 0.06
MIN_LEXICAL_SUPPORT = 0.20
MAX_FACTS = 5
EPHEMERAL_TOKENS = 2000
SUMMARISE_TOKENS = 4000
SUMMARY_PIECE_CHARS = 4000
SUMMARY_MAX_DEPTH = 5
INGEST_CHARS = 3000
INGEST_OVERLAP = 200
INGEST_MIN_CHARS = 50
PACKET_LIMIT = 12
PACKET_RESULT_CHARS = 800
PACKET_EVIDENCE_CHARS = 240
PACKET_EVIDENCE_SPANS = 3
PACKET_CONTEXT_CHARS = 1000

EVIDENCE = "ARRAY<STRUCT<document_id: STRING, start: BIGINT, end: BIGINT, unit: STRING, text: STRING>>"

MEMO_ENTRIES = f"""
    entry_id STRING, task_signature STRING, prompt STRING, task_type STRING,
    output_contract STRING, constraints_json STRING,
    corpus_id STRING, document_id STRING, scope_start BIGINT, scope_end BIGINT,
    unit STRING, content_hash STRING,
    result STRING, result_type STRING, reusable_as ARRAY<STRING>,
    evidence {EVIDENCE}, dependencies ARRAY<STRING>, confidence DOUBLE,
    verifier_status STRING, metadata_json STRING, created_at STRING
"""

MEMO_EDGES = """
    parent_entry_id STRING, child_entry_id STRING, edge_type STRING,
    created_at STRING, metadata_json STRING
"""

CONTEXT_CHUNKS = """
    corpus_id STRING, document_id STRING, chunk_index BIGINT, unit STRING,
    content_hash STRING, text STRING, metadata_json STRING
"""

REQUESTS = """
    request_id BIGINT, prompt STRING, task_type STRING, output_contract STRING,
    constraints_json STRING, task_signature STRING,
    corpus_id STRING, document_id STRING, start BIGINT, end BIGINT, unit STRING,
    content_hash STRING
"""

SCOPE_KEYS = ["corpus_id", "document_id", "unit"]


def column_names(ddl: str) -> list[str]:
    """Top-level column names of one of the DDL strings above, in order."""
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl).fieldNames()
