"""Registered queries against their SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_points
from tools.check_oracle import TABLES, canon

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="driver tables not present")

# One query per family; tools/check_oracle.py runs all of them.
CHECKED = [
    "coverage_ratio", "plan_telemetry", "plan_fragment_mix", "compose_answer", "candidates_interval_join", "memo_text_topk",
    "solve_gaps", "invalidate_closure", "cache_lookup", "accuracy_grouping_sets", "vector_topk", "stream_memo_upsert",
    "dataset_signature", "sliding_char_windows", "chunk_search_topk", "answer_from_memo",
]


def test_every_query_is_named_once_and_oracles_belong_to_queries():
    queries, oracles = entry_points.queries(), entry_points.oracle_sql()
    assert len(queries) >= 110 and set(oracles) <= set(queries)


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    df = entry_points.queries()[name](spark, str(FOLDER))
    result = con.execute(entry_points.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert canon(df.columns, [tuple(r) for r in df.collect()]) == canon(columns, result.fetchall())
