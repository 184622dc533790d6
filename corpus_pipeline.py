"""The corpus pipeline: quality rules, toxicity, near duplicates, packing.

Every stage is a function of (spark, docs, sf_dir). The first three return rows of ``docs`` with its columns, those
that the stage keeps; the last returns the packed pieces of all documents that are left.

Null and empty texts have no words and go in the first stage. Very long texts are judged, compared and packed whole. Columns
beside doc_id, text and lang are carried along unread, whatever their names. Repeated rows go through the first two stages
each on its own and become one row in the third, which keeps one row per doc_id: of an id with several texts the
smallest text; rows without a doc_id all stay. A table without rows gives one at every stage. Ties do not occur: verdicts
are per row, and groups keep their smallest doc_id.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from memograph.llm import dedup, packing, rules, toxicity
from memograph.llm.common import stored, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the proven cutoffs reject; without labels the base rules alone decide."""
    return rules.kept_rows(docs, table(spark, sf_dir, "labels"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic; labels outside the evaluation fold are learned from."""
    return toxicity.kept_rows(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, the general setting for shingles; only op4 has four."""
    return dedup.kept_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2,048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", keep_quality), ("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("best_fit_packing", pack),
]
#: Tokenizers and calibrated neighbours are beyond SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
