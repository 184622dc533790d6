"""One query per operator, each over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from memograph.llm import bpe, dedup, extraction, language_model, licences, negatives, neighbours, packing, quality, rules, sharding, toxicity, whitening
from memograph.llm.common import table
from memograph.llm.suite import query


@query("op3_best_fit_packing")
def op3_best_fit_packing(spark, folder):
    return packing.pack_documents(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op7_bpe")
def op7_bpe(spark, folder):
    return bpe.encode(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), digests=True)


@query("op4_minhash_near_dedup")
def op4_minhash_near_dedup(spark, folder):
    return dedup.near_duplicates(table(spark, folder, "documents"), words=4, percent=80)


@query("op5_quality_rules")
def op5_quality_rules(spark, folder):
    return rules.quality_rules(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op10_toxicity")
def op10_toxicity(spark, folder):
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op6_cross_polytope_neighbours")
def op6_cross_polytope_neighbours(spark, folder):
    embeddings = table(spark, folder, "embeddings")
    return neighbours.nearest(embeddings, embeddings.filter("vec_id % 100 = 0"), k=10)


@query("op1_quality_classifier")
def op1_quality_classifier(spark, folder):
    return quality.quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op2_html_extraction")
def op2_html_extraction(spark, folder):
    return extraction.extract(table(spark, folder, "pages"))


@query("op9_licence_scan", licences.oracle_sql())
def op9_licence_scan(spark, folder):
    return licences.scan(table(spark, folder, "documents"), licences.known_digests(spark))


@query("op8_stupid_backoff")
def op8_stupid_backoff(spark, folder):
    return language_model.backoff_scores(table(spark, folder, "documents"))


@query("op11_hilbert_shards", sharding.oracle_sql())
def op11_hilbert_shards(spark, folder):
    return sharding.shard_documents(table(spark, folder, "documents"))


@query("op12_whitening")
def op12_whitening(spark, folder):
    return whitening.whiten(table(spark, folder, "embeddings"))


@query("op13_hard_negatives", negatives.oracle_sql())
def op13_hard_negatives(spark, folder):
    return negatives.hard_negatives(table(spark, folder, "embeddings"))
