"""A stored index for substring search over chunks.

A search token holds only letters, digits, hyphens and underscores. Where a token without underscores occurs in a text, it lies
inside one *term*, a longest run of such characters. So the index keeps the distinct terms, the character pairs and
triples of every term, and for every chunk the terms it holds, in one row. A token looks up its rarest triple, the terms
found there are compared with it exactly, and the chunks that hold them are all the chunks it occurs in; no text is read. The
terms found go to the chunks, so that of the chunks only hits are shuffled. As an underscore stands for any character, a token with one is only proposed by its longest piece and then held against the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memograph.functions import entries as E
from memograph.functions.text import search_tokens
from memograph.operators.ranking import matched, top_k
from memograph.session import ensure_checkpointing
from memograph.sources.batches import Batches

TERM = "[a-z0-9_-]+"
CHUNK = ["corpus_id", "document_id", "unit", "content_hash", "chunk_index"]
CHUNK_DDL = "corpus_id STRING, document_id STRING, unit STRING, content_hash STRING, chunk_index BIGINT"
SCHEMAS = {"grams": "gram STRING, term STRING", "held": f"{CHUNK_DDL}, terms ARRAY<STRING>"}
# Pairs of token and term sent to all tasks; more are joined by a shuffle, with the same result.
SENT_PAIRS = 200_000


def grams(term: Column) -> Column:
    """Distinct pairs and triples of neighbouring characters."""

    def of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(term) - (n - 1))
        return F.when(F.length(term) >= n, F.transform(starts, lambda i: F.substring(term, i, n))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(of(2), of(3)))


class LexicalIndex:
    """Terms of chunks in a folder, appended to in batches; of several versions of a chunk the latest counts.

    Null texts are texts without terms. A repeated batch changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.batches = Batches(spark, path, SCHEMAS)

    def add(self, chunks: DataFrame, batch: str) -> None:
        if self.batches.has(batch):
            return
        commit = self.batches.begin()
        terms = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(TERM), F.lit(0)))
        self.batches.write(commit, "held", chunks.select(*CHUNK, F.filter(terms, lambda t: F.length(t) > 1).alias("terms")))
        fresh = self.batches.written(commit, "held").select(F.explode("terms").alias("term")).distinct()
        self.batches.write(commit, "grams", fresh.select(F.explode(grams(F.col("term"))).alias("gram"), "term"))
        self.batches.publish(commit, batch)

    def _terms_with(self, tokens: DataFrame) -> DataFrame:
        """token, term: the terms that hold each of the distinct literal ``tokens``, of two characters or more."""
        widest = F.when(F.length("token") > 2, 3).otherwise(2)
        asked = tokens.select("token", F.explode(F.filter(grams(F.col("token")), lambda g: F.length(g) == widest)).alias("gram"))
        known = self.batches.read("grams")
        sizes = known.join(asked.select("gram").distinct(), "gram").groupBy("gram").agg(F.count("*").alias("terms"))
        # A triple that no term has is the rarest of all, so a token with one is left without candidates.
        rarest = asked.join(sizes, "gram", "left").groupBy("token").agg(
            F.min(F.struct(F.coalesce("terms", F.lit(0)).alias("terms"), "gram"))["gram"].alias("gram")
        )
        found = rarest.join(known, "gram").filter(F.contains("term", "token"))
        return found.select("token", "term").distinct()

    def _current(self, hits: DataFrame) -> DataFrame:
        """Hits in the latest version of their chunk."""
        if len(self.batches.published()) > 1:
            newest = self.batches.read("held").groupBy(*CHUNK).agg(F.max("seq").alias("seq"))
            hits = hits.join(newest, [*CHUNK, "seq"], "left_semi")
        return hits.drop("seq")

    def hits(self, wanted: DataFrame, chunks: DataFrame, scope: list[str]) -> DataFrame:
        """token and chunk key of all chunks whose lower-cased text is LIKE ``%token%``.

        ``wanted`` has ``token`` and the columns of ``scope``, within which a token is asked for; ``chunks`` gives the texts that
        tokens with underscores are held against.
        """
        wild = F.contains("token", F.lit("_"))
        longest = F.reduce(F.split("token", "_"), F.lit(""), lambda best, p: F.when(F.length(p) > F.length(best), p).otherwise(best))
        pieces = wanted.select("token").distinct().select(
            "token", wild.alias("wild"), F.when(wild, longest).otherwise(F.col("token")).alias("piece")
        )
        terms = self._terms_with(pieces.filter(F.length("piece") > 1).select(F.col("piece").alias("token")).distinct())
        ensure_checkpointing(self.spark)
        named = pieces.join(terms.withColumnRenamed("token", "piece"), "piece").select("token", "wild", "term").checkpoint()
        if named.count() <= SENT_PAIRS:
            named = F.broadcast(named)
        postings = self.batches.read("held").select(*CHUNK, "seq", F.explode("terms").alias("term"))
        held = postings.join(named, "term").select("token", "wild", *CHUNK, "seq").distinct()
        proposed = self._current(held.join(wanted.distinct(), ["token", *scope], "left_semi"))
        text = F.like(F.lower("text"), F.concat(F.lit("%"), F.col("token"), F.lit("%")))
        texts = chunks.select(*CHUNK, "text")
        checked = proposed.filter("wild").join(texts, CHUNK).filter(text)
        # A token without two literal characters in a row can be anywhere; it meets the texts of its scope.
        loose = wanted.join(pieces.filter(F.length("piece") < 2).select("token"), "token", "left_semi").distinct()
        if scope:
            anywhere = texts.join(loose, scope).filter(text)
        else:
            listed = [r["token"] for r in loose.collect()]
            anywhere = texts.select("*", F.explode(F.array(*map(F.lit, listed)).cast("array<string>")).alias("token")).filter(text)
        return proposed.filter("NOT wild").select("token", *CHUNK).unionByName(checked.select("token", *CHUNK)).unionByName(
            anywhere.select("token", *CHUNK)
        )

    def _best(self, asked: DataFrame, chunks: DataFrame, scope: list[str], limit: int, same_version: bool) -> DataFrame:
        """Best chunks per ``ask``: it has ``tokens``, the columns of ``scope`` and, with ``same_version``, ``wanted_hash``."""
        ensure_checkpointing(self.spark)
        hash_column = ["wanted_hash"] if same_version else []
        counted = asked.select("ask", *scope, *hash_column, F.explode("tokens").alias("token")).groupBy("ask", *scope, *hash_column, "token").agg(
            F.count("*").alias("times")
        ).checkpoint()
        found = self.hits(counted.select("token", *scope), chunks, scope).join(counted, ["token", *scope])
        if same_version:
            found = found.filter(E.compatible_hash(F.col("wanted_hash"), F.col("content_hash")))
        scored = found.groupBy("ask", *CHUNK).agg(F.sum("times").cast("double").alias("score"))
        best = top_k(scored, ["ask"], [F.desc("score"), F.asc("document_id"), F.asc("chunk_index")], limit)
        # Only now are texts read, those of the chunks that won.
        named = best.join(asked.select("ask", "tokens"), "ask").join(chunks.select(*CHUNK, "text"), CHUNK)
        return named.withColumn("matched_terms", matched(F.lower("text"), F.col("tokens"))).drop("tokens")

    def search(self, queries: list[str], chunks: DataFrame, limit: int = 20) -> DataFrame:
        """Corpus-wide search for a handful of query strings, as ``ranking.search_chunks``."""
        listed = F.explode(F.array(*[F.struct(F.lit(i).alias("ask"), F.lit(q).alias("query")) for i, q in enumerate(queries)]))
        asked = self.spark.range(1).select(listed.alias("a")).select("a.ask", search_tokens("a.query").alias("tokens"))
        return self._best(asked, chunks, [], limit, False).withColumnRenamed("ask", "query_no")

    def search_documents(self, requests: DataFrame, chunks: DataFrame, query: str, limit: int) -> DataFrame:
        """The best chunks of the document of each request. Requests that ask the same of a document share one search."""
        scope = ["corpus_id", "document_id", "unit"]
        named = requests.select("request_id", *scope, F.col("content_hash").alias("wanted_hash"), F.col(query).alias("query"))
        ask = F.md5(F.to_json(F.struct(*scope, "wanted_hash", "query")))
        keyed = named.withColumn("ask", ask)
        asked = keyed.select("ask", *scope, "wanted_hash", search_tokens("query").alias("tokens")).dropDuplicates(["ask"])
        best = self._best(asked, chunks, scope, limit, True)
        return keyed.select("request_id", "ask").join(best, "ask").drop("ask")
