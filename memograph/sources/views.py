"""Memo-shaped views over the driver tables.

All of them are narrow projections of one table (plus a join to the document labels),
so building the memo from documents needs no shuffle of the texts. Which windows are
already solved, and how, follows from a digest of document and window, standing in for
the history of a real store.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from memograph import schema as S
from memograph.functions import identity as I
from memograph.functions import text as T
from memograph.operators.spans import tumbling
from memograph.session import shared_dir

WORDS_PER_CHUNK = 80
CHUNKS_PER_WINDOW = 4
AS_OF = "2024-01-01T00:00:00Z"
TASK_TYPE = "document_qa"
OUTPUT_CONTRACT = "supported_answer"
CONSTRAINTS = '{"chunk_size":4}'
PROMPTS = [
    "Summarise the passage evidence",
    "Find the passage dates and figures",
    "List every person named in the passage",
]
REWORDED = [
    "the evidence of the passage  SUMMARISE",
    "figures and dates: find in the passage",
    "person named in passage, list every",
]


def _digit(key: Column, place: int) -> Column:
    return F.substring(key, place, 1)


def _by_document(key: Column, options: list[str] | list[Column]) -> Column:
    choice = _digit(key, 2)
    return F.when(choice < "5", options[0]).when(choice < "a", options[1]).otherwise(options[2])


_written: dict[str, StructType] = {}


class Views:
    """Driver tables of one folder and the views derived from them.

    The memo itself - document sizes, chunks, entries - is a stored set of tables: it is
    written once per application to the shared folder and read from there by every query. ``outline`` is the memo
    without the texts of its evidence: it follows from the documents' sizes, so a query that reads no evidence text cuts none.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def stored(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        label = hashlib.md5(self.folder.encode()).hexdigest()[:12]
        path = f"{shared_dir(self.spark)}/memograph/{self.spark.sparkContext.applicationId}/{label}/{name}"
        if path not in _written:
            rows = build()
            rows.write.mode("overwrite").parquet(path)
            _written[path] = rows.schema
        return self.spark.read.schema(_written[path]).parquet(path)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def spread(self, name: str, key: str) -> DataFrame:
        """A table for heavy per-row work: shuffled only if its files give too few tasks."""
        df = self.table(name)
        wanted = self.spark.sparkContext.defaultParallelism
        return df.repartition(wanted, key) if df.rdd.getNumPartitions() * 2 < wanted else df

    @cached_property
    def documents(self) -> DataFrame:
        """Sizes and keys of the documents that have at least one word; no texts."""
        return self.stored("documents", lambda: self._sized(T.count_words("text")).drop("text"))

    @cached_property
    def texts(self) -> DataFrame:
        """Documents with at least one word, cut into words."""
        return self._sized(F.size("words").cast("bigint"), T.words("text").alias("words"))

    def _sized(self, n_words: Column, text: Column | str = "text") -> DataFrame:
        return (
            self.spread("documents", "doc_id")
            .filter(T.strip("text") != "")
            .select("doc_id", "lang", "source", text)
            .withColumn("n_words", n_words)
            .withColumn("n_chunks", F.floor((F.col("n_words") + WORDS_PER_CHUNK - 1) / WORDS_PER_CHUNK))
            .withColumn("doc_key", F.md5(F.col("doc_id").cast("string")))
            .withColumn("document_id", F.col("doc_id").cast("string"))
            .withColumn("content_hash", F.when(_digit(F.col("doc_key"), 1) < "4", "").otherwise("v1"))
        )

    @cached_property
    def chunks(self) -> DataFrame:
        return self.stored("context_chunks", self._chunks)

    def _chunks(self) -> DataFrame:
        return self.texts.select(
            F.lit("docs").alias("corpus_id"),
            "document_id",
            F.posexplode(T.pack(F.col("words"), WORDS_PER_CHUNK)).alias("chunk_index", "text"),
            F.lit("chunk").alias("unit"),
            "content_hash",
        ).select(
            "corpus_id", "document_id", F.col("chunk_index").cast("bigint").alias("chunk_index"),
            "unit", "content_hash", "text", F.lit("{}").alias("metadata_json"),
        )

    @cached_property
    def windows(self) -> DataFrame:
        """Tumbling windows of chunks with the digest that decides their history."""
        return self._windows(self.documents)

    @staticmethod
    def _windows(documents: DataFrame) -> DataFrame:
        cut = tumbling(F.lit(0).cast("bigint"), F.col("n_chunks"), CHUNKS_PER_WINDOW)
        return (
            documents.select("*", F.posexplode(cut).alias("w", "span"))
            .select("*", "span.start", "span.end")
            .withColumn("window_key", F.md5(F.concat_ws(":", "document_id", F.col("w").cast("string"))))
            .drop("span")
        )

    @staticmethod
    def _as_entries(rows: DataFrame) -> DataFrame:
        """Fill in task, identity and timestamps of entry rows."""
        task = I.task_json(F.col("prompt"), F.lit(TASK_TYPE), F.lit(OUTPUT_CONTRACT), F.lit(CONSTRAINTS))
        scope = I.scope_json(
            F.lit("docs"), F.col("document_id"), F.col("scope_start"), F.col("scope_end"), F.lit("chunk"), F.col("content_hash")
        )
        return (
            rows.withColumns({"task": task, "scope": scope})
            .withColumns(
                {
                    "entry_id": I.entry_id(
                        F.col("task"), F.col("scope"), F.col("result"), F.col("result_type"),
                        F.col("reusable_as"), F.col("dependencies"),
                    ),
                    "task_signature": I.digest(F.col("task"), 16),
                    "task_type": F.lit(TASK_TYPE),
                    "output_contract": F.lit(OUTPUT_CONTRACT),
                    "constraints_json": F.lit(CONSTRAINTS),
                    "corpus_id": F.lit("docs"),
                    "unit": F.lit("chunk"),
                    "created_at": F.lit(AS_OF),
                }
            )
        )

    @cached_property
    def fragments(self) -> DataFrame:
        """Stored window results: plain windows, and some that straddle two of them."""
        return self.stored("fragments", self._fragments)

    @cached_property
    def bare_fragments(self) -> DataFrame:
        """The fragments without the texts of their evidence."""
        return self.stored("bare_fragments", lambda: self._cut(self.documents, lambda first: F.lit(None).cast("string")))

    def _fragments(self) -> DataFrame:
        """Each document is cut into the texts of its windows before rows multiply."""
        size = CHUNKS_PER_WINDOW * WORDS_PER_CHUNK
        return self._cut(self.texts, lambda first: T.join_slice(F.col("words"), first * WORDS_PER_CHUNK, size))

    def _cut(self, documents: DataFrame, text: Callable[[Column], Column]) -> DataFrame:
        """Fragments of documents; ``text`` gives the evidence text of a window from its first chunk."""
        step = F.lit(CHUNKS_PER_WINDOW).cast("bigint")

        def piece(i: Column, shift: int) -> Column:
            first = i * CHUNKS_PER_WINDOW + shift
            return F.struct(
                first.alias("scope_start"),
                F.least(first + CHUNKS_PER_WINDOW, F.col("n_chunks")).alias("scope_end"),
                text(first).alias("text"),
            )

        starts = F.sequence(F.lit(0).cast("bigint"), F.col("n_chunks") - 1, step)
        pieces = F.transform(
            starts,
            lambda s: F.struct(
                F.md5(F.concat_ws(":", "document_id", F.floor(s / CHUNKS_PER_WINDOW).cast("string"))).alias("window_key"),
                F.array(*[piece(F.floor(s / CHUNKS_PER_WINDOW), shift) for shift in (0, 2)]).alias("options"),
            ),
        )
        toxic = self.table("labels").filter("toxic = 1").select("doc_id", F.lit(S.REJECTED).alias("status"))
        key = F.col("window_key")
        cut = (
            documents.select("doc_id", "document_id", "doc_key", "content_hash", "n_words", F.inline(pieces))
            .select("*", F.posexplode("options").alias("option_no", "o"))
            .select("*", "o.*")
            .filter(F.when(F.col("option_no") == 0, key >= "50").otherwise(key >= "d0"))
            .filter("scope_start < scope_end")
            .drop("options", "o")
            .join(toxic, "doc_id", "left")
            .withColumn("verifier_status", F.coalesce("status", F.lit(S.NOT_REQUIRED)))
        )
        mode = _digit(key, 3)
        word_count = F.least(F.col("n_words"), F.col("scope_end") * WORDS_PER_CHUNK) - F.col("scope_start") * WORDS_PER_CHUNK
        found = F.concat(
            F.lit("chunks "), F.col("scope_start"), F.lit("-"), F.col("scope_end"),
            F.lit(" words "), F.col("word_count"),
        )
        evidence = F.array(
            F.struct(
                "document_id", F.col("scope_start").alias("start"), F.col("scope_end").alias("end"),
                F.lit("chunk").alias("unit"), "text",
            )
        )
        rows = (
            cut.withColumn("word_count", word_count)
            .withColumns(
                {
                    "prompt": _by_document(F.col("doc_key"), PROMPTS),
                    "reusable_as": F.when(mode < "2", F.array(F.lit(S.RULED_OUT)))
                    .when(mode < "3", F.array(F.lit(S.SEARCH_HINT)))
                    .when(mode < "5", F.array(F.lit(S.SUPPORTING_FACT), F.lit(S.AGGREGATION_COMPONENT)))
                    .otherwise(F.array(F.lit(S.AGGREGATION_COMPONENT))),
                    "result_type": F.when(mode < "2", S.NOT_FOUND).when(mode < "3", "hint").otherwise("answer"),
                    "result": F.when(mode < "2", F.lit(S.NOT_FOUND)).otherwise(found),
                    "evidence": evidence,
                    "dependencies": F.array().cast("array<string>"),
                    "confidence": F.instr(F.lit("0123456789abcdef"), _digit(key, 4)) / F.lit(16.0),
                    "metadata_json": F.concat(F.lit('{"words":'), "word_count", F.lit("}")),
                }
            )
        )
        return self._as_entries(rows).select(*S.column_names(S.MEMO_ENTRIES))

    @cached_property
    def fulls(self) -> DataFrame:
        """Exact answers for whole documents, built on all fragments of the document.

        Some documents have theirs stored under a reworded task.
        """
        return self.stored("fulls", self._fulls)

    def _fulls(self) -> DataFrame:
        from memograph.operators.folding import ordered_arrays

        ids = ordered_arrays(
            self.bare_fragments.select("document_id", "scope_start", "scope_end", "entry_id"),
            ["document_id"], ["scope_start", "scope_end", "entry_id"], {"dependencies": F.col("entry_id")},
        )
        choice = _digit(F.col("doc_key"), 3)
        rows = (
            self.documents.filter(choice < "7")
            .select("document_id", "doc_key", "n_chunks", "content_hash")
            .join(ids, "document_id", "left")
            .withColumns(
                {
                    "dependencies": F.coalesce("dependencies", F.array().cast("array<string>")),
                    "prompt": F.when(choice < "4", _by_document(F.col("doc_key"), PROMPTS)).otherwise(
                        _by_document(F.col("doc_key"), REWORDED)
                    ),
                    "scope_start": F.lit(0).cast("bigint"),
                    "scope_end": F.col("n_chunks"),
                    "result": F.concat(F.lit("document "), "document_id", F.lit(" has "), "n_chunks", F.lit(" chunks")),
                    "result_type": F.lit("answer"),
                    "reusable_as": F.array(F.lit(S.EXACT_ANSWER)),
                    "evidence": F.array().cast(S.EVIDENCE),
                    "confidence": F.lit(1.0),
                    "verifier_status": F.lit(S.NOT_REQUIRED),
                    "metadata_json": F.lit("{}"),
                }
            )
        )
        return self._as_entries(rows).select(*S.column_names(S.MEMO_ENTRIES))

    @cached_property
    def memo(self) -> DataFrame:
        return self.fragments.unionByName(self.fulls)

    @cached_property
    def outline(self) -> DataFrame:
        """The memo with the places of its evidence, but not its texts; every other column is the same."""
        return self.bare_fragments.unionByName(self.fulls)

    @cached_property
    def summaries(self) -> DataFrame:
        """One node per source, standing for a summary over its documents."""
        name = F.concat(F.lit("source:"), "source")
        return (
            self.documents.groupBy("source").agg(F.count("*").alias("scope_end"))
            .select(
                I.digest(F.concat(F.lit("summary:"), "source"), 24).alias("entry_id"),
                "source", name.alias("document_id"), F.lit(0).cast("bigint").alias("scope_start"), "scope_end",
            )
        )

    @cached_property
    def edges(self) -> DataFrame:
        """Documents depend on their fragments, source summaries on their documents."""
        from memograph.operators.graph import depends_on

        of_source = self.documents.select("document_id", "source")
        upper = self.fulls.select("document_id", F.col("entry_id").alias("child_entry_id")).join(of_source, "document_id").select(
            I.digest(F.concat(F.lit("summary:"), "source"), 24).alias("parent_entry_id"),
            "child_entry_id", F.lit("depends_on").alias("edge_type"),
            F.lit(AS_OF).alias("created_at"), F.lit("{}").alias("metadata_json"),
        )
        return depends_on(self.fulls).unionByName(upper)

    @cached_property
    def nodes(self) -> DataFrame:
        return self.outline.select("entry_id", "document_id", "scope_start", "scope_end", "verifier_status").unionByName(
            self.summaries.select(
                "entry_id", "document_id", "scope_start", "scope_end", F.lit(S.NOT_REQUIRED).alias("verifier_status")
            )
        )

    @cached_property
    def requests(self) -> DataFrame:
        """Two requests per document: all of it, and its middle half."""
        whole = F.struct(F.lit(0).cast("bigint").alias("part"), F.lit(0).cast("bigint").alias("start"), F.col("n_chunks").alias("end"))
        middle = F.struct(
            F.lit(1).cast("bigint").alias("part"),
            F.floor(F.col("n_chunks") / 4).alias("start"),
            F.floor(F.col("n_chunks") * 3 / 4).alias("end"),
        )
        version = _digit(F.col("doc_key"), 5)
        # Of the fixed prompts, so that they are worked out once and not per request.
        signatures = [I.task_signature(F.lit(p), F.lit(TASK_TYPE), F.lit(OUTPUT_CONTRACT), F.lit(CONSTRAINTS)) for p in PROMPTS]
        return self.documents.select("*", F.inline(F.array(whole, middle))).select(
            (F.col("doc_id") * 2 + F.col("part")).alias("request_id"),
            _by_document(F.col("doc_key"), PROMPTS).alias("prompt"),
            F.lit(TASK_TYPE).alias("task_type"),
            F.lit(OUTPUT_CONTRACT).alias("output_contract"),
            F.lit(CONSTRAINTS).alias("constraints_json"),
            _by_document(F.col("doc_key"), signatures).alias("task_signature"),
            F.lit("docs").alias("corpus_id"), "document_id", "start", "end", F.lit("chunk").alias("unit"),
            F.when(version < "5", "").when(version < "d", "v1").otherwise("v2").alias("content_hash"),
        )

    @cached_property
    def changed(self) -> DataFrame:
        """Windows whose text has changed since they were solved; any version of it is stale."""
        return self.windows.filter(F.col("window_key") < "18").select(
            F.xxhash64("document_id", "w").alias("request_id"),
            F.lit("docs").alias("corpus_id"), "document_id", "start", "end",
            F.lit("chunk").alias("unit"), F.lit("").alias("content_hash"),
        )

    @cached_property
    def calls(self) -> DataFrame:
        """Events read as a ledger of model calls."""
        kind = F.col("event_type")
        return self.table("events").select(
            "event_id", "ts", "user_id",
            F.when(kind.isin("purchase", "signup"), "sonnet-large")
            .when(kind.isin("view", "click"), "haiku-small")
            .otherwise("local-base").alias("model"),
            F.floor(F.col("value") * 10).alias("input_tokens"),
            F.get_json_object("props", "$.k").cast("bigint").alias("output_tokens"),
            kind.isin("view", "click").alias("from_cache"),
            F.col("value").alias("latency_ms"),
            kind.alias("event_type"),
        )

    @cached_property
    def predictions(self) -> DataFrame:
        """Assistant turns as predictions for the user turn before them."""
        turns = self.table("conversations")
        asked = turns.filter("role = 'user'").select(
            "conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question")
        )
        long_words = F.filter(T.words("question"), lambda w: F.length(w) >= 6)
        return (
            turns.filter("role = 'assistant'")
            .join(asked, ["conv_id", "turn"])
            .select(
                (F.col("conv_id") * 1000 + F.col("turn")).alias("sample_id"),
                F.when(F.length("question") < 120, "qa_short").otherwise("qa_long").alias("task"),
                F.when(F.length("text") < 200, "1000").when(F.length("text") < 400, "2000").otherwise("4000").alias("length"),
                "question",
                F.col("text").alias("prediction"),
                F.array_distinct(long_words).alias("gold"),
            )
        )

    @cached_property
    def answers(self) -> DataFrame:
        """Statements about orders with figures, and a source text that backs some of them."""
        total = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
        share = (F.col("o_custkey") / 10).cast("decimal(10,1)").cast("string")
        volume = F.concat(
            F.floor(F.col("o_totalprice") / 1000).cast("string"), F.lit(","),
            F.lpad(F.floor(F.col("o_custkey") % 1000).cast("string"), 3, "0"),
        )

        def statement(money: Column, percent: Column) -> Column:
            return F.concat(
                F.lit("Order "), F.col("o_orderkey"), F.lit(" totals $"), money, F.lit(", up "), percent,
                F.lit("%, volume "), volume, F.lit(" and 48.7M."),
            )

        priority = _digit(F.col("o_orderpriority"), 1)
        changed_money = F.when(priority.isin("1", "2"), F.lit("0.5")).otherwise(total)
        changed_share = F.when(priority.isin("2", "3"), F.lit("x")).otherwise(share)
        plain = F.concat(F.lit("Order "), F.col("o_orderkey"), F.lit(" has no figures"))
        return self.spread("orders", "o_orderkey").select(
            "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority",
            F.when(priority == "5", plain).otherwise(statement(total, share)).alias("answer"),
            F.when(priority == "2", F.lit("nothing on record"))
            .otherwise(statement(changed_money, changed_share)).alias("source_text"),
        )

    @cached_property
    def cache(self) -> DataFrame:
        """Settled orders as cached question and answer pairs, bucketed by their ledger text."""
        ledger = F.concat(F.lit("  Ledger of customer "), F.col("o_custkey"), F.lit("\n"))
        return self.answers.filter("o_orderstatus <> 'P'").select(
            F.col("o_orderkey").alias("cache_id"),
            F.concat(F.lit("What is the total of order "), F.col("o_orderkey"), F.lit("?")).alias("query"),
            F.col("answer").alias("result"),
            F.col("source_text").alias("source_context"),
            I.chunk_hash(ledger).alias("chunk_hash"),
            F.when(F.col("o_orderstatus") == "F", "scope-a").otherwise("").alias("data_scope_hash"),
        )

    @cached_property
    def lookups(self) -> DataFrame:
        """One question per order: repeated with other case, reworded, or about something else."""
        number = F.col("o_orderkey").cast("string")
        priority = _digit(F.col("o_orderpriority"), 1)
        ledger = F.concat(F.lit("Ledger of customer "), F.col("o_custkey"))
        asked = (
            F.when(priority == "2", F.concat(F.lit("order "), number, F.lit(" total")))
            .when(priority == "3", F.concat(F.lit("delivery date of order "), number))
            .otherwise(F.concat(F.lit("  what is the TOTAL of order "), number, F.lit("? ")))
        )
        return self.spread("orders", "o_orderkey").select(
            F.col("o_orderkey").alias("lookup_id"), asked.alias("query"), I.chunk_hash(ledger).alias("chunk_hash")
        )

    @cached_property
    def vectors(self) -> DataFrame:
        return self.table("embeddings")

    @cached_property
    def haystacks(self) -> DataFrame:
        return self.spread("documents", "doc_id").filter(T.strip("text") != "").select(
            "doc_id", F.concat(F.lit("doc_"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("haystack"),
            "text", F.sha2("text", 256).alias("haystack_hash"), F.length("text").cast("bigint").alias("total_chars"),
        )

    @cached_property
    def experiments(self) -> DataFrame:
        """Passages read as needle definitions: one needle, two questions, two tests."""
        number = F.col("item_id").cast("string")

        def test(name: Column) -> Column:
            return F.struct(F.array(name, number).alias("input_args"), F.array(name).alias("gold_answers"))

        return self.table("benchmark").select(
            F.lpad(number, 4, "0").alias("id"),
            F.lit("").alias("system_prompt"),
            F.lit(None).cast("string").alias("task_template"),
            F.concat("text", F.lit(" The keeper of passage {2} is {1}.")).alias("needle"),
            F.array().cast("array<string>").alias("character_set"),
            F.map_from_arrays(
                F.array(F.lit("direct"), F.lit("reverse")),
                F.array(F.lit("Who keeps passage {2}?"), F.lit("Which passage does {1} keep?")),
            ).alias("questions"),
            F.map_from_arrays(F.array(F.lit("direct")), F.array(F.lit("Nobody keeps passage {2} any more."))).alias("distractors"),
            F.map_from_arrays(
                F.array(F.lit("01"), F.lit("02")),
                F.array(test(F.concat(F.lit("Ada"), number)), test(F.concat(F.lit("Bo"), number))),
            ).alias("tests"),
        )
