import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import functions as F  # noqa: E402

from memograph import schema as S  # noqa: E402
from memograph.functions import identity as I  # noqa: E402
from memograph.plans.solve import as_entries  # noqa: E402
from memograph.session import build_session  # noqa: E402

PROMPT = "Find the Q1 ARR"
TASK_TYPE = "financial_metric_lookup"
CONTRACT = "short factual answer"


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", 4, **{"spark.ui.enabled": "false", "spark.driver.memory": "6g", "spark.sql.codegen.wholeStage": "false"})
    session.sparkContext.setLogLevel("ERROR")
    return session


class Fixture:
    """Small entries and requests in the shape of the stored tables."""

    def __init__(self, spark):
        self.spark = spark

    def entries(self, *rows):
        """Rows of (start, end, mode) plus options as a dict."""
        made = []
        for start, end, mode, *rest in rows:
            o = rest[0] if rest else {}
            modes = [mode] if isinstance(mode, str) else list(mode)
            made.append(
                (
                    o.get("prompt", PROMPT), TASK_TYPE, CONTRACT, "{}", "finance", o.get("document", "doc-a"), start, end,
                    "chunk", o.get("hash", "v1"), o.get("result", f"r{start}-{end}"), mode == S.RULED_OUT,
                    o.get("confidence", 1.0), modes, o.get("evidence", []), o.get("dependencies", []), "{}",
                    o.get("status", S.NOT_REQUIRED),
                )
            )
        df = self.spark.createDataFrame(
            made,
            "prompt STRING, task_type STRING, output_contract STRING, constraints_json STRING, corpus_id STRING, "
            "document_id STRING, start BIGINT, end BIGINT, unit STRING, content_hash STRING, result STRING, not_found BOOLEAN, "
            f"confidence DOUBLE, reusable_as ARRAY<STRING>, evidence {S.EVIDENCE}, dependencies ARRAY<STRING>, "
            "metadata_json STRING, status STRING",
        )
        signed = self._signed(df)
        stored = as_entries(signed, "2024-01-01T00:00:00Z")
        status = signed.select("start", "end", "prompt", "reusable_as", "status")
        return stored.join(
            status.withColumnsRenamed({"start": "scope_start", "end": "scope_end"}).drop("reusable_as"),
            ["scope_start", "scope_end", "prompt"],
        ).withColumn("verifier_status", F.col("status")).select(*S.column_names(S.MEMO_ENTRIES))

    def requests(self, *rows):
        """Rows of (id, start, end) plus options as a dict."""
        made = [
            (i, o.get("prompt", PROMPT), TASK_TYPE, CONTRACT, o.get("constraints", "{}"), "finance", o.get("document", "doc-a"), s, e, "chunk", o.get("hash", "v1"))
            for i, s, e, *rest in rows
            for o in [rest[0] if rest else {}]
        ]
        df = self.spark.createDataFrame(
            made,
            "request_id BIGINT, prompt STRING, task_type STRING, output_contract STRING, constraints_json STRING, corpus_id STRING, "
            "document_id STRING, start BIGINT, end BIGINT, unit STRING, content_hash STRING",
        )
        return self._signed(df)

    @staticmethod
    def _signed(df):
        task = [F.col(c) for c in ("prompt", "task_type", "output_contract", "constraints_json")]
        return df.withColumn("task_signature", I.task_signature(*task))


@pytest.fixture(scope="session")
def memo(spark):
    return Fixture(spark)
