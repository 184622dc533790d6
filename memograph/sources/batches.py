"""Several tables that change together.

A batch writes its rows of every table under one commit and publishes the commit last. Readers see published commits
only, so a batch that breaks between two tables leaves nothing behind that could be read, and can be tried again.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PUBLISHED = "seq BIGINT, batch STRING, commit STRING"


class Batches:
    """Tables in one folder; ``schemas`` says which there are. One process writes a folder at a time.

    A second writer is not kept out but noticed: two commits of one number, or of one batch, are an error for every reader.
    """

    def __init__(self, spark: SparkSession, path: str, schemas: dict[str, str]) -> None:
        self.spark, self.path, self.schemas = spark, path.rstrip("/"), schemas

    def published(self) -> list:
        """The commits in order: one row per batch that was ever written."""
        try:
            rows = self.spark.read.schema(PUBLISHED).parquet(f"{self.path}/published").orderBy("seq", "commit").collect()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        if len({r["seq"] for r in rows}) < len(rows) or len({r["batch"] for r in rows}) < len(rows):
            raise RuntimeError(f"{self.path} was written by two processes at a time")
        return rows

    def has(self, batch: str) -> bool:
        return any(r["batch"] == batch for r in self.published())

    def begin(self) -> str:
        return uuid.uuid4().hex

    def write(self, commit: str, table: str, rows: DataFrame, by: Sequence[str] = ()) -> None:
        """The rows of one table in a commit that is not yet published."""
        names = StructType.fromDDL(self.schemas[table]).fieldNames()
        rows.select(*names).write.partitionBy(*by).parquet(self.where(table, commit))

    def where(self, table: str, commit: str) -> str:
        return f"{self.path}/{table}/commit={commit}"

    def written(self, commit: str, table: str) -> DataFrame:
        return self.spark.read.schema(self.schemas[table]).parquet(self.where(table, commit))

    def publish(self, commit: str, batch: str) -> None:
        """Make a commit visible; it is one small file that is written last."""
        seq = 1 + max((r["seq"] for r in self.published()), default=-1)
        self.spark.createDataFrame([(seq, batch, commit)], PUBLISHED).coalesce(1).write.mode("append").parquet(f"{self.path}/published")

    def read(self, table: str) -> DataFrame:
        """All published rows of a table with their ``commit`` and its ``seq``."""
        rows = self.published()
        schema = f"{self.schemas[table]}, commit STRING"
        if not rows:
            return self.spark.createDataFrame([], f"{schema}, seq BIGINT")
        # Folders without rows of a table are no error: every commit writes each table it knows, even if empty.
        paths = [self.where(table, r["commit"]) for r in rows]
        found = self.spark.read.schema(schema).option("basePath", f"{self.path}/{table}").parquet(*paths)
        numbers = F.create_map(*[F.lit(x) for r in rows for x in (r["commit"], r["seq"])])
        return found.withColumn("seq", numbers[F.col("commit")])
