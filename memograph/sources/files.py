"""Text, JSON and JSONL readers, and the JSON sinks of a run."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memograph.functions.text import strip

# Keys under which a JSON file may hold its list of records.
CONTAINER_KEYS = ["samples", "examples", "data", "items", "instances"]
REPLACEMENT = chr(0xFFFD)


def _decoded(value: str) -> Column:
    """Text without its undecodable bytes."""
    repaired = F.replace(F.make_valid_utf8(value), F.lit(REPLACEMENT), F.lit(""))
    return F.when(F.is_valid_utf8(value), F.col(value)).otherwise(repaired)


def read_text_dir(spark: SparkSession, path: str) -> DataFrame:
    """``filename, text, content_hash`` of the non-empty ``*.txt`` files directly in a folder.

    Undecodable bytes are dropped. The hash covers the text before stripping.
    """
    raw = (
        spark.read.option("pathGlobFilter", "*.txt")
        .text(path, wholetext=True)
        .select(F.col("_metadata.file_name").alias("filename"), _decoded("value").alias("raw"))
    )
    return raw.select(
        "filename", strip("raw").alias("text"), F.sha2("raw", 256).alias("content_hash"),
        F.length("raw").cast("bigint").alias("total_chars"),
    ).filter("text <> ''")


def read_binary_hashes(spark: SparkSession, path: str) -> DataFrame:
    """``path, sha256`` of the bytes of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a declared schema; blank lines are skipped."""
    lines = spark.read.text(path).filter(strip("value") != "")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("row")).select("row.*")


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of every JSON and JSONL file below a path, tagged with ``source_file``.

    A JSON file is a list of records, an object holding such a list under one of the known
    keys, or a single record. The first such key counts, also with an empty list. Malformed lines and files are errors.
    """
    files = spark.read.option("recursiveFileLookup", "true")
    origin = F.col("_metadata.file_path").alias("source_file")

    lines = (
        files.option("pathGlobFilter", "*.jsonl").text(path).select(origin, "value").filter(strip("value") != "")
    )
    from_lines = lines.select("source_file", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("row"))

    whole = files.option("pathGlobFilter", "*.json").text(path, wholetext=True).select(origin, strip("value").alias("value"))
    holder = ", ".join(f"{key}: ARRAY<STRUCT<{schema}>>" for key in CONTAINER_KEYS)
    held = F.from_json("value", f"STRUCT<{holder}>")
    as_list = F.from_json("value", f"ARRAY<STRUCT<{schema}>>")
    single = F.array(F.from_json("value", f"STRUCT<{schema}>"))
    broken = F.raise_error(F.concat(F.lit("not JSON: "), "source_file")).cast(f"ARRAY<STRUCT<{schema}>>")
    listed = F.coalesce(*[held[key] for key in CONTAINER_KEYS], single)
    rows = F.when(F.try_parse_json("value").isNull(), broken).when(F.startswith(F.col("value"), F.lit("[")), as_list).otherwise(listed)
    from_whole = whole.select("source_file", F.explode(rows).alias("row"))

    return from_lines.unionByName(from_whole).select("source_file", "row.*")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_manifest(df: DataFrame, spark: SparkSession, path: str) -> None:
    """One nested JSON object, from a DataFrame that holds a single summary row."""
    rows = df.select(F.to_json(F.struct("*")).alias("body")).limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a manifest is made from exactly one row")
    body = json.dumps(json.loads(rows[0]["body"]), ensure_ascii=False, sort_keys=True)
    spark.createDataFrame([(body,)], "value STRING").coalesce(1).write.mode("overwrite").text(path)


def resolve_manifests(spark: SparkSession, path: str) -> DataFrame:
    """The manifest a path stands for: the file itself, the folder's own ``manifest.json``, or the last one below it.

    Returns ``manifest, body``; a folder without any gives no row.
    """
    files = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*" if path.endswith(".json") else "manifest.json")
        .text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias("manifest"), F.col("value").alias("body"))
    )
    depth = F.size(F.split("manifest", "/"))
    best = F.max_by(F.struct("manifest", "body"), F.struct((-depth).alias("up"), F.col("manifest").alias("name")))
    named = files.filter(F.endswith(F.col("manifest"), F.lit(".json")))
    return named.agg(best.alias("m")).filter("m IS NOT NULL").select("m.*")
