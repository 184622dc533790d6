"""Dependency graph: neighbours, lineage and transitive invalidation.

Edges point from a parent to the child it depends on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memograph import schema as S
from memograph.functions.identity import json_object, json_string
from memograph.operators.folding import with_row_index
from memograph.operators.matching import candidates
from memograph.session import ensure_checkpointing


def depends_on(entries: DataFrame) -> DataFrame:
    """Edges implied by the dependency lists of entries."""
    return entries.select(
        F.col("entry_id").alias("parent_entry_id"),
        F.explode("dependencies").alias("child_entry_id"),
        F.lit("depends_on").alias("edge_type"),
        "created_at",
        F.lit("{}").alias("metadata_json"),
    )


def parents(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """For every child, the known entries built on it."""
    named = entries.withColumnRenamed("entry_id", "parent_entry_id")
    return edges.select("child_entry_id", "parent_entry_id").join(named, "parent_entry_id")


def children(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """For every parent, the known entries it was built from; unknown ones are dropped."""
    named = entries.withColumnRenamed("entry_id", "child_entry_id")
    return edges.select("parent_entry_id", "child_entry_id").join(named, "child_entry_id")


def closure(
    seeds: DataFrame, edges: DataFrame, keys: list[str], source: str, target: str, max_depth: int | None = None
) -> DataFrame:
    """Everything reachable from the seeds with its smallest depth; safe on cycles.

    ``seeds`` has ``keys``, the last of which is the node; edges are followed from ``source``
    to ``target``. Each round joins only the newest rows and is checkpointed, which cuts the
    lineage and lets a lost executor restart from files.
    """
    ensure_checkpointing(seeds.sparkSession)
    node = keys[-1]
    steps = edges.select(F.col(source).alias(node), F.col(target).alias("next")).distinct()
    frontier = seeds.select(*keys).distinct().withColumn("depth", F.lit(0)).checkpoint()
    reached, depth = frontier, 0
    while not frontier.isEmpty() and (max_depth is None or depth < max_depth):
        depth += 1
        frontier = (
            frontier.join(steps, node)
            .select(*keys[:-1], F.col("next").alias(node))
            .distinct()
            .join(reached.select(*keys), keys, "left_anti")
            .withColumn("depth", F.lit(depth))
            .checkpoint()
        )
        reached = reached.unionByName(frontier)
    return reached


def lineage(roots: DataFrame, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``root_id, entry_id, depth`` of all direct and indirect dependencies.

    With ``max_depth`` deeper ones are left out, and ``truncated`` says for each root whether there are any.
    """
    keys = ["root_id", "entry_id"]
    seeds = roots.select(F.col("entry_id").alias("root_id"), "entry_id")
    reached = closure(seeds, edges, keys, "parent_entry_id", "child_entry_id", max_depth)
    if max_depth is None:
        return reached
    steps = edges.select(F.col("parent_entry_id").alias("entry_id"), F.col("child_entry_id").alias("next"))
    beyond = reached.filter(F.col("depth") == max_depth).join(steps, "entry_id").select("root_id", F.col("next").alias("entry_id"))
    cut = beyond.join(reached.select(*keys), keys, "left_anti").select("root_id").distinct().withColumn("cut", F.lit(True))
    return reached.join(cut, "root_id", "left").select("root_id", "entry_id", "depth", F.coalesce("cut", F.lit(False)).alias("truncated"))


PATH = "ARRAY<STRUCT<created_at: STRING, entry_id: STRING>>"


def lineage_tree(roots: DataFrame, edges: DataFrame, entries: DataFrame, max_depth: int = 10) -> DataFrame:
    """``root_id, position, depth, entry_id, expanded``: the tree a walk from each root meets, in pre-order.

    The walk takes children by creation time and id and goes down before it goes on. An entry met again, and one at
    ``max_depth``, is listed but not ``expanded``. Unknown children are left out, an edge of several types counts once.

    Where an entry is expanded is a smallest solution, so there is no walk: among all expanded parents, its path is the
    smallest path of a parent with one step more. Each round takes that minimum from all paths of the round before, until
    nothing changes; there is one path per root and entry, however many ways lead to it, and cycles only add longer paths.
    """
    ensure_checkpointing(roots.sparkSession)
    known = entries.select(F.col("entry_id").alias("child")).distinct()
    step = F.struct(F.coalesce(F.min("created_at"), F.lit("")).alias("created_at"), F.col("child").alias("entry_id"))
    steps = edges.select(F.col("parent_entry_id").alias("entry_id"), F.col("child_entry_id").alias("child"), "created_at").groupBy(
        "entry_id", "child"
    ).agg(step.alias("step")).join(known, "child", "left_semi").select("entry_id", "step").checkpoint()
    start = roots.select(F.col("entry_id").alias("root_id"), "entry_id", F.array().cast(PATH).alias("path")).distinct().filter(F.lit(max_depth > 0))

    def onward(paths: DataFrame) -> DataFrame:
        """The children of expanded entries, where they are met."""
        return paths.join(steps, "entry_id").select("root_id", F.col("step.entry_id").alias("entry_id"), F.concat("path", F.array("step")).alias("path"))

    paths, before = start.checkpoint(), None
    while True:
        seal = F.sum(F.xxhash64("root_id", "entry_id", "path").cast("decimal(20,0)"))
        state = tuple(paths.agg(F.count("*"), seal).first())
        if state == before:
            break
        before = state
        met = onward(paths).filter(F.size("path") < max_depth)
        paths = start.unionByName(met).groupBy("root_id", "entry_id").agg(F.min("path").alias("path")).checkpoint()

    top = roots.select(F.col("entry_id").alias("root_id"), "entry_id", F.array().cast(PATH).alias("path")).distinct()
    listed = top.unionByName(onward(paths))
    open_at = paths.select("root_id", "entry_id", F.col("path").alias("open_path"))
    marked = listed.join(open_at, ["root_id", "entry_id"], "left").withColumn("expanded", F.coalesce(F.col("path") == F.col("open_path"), F.lit(False)))
    # Positions count over all rows sorted by root and path, so a root of many rows is no task of its own.
    placed = with_row_index(marked.drop("open_path"), ["root_id", "path"], "n")
    first = placed.groupBy("root_id").agg(F.min("n").alias("first"))
    return placed.join(first, "root_id").select("root_id", (F.col("n") - F.col("first")).alias("position"), F.size("path").alias("depth"), "entry_id", "expanded")


def invalidated(
    changed: DataFrame, entries: DataFrame, edges: DataFrame, same_task: bool = False, propagate: bool = True
) -> DataFrame:
    """``entry_id, depth`` of live entries touched by changed scopes, and of all built on them."""
    seeds = candidates(changed, entries, same_task=same_task).select("entry_id")
    if not propagate:
        return seeds.distinct().withColumn("depth", F.lit(0))
    live = entries.filter(F.col("verifier_status") != S.REJECTED).select("entry_id")
    usable = edges.join(live.withColumnRenamed("entry_id", "parent_entry_id"), "parent_entry_id", "left_semi")
    return closure(seeds, usable, ["entry_id"], "child_entry_id", "parent_entry_id")


def reject(entries: DataFrame, rejected: DataFrame, reason: str, as_of: str) -> DataFrame:
    """Entries with the listed ones marked as rejected; rows are kept for audit."""
    hit = F.col("hit").isNotNull()
    marked = rejected.select("entry_id").distinct().withColumn("hit", F.lit(True))
    note = json_object(rejected_at=json_string(F.lit(as_of)), rejection_reason=json_string(F.lit(reason)))
    body = F.substring("metadata_json", 2, F.length("metadata_json") - 2)
    noted = F.when(body == "", note).otherwise(
        F.concat(F.lit("{"), body, F.lit(","), F.substring(note, 2, F.length(note) - 1))
    )
    return (
        entries.join(marked, "entry_id", "left")
        .withColumn("verifier_status", F.when(hit, F.lit(S.REJECTED)).otherwise(F.col("verifier_status")))
        .withColumn("metadata_json", F.when(hit, noted).otherwise(F.col("metadata_json")))
        .drop("hit")
    )
