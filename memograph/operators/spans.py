"""Half-open interval algebra over many keys at once.

The core is a sweep: every interval becomes a +1 step at its start and a -1 step
at its end. Steps are summed per position before they are shuffled by key, so any
number of copies of an interval collapses early. The running depth is built in
two levels - inside fixed blocks of positions, then over one slim row per block -
so that a key owning a large part of all rows is still spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

POSITIONS_PER_BLOCK = 4096


def clip(start: Column, end: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """Bounds of the intersection of two intervals known to overlap."""
    return F.greatest(start, low), F.least(end, high)


def _steps(spans: DataFrame, keys: list[str], frame: DataFrame | None) -> DataFrame:
    """One row per key and position: net depth change, and whether it is a frame edge."""

    def ends(df: DataFrame, up: int, edge: int) -> DataFrame:
        points = F.array(
            F.struct(F.col("start").alias("pos"), F.lit(up).alias("step")),
            F.struct(F.col("end").alias("pos"), F.lit(-up).alias("step")),
        )
        return df.filter("end > start").select(*keys, F.inline(points)).withColumn("edge", F.lit(edge))

    points = ends(spans, 1, 0)
    if frame is not None:
        points = points.unionByName(ends(frame, 0, 1))
    return points.groupBy(*keys, "pos").agg(F.sum("step").alias("step"), F.max("edge").alias("edge"))


def coverage_runs(
    spans: DataFrame,
    keys: list[str],
    frame: DataFrame | None = None,
    block: int = POSITIONS_PER_BLOCK,
) -> DataFrame:
    """Maximal runs ``keys, start, end, covered`` of the union of ``spans`` per key.

    Touching intervals coalesce and empty ones vanish. With ``frame`` (one interval
    per key, containing its spans) the runs tile the frame exactly, gaps included.
    """
    # The same null filter on both uses of the blocked steps lets them share one shuffle.
    blocked = (
        _steps(spans, keys, frame)
        .withColumn("blk", F.expr(f"pos div {block}"))
        .filter(" AND ".join(f"{name} IS NOT NULL" for name in [*keys, "blk"]))
    )
    within = W.partitionBy(*keys, "blk").orderBy("pos")
    local = blocked.withColumn("local", F.sum("step").over(within))

    # First place in a block where the covered state can flip, given the depth on entry:
    # entering at depth 0 it is the first rise, entering exactly at minus the local minimum
    # it is the first position reaching that minimum, otherwise there is none.
    summary = local.groupBy(*keys, "blk").agg(
        F.sum("step").alias("total"),
        F.min("local").alias("low"),
        F.min(F.struct("local", "pos"))["pos"].alias("low_at"),
        F.min(F.when(F.col("step") > 0, F.col("pos"))).alias("rise_at"),
        F.min(F.when(F.col("edge") == 1, F.col("pos"))).alias("edge_at"),
    )
    earlier = W.partitionBy(*keys).orderBy("blk").rowsBetween(W.unboundedPreceding, -1)
    later = W.partitionBy(*keys).orderBy(F.desc("blk")).rowsBetween(W.unboundedPreceding, -1)
    flip = F.when((F.col("low") < 0) & (F.col("entry") == -F.col("low")), F.col("low_at")).when(
        F.col("entry") == 0, F.col("rise_at")
    )
    carried = (
        summary.withColumn("entry", F.coalesce(F.sum("total").over(earlier), F.lit(0)))
        .withColumn("first_flip", F.least(flip, F.col("edge_at")))
        .select(*keys, "blk", "entry", F.last("first_flip", ignorenulls=True).over(later).alias("next_flip"))
    )

    depth = F.col("entry") + F.col("local")
    now, before = depth > 0, (depth - F.col("step")) > 0
    flips = (
        local.join(carried, [*keys, "blk"])
        .filter((now != before) | (F.col("edge") == 1))
        .select(*keys, "blk", "pos", "next_flip", now.alias("covered"))
    )
    return flips.select(
        *keys,
        F.col("pos").alias("start"),
        F.coalesce(F.lead("pos").over(within), "next_flip").alias("end"),
        "covered",
    ).filter("end IS NOT NULL")


def merge(spans: DataFrame, keys: list[str], block: int = POSITIONS_PER_BLOCK) -> DataFrame:
    """Disjoint union of the spans of every key."""
    return coverage_runs(spans, keys, block=block).filter("covered").drop("covered")


def gaps(spans: DataFrame, keys: list[str], frame: DataFrame, block: int = POSITIONS_PER_BLOCK) -> DataFrame:
    """What ``spans``, already clipped to ``frame``, leave uncovered inside it."""
    return coverage_runs(spans, keys, frame, block).filter("NOT covered").drop("covered")


def tumbling(start: Column, end: Column, size: int) -> Column:
    """array<struct<start, end>> of consecutive windows over [start, end), the last one shorter."""
    if size <= 0:
        raise ValueError("window size must be positive")
    starts = F.sequence(start, end - 1, F.lit(size).cast("bigint"))
    cut = F.transform(
        starts, lambda s: F.struct(s.alias("start"), F.least(s + size, end).alias("end"))
    )
    return F.when(end > start, cut)
