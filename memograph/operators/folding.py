"""Aggregations whose result depends on order or on all rows of a key.

They run in levels so that no task ever sees more than a bounded slice of a key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memograph.session import spread

SEGMENT = 256


def ordered_arrays(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: dict[str, Column],
    segment: int = SEGMENT,
) -> DataFrame:
    """Per key, arrays of ``values`` in ``order``; nulls are left out.

    The first order column is a position: rows are first gathered per stretch of
    ``segment`` positions and only the stretches are gathered per key.
    """
    item = F.struct(*order, *[v.alias(name) for name, v in values.items()])
    stretches = df.groupBy(*keys, F.floor(F.col(order[0]) / segment).alias("part")).agg(
        F.array_sort(F.collect_list(item)).alias("items")
    )
    joined = stretches.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("part", "items"))).alias("parts")
    )
    flat = F.flatten(F.transform("parts", lambda p: p["items"]))

    def picked(name: str) -> Column:
        return F.array_compact(F.transform(flat, lambda item: item[name]))

    return joined.select(*keys, *[picked(name).alias(name) for name in values])


def ordered_text(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str, separator: str = "\n"
) -> DataFrame:
    """Per key, the non-null values joined in order."""
    return ordered_arrays(df, keys, order, {name: value}).withColumn(name, F.array_join(name, separator))


def fold_in_pandas(
    df: DataFrame,
    key: str,
    position: str,
    partial: Callable[[pd.DataFrame], pd.DataFrame],
    schema: str,
    fan_in: int = SEGMENT,
    ties: Sequence[str] = (),
) -> DataFrame:
    """Order-aware aggregation by a Python callback.

    ``partial`` reduces rows sorted by ``position``, then by ``ties``, to one row with the same columns, so it
    can be applied to its own results. It runs over stretches of ``fan_in`` positions, then
    over stretches of those, until one row per key is left. Stretches are dealt over all cores and come sorted, many to a
    batch, as most are far too small to be sent to Python one by one.
    """

    def reduce_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for stretches in whole_stretches(batches, [key, "level"]):
            made = [partial(rows) for rows in stretches]
            if made:
                yield pd.concat(made, ignore_index=True)

    last = df.agg(F.max(position)).first()[0] or 0
    width = fan_in
    while True:
        dealt = spread(df.withColumn("level", F.floor(F.col(position) / width)), key, "level")
        df = dealt.sortWithinPartitions(key, "level", position, *ties).mapInPandas(reduce_rows, schema)
        if width > last:
            return df
        width *= fan_in


def whole_stretches(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[list[pd.DataFrame]]:
    """Per batch of sorted rows, the stretches of equal keys that end in it, without the last key column."""
    kept = None
    for batch in batches:
        rows = batch if kept is None else pd.concat([kept, batch], ignore_index=True)
        if not len(rows):
            continue
        changed = np.zeros(len(rows) - 1, dtype=bool)
        for name in keys:
            values = rows[name].to_numpy()
            changed |= (values[1:] != values[:-1]) & ~(pd.isna(values[1:]) & pd.isna(values[:-1]))
        starts = [0, *(np.flatnonzero(changed) + 1).tolist()]
        kept, rows = rows.iloc[starts[-1]:], rows.drop(columns=keys[-1])
        yield [rows.iloc[a:b].reset_index(drop=True) for a, b in zip(starts, starts[1:])]
    if kept is not None:
        yield [kept.drop(columns=keys[-1]).reset_index(drop=True)]


def with_offsets(df: DataFrame, order: Sequence[str], count: str, name: str) -> DataFrame:
    """Add the sum of ``count`` over all rows that come earlier in a total order.

    Rows are sorted into ranges; a running sum inside each range is shifted by the totals
    of the ranges before it, of which there is one row per partition.
    """
    from memograph.session import ensure_checkpointing

    spark = df.sparkSession
    ensure_checkpointing(spark)
    # Choosing the ranges reads the rows a second time, so whatever made them runs only once.
    ranged = (
        df.checkpoint().repartitionByRange(*order).withColumn("range_no", F.spark_partition_id()).checkpoint()
    )
    before = W.orderBy("range_no").rowsBetween(W.unboundedPreceding, -1)
    shifts = ranged.groupBy("range_no").agg(F.sum(count).alias("total")).select(
        "range_no", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("shift")
    )
    inside = W.partitionBy("range_no").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    running = F.coalesce(F.sum(count).over(inside), F.lit(0))
    return (
        ranged.withColumn(name, running)
        .join(F.broadcast(shifts), "range_no")
        .withColumn(name, (F.col(name) + F.col("shift")).cast("bigint"))
        .drop("range_no", "shift")
    )


def with_row_index(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Dense zero-based position of every row in a total order."""
    return with_offsets(df.withColumn("one", F.lit(1)), order, "one", name).drop("one")


def content_signature(df: DataFrame, keys: Sequence[str], row_digest: Column, length: int = 16) -> DataFrame:
    """Order-free content digest per key, built as a tree.

    Equal rows are counted before anything is gathered, digests are grouped by their leading
    characters, and every level hashes the sorted digests of the level below. Two datasets
    get the same signature exactly when they hold the same rows the same number of times.
    """
    level = (
        df.groupBy(*keys, F.sha2(row_digest, 256).alias("d"))
        .agg(F.count("*").alias("n"))
        .select(*keys, F.col("d").alias("place"), F.sha2(F.concat_ws(":", "d", "n"), 256).alias("d"))
    )
    for width in (6, 3, 0):
        level = (
            level.groupBy(*keys, F.substring("place", 1, width).alias("place"))
            .agg(F.sha2(F.array_join(F.array_sort(F.collect_list("d")), "\n"), 256).alias("d"))
        )
    return level.select(*keys, F.substring("d", 1, length).alias("signature"))
