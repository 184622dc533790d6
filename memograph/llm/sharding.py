"""Shards cut from a Hilbert curve through several metadata dimensions, in DataFrame functions only.

Every dimension is quantised by rank, so that its cells hold about as many rows each, whatever its values are. Rows are
sorted by the index of their cell on the Hilbert curve and the sorted rows are cut into runs. Neighbours on the curve
are close in all dimensions, so a run spans a small range of each of them, and the smallest and largest values that
Parquet keeps per file let a query over any of the dimensions skip most files.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memograph.llm.common import stored

BITS = 8
SHARDS = 16
DIMENSIONS = ("lang", "source", "size")
#: The low bits of a row number from Spark count the rows of a partition, the others the partitions.
PLACE_BITS = 33


@cache
def curve(dims: int) -> tuple[list[int], list[int]]:
    """Steps of the Hilbert curve as a state machine: the digit and the next state at ``state << dims | corner``.

    A state is the corner where a cell is entered and the direction in which it is crossed. ``corner`` holds one bit per
    dimension, the first one lowest.
    """
    corners = 1 << dims
    turn = lambda x, n: (x << n % dims | x >> (dims - n % dims)) & (corners - 1)
    gray = [x ^ x >> 1 for x in range(corners)]
    enter = [gray[(w - 1) & ~1] if w else 0 for w in range(corners)]
    low_ones = lambda x: ((x + 1) & ~x).bit_length() - 1
    cross = [0 if w == 0 else low_ones(w - 1 if w % 2 == 0 else w) % dims for w in range(corners)]
    digits, states = [], []
    for state in range(corners * dims):
        entry, axis = divmod(state, dims)
        for corner in range(corners):
            digit = gray.index(turn(corner ^ entry, dims - axis - 1))
            digits.append(digit)
            states.append((entry ^ turn(enter[digit], axis + 1)) * dims + (axis + cross[digit] + 1) % dims)
    return digits, states


def hilbert_index(codes: Sequence[Column], bits: int = BITS) -> Column:
    """Index on the curve of a cell, given by a code below ``2 ** bits`` in each dimension; at most 63 bits together."""
    dims = len(codes)
    if dims * bits > 63:
        raise ValueError(f"{dims} dimensions of {bits} bits do not fit an index of 63 bits")
    digits, states = (F.array(*map(F.lit, values)) for values in curve(dims))
    names = [f"code_{i}" for i in range(dims)]
    start = F.struct(
        F.lit(0).cast("long").alias("index"), F.lit(0).alias("state"), *[c.cast("int").alias(n) for n, c in zip(names, codes)]
    )

    def step(done: Column, bit: Column) -> Column:
        corner = F.lit(0)
        for i, name in enumerate(names):
            corner = corner + F.call_function("shiftright", done[name], bit).bitwiseAND(F.lit(1)) * (1 << i)
        at = done["state"] * (1 << dims) + corner
        index = done["index"] * (1 << dims) + F.get(digits, at)
        return F.struct(index.alias("index"), F.get(states, at).alias("state"), *[done[n].alias(n) for n in names])

    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0)), start, step, lambda done: done["index"])


def in_order(rows: DataFrame, order: Sequence[str], weight: Column, name: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` sorted into ranges and stored with ``part`` and ``pos``, and per range the weight of all before it."""
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    ranged = rows.orderBy(*order).withColumns({"part": F.spark_partition_id(), "pos": place})
    kept = stored(ranged, name)
    # One row per range of the sort is all that is added up in one place.
    sums = kept.groupBy("part").agg(F.sum(weight).alias("own"))
    shifts = sums.select("part", (F.sum("own").over(Window.orderBy("part")) - F.col("own")).alias("shift"))
    return kept, shifts


def cuts(rows: DataFrame, dimension: str, total: int, bits: int) -> list:
    """The smallest value of each code from 1 up: ``code(v) = floor(2 ** bits * (rows with a smaller value) / all rows)``.

    Codes that no value has share the cut of the next one. At most ``2 ** bits - 1`` values come to the driver.
    """
    counts = rows.groupBy(F.col(dimension).alias("value")).agg(F.count("*").alias("rows"))
    kept, shifts = in_order(counts, ["value"], F.col("rows"), "values")
    inside = Window.partitionBy("part").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    before = kept.join(F.broadcast(shifts), "part").withColumn("before", F.col("shift") + F.coalesce(F.sum("rows").over(inside), F.lit(0)))
    codes = before.select("value", F.expr(f"int((before * {1 << bits}L) div {total}L)").alias("code"))
    first = sorted((r["code"], r["value"]) for r in codes.groupBy("code").agg(F.min("value").alias("value")).collect())
    found, at = [], 0
    for code in range(1, 1 << bits):
        while at < len(first) and first[at][0] < code:
            at += 1
        found.append(first[at][1] if at < len(first) else None)
    return found


def code_of(value: Column, known: list, kind) -> Column:
    """How many cuts are not above the value, by bisection."""
    listed = F.array(*[F.lit(x).cast(kind) for x in known])
    steps = F.array(*[F.lit((len(known) + 1) >> i) for i in range(1, (len(known) + 1).bit_length())])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(listed, at + step - 1) <= value, at + step).otherwise(at))


def hilbert_shards(
    rows: DataFrame, dimensions: Sequence[str], shards: int = SHARDS, ties: Sequence[str] = (), bits: int = BITS
) -> DataFrame:
    """``rows`` with ``curve_index``, ``shard`` and ``slot``: runs along the curve whose counts are at most one apart.

    ``dimensions`` name columns without nulls of types that can be sorted; rows of one cell are ordered by them, then
    by ``ties``, then in no stated order. ``rows`` is read several times and should be a stored table. New columns must
    not be among those of ``rows``. An empty table gives no rows; with fewer rows than shards some shards are empty.
    """
    total = rows.count()
    if not total:
        none = {"curve_index": F.lit(0).cast("long"), "shard": F.lit(0), "slot": F.lit(0).cast("long")}
        return rows.withColumns(none)
    kinds = {c: rows.schema[c].dataType for c in dimensions}
    codes = [code_of(F.col(c), cuts(rows, c, total, bits), kinds[c]) for c in dimensions]
    indexed = rows.withColumns({"curve_index": hilbert_index(codes, bits), "any_order": F.monotonically_increasing_id()})
    # Stored first, as choosing the ranges reads the rows a second time and must see the same numbers.
    kept, shifts = in_order(stored(indexed, "indexed"), ["curve_index", *dimensions, *ties, "any_order"], F.lit(1), "curve")
    ranked = kept.join(F.broadcast(shifts), "part").withColumn("rank", F.col("pos") + F.col("shift"))
    cut = ranked.withColumn("shard", F.expr(f"int((rank * {shards}L) div {total}L)"))
    slot = F.expr(f"rank - (shard * {total}L + {shards - 1}L) div {shards}L")
    return cut.withColumn("slot", slot).drop("part", "pos", "shift", "rank", "any_order")


def measured(docs: DataFrame, whole_rows: bool = False) -> DataFrame:
    """Per row: doc_id, size (bytes of the text and one more), text_crc32, text_md5, lang and source; null texts count as empty.

    Missing or null languages and sources are empty ones. With ``whole_rows`` all columns of ``docs`` come along in ``row``.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in docs.columns else F.lit("")
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if whole_rows else []
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("text_md5"),
        name("lang").alias("lang"), name("source").alias("source"), *row,
    )


def shard_documents(docs: DataFrame, shards: int = SHARDS, dimensions: Sequence[str] = DIMENSIONS) -> DataFrame:
    """Per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard and curve_index.

    The law is ``rows``: shard counts are at most one apart, so grown_shard is null. Rows of one cell that agree in all
    dimensions are ordered by the digest of the text, then doc_id, so equal texts with equal metadata lie side by side.
    Equal rows are interchangeable and keep a slot each. Null texts count as empty, null metadata as an empty string, a
    null doc_id sorts first; a table without rows gives none. Only these slim columns are sorted, no text is moved.
    """
    slim = stored(measured(docs), "measured")
    cut = hilbert_shards(slim, dimensions, shards, ["text_md5", "doc_id"])
    return cut.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve_index"
    )


def write_shards(docs: DataFrame, folder: str, shards: int = SHARDS, dimensions: Sequence[str] = DIMENSIONS) -> None:
    """All columns of ``docs`` as Parquet under ``folder``, one partition ``shard=n`` per shard, in curve order.

    A large shard is several files, each a stretch of the curve, so readers skip files by their smallest and largest values.
    """
    cut = hilbert_shards(stored(measured(docs, whole_rows=True), "measured"), dimensions, shards, ["text_md5", "doc_id"])
    laid = cut.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    taken = "shard" in (c.lower() for c in docs.columns)
    laid.select("shard", "row" if taken else "row.*").write.partitionBy("shard").parquet(folder)


def oracle_sql(shards: int = SHARDS, bits: int = BITS) -> str:
    """The same shards in DuckDB: ranks by window functions, one step of the curve per bit, checksums bit by bit."""
    digits, states = (f"[{', '.join(map(str, x))}]" for x in curve(len(DIMENSIONS)))
    codes = ", ".join(
        f"((rank() OVER (ORDER BY {c}) - 1) * {1 << bits} // count(*) OVER ())::INTEGER AS code_{i}" for i, c in enumerate(DIMENSIONS)
    )
    steps, last = [], "coded"
    for bit in reversed(range(bits)):
        corner = " + ".join(f"((code_{i} >> {bit}) & 1) * {1 << i}" for i in range(len(DIMENSIONS)))
        at = f"state * {1 << len(DIMENSIONS)} + {corner} + 1"
        steps.append(
            f"step_{bit} AS (SELECT * REPLACE (curve_index * {1 << len(DIMENSIONS)} + digits[{at}] AS curve_index, states[{at}] AS state) FROM {last}, tables)"
            if last == "coded" else
            f"step_{bit} AS (SELECT * REPLACE (curve_index * {1 << len(DIMENSIONS)} + digits[{at}] AS curve_index, states[{at}] AS state) FROM {last})"
        )
        last = f"step_{bit}"
    bytes_of = "list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)"
    half = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    rounds = "i::BIGINT"
    for _ in range(8):
        rounds = f"(SELECT {half} FROM (SELECT {rounds} AS c))"
    return f"""
WITH tables AS (SELECT {digits}::BIGINT[] AS digits, {states}::BIGINT[] AS states),
crc AS (SELECT list({rounds} ORDER BY i) AS crc_table FROM range(256) t(i)),
slim AS (
    SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size, md5(coalesce(text, '')) AS text_md5,
        coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, {bytes_of}),
            lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1]))) AS text_crc32
    FROM documents, crc
),
coded AS (SELECT *, 0::BIGINT AS curve_index, 0::BIGINT AS state, {codes} FROM slim),
{(',' + chr(10)).join(steps)},
ranked AS (
    SELECT *, row_number() OVER (ORDER BY curve_index, {', '.join(DIMENSIONS)}, text_md5, doc_id NULLS FIRST) - 1 AS place, count(*) OVER () AS total
    FROM {last}
)
SELECT doc_id, size, text_crc32, 'rows' AS law, (place * {shards} // total)::INTEGER AS shard,
    place - ((place * {shards} // total) * total + {shards - 1}) // {shards} AS slot, NULL::INTEGER AS grown_shard, curve_index
FROM ranked
"""
