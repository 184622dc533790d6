"""Hard negatives by a multiway hyperplane tree with distance ranges (after GNAT).

A node of the tree has a handful of split points; a row belongs to the split point it lies nearest to, so the parts are
bounded by hyperplanes. For every split point the node stores, over *all* rows, the smallest and largest distance from
it to the rows of each sibling part. A search for scores within a window is a search for distances within an annulus
around the anchor; by the triangle inequality a part can only hold such rows if, for every split point, its range meets
the annulus moved by the anchor's own distance to that split point. What is left are leaves, in which scores are exact
whole numbers.

The split points come from a bounded sample; ranges and leaves cover every row. Leaves are dealt into blocks, so a leaf
of many near copies is spread over tasks, and each pair of a leaf block and an anchor block gives at most k rows per window.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memograph.llm.common import numbered, stored

#: Rows that split points are chosen from, split points of a node, and rows a leaf should hold.
SAMPLE, FANOUT, LEAF_ROWS = 16_384, 16, 2048
#: Sample rows that a node needs to be split, for each split point.
SUPPORT = 4
#: Rows of a leaf and anchors that one task compares at a time.
BLOCK, ANCHORS = 4096, 2048
POSITIVES, NEGATIVES = 5, 3
SCALE = 256
#: Squared norms below this keep every score a long, and below the other every product an exact double.
LARGEST_NORM, EXACT_NORM = 2.0**62, 2.0**53
#: Distances are rounded square roots; by this share of the norms they may be off.
SLACK = 1e-7


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id, label (shifted by one where 7 divides the id) and the whole-number vector of the distinct rows that take part."""
    rows = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("vec")
    )
    norm = F.aggregate("vec", F.lit(0.0), lambda total, c: total + c * c * (SCALE * SCALE))
    sound = F.forall("vec", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))) & (norm < LARGEST_NORM / 2)
    kept = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0) & sound)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return kept.select("vec_id", label.alias("label"), F.transform("vec", lambda c: F.floor(c * SCALE)).alias("vec")).distinct()


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column of equal lengths as rows of whole numbers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def norms(rows: np.ndarray) -> np.ndarray:
    return (rows * rows).sum(axis=1)


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products; in doubles where no partial sum can exceed what they hold exactly."""
    largest = max((float(norms(x).max()) for x in (left, right) if len(x)), default=0.0)
    if largest < EXACT_NORM:
        return (left.astype(float) @ right.astype(float).T).astype(np.int64)
    return left @ right.T


def distances(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    squares = norms(rows)[:, None].astype(float) + norms(points)[None].astype(float) - 2.0 * products(rows, points).astype(float)
    return np.sqrt(np.maximum(squares, 0.0))


@dataclass
class Node:
    """Split points with, for every point (row) and part (column), the range of distances from it to the rows of the part."""

    number: int
    points: np.ndarray
    #: Per part the node below, or the number of a leaf.
    parts: list = field(default_factory=list)
    nearest: np.ndarray | None = None
    farthest: np.ndarray | None = None
    #: Per part the range of squared norms.
    least: np.ndarray | None = None
    most: np.ndarray | None = None


class Tree:
    """Nodes and leaves, each numbered from 0. Each split point needs ``SUPPORT`` sample rows, so the sample bounds the tree.

    A node has as many parts as leaves of full size would hold its rows, at most ``fanout``, so that leaves are not far
    from full: each leaf an anchor is sent to costs a row.
    """

    def __init__(self, sample: np.ndarray, rows: int, fanout: int = FANOUT, leaf_rows: int = LEAF_ROWS):
        self.nodes: list[Node] = []
        self.leaves = 0
        self.root = self._grow(sample, rows / max(len(sample), 1), fanout, leaf_rows)

    def _grow(self, sample: np.ndarray, weight: float, fanout: int, leaf_rows: int) -> Node | int:
        parts = min(fanout, int(-(-len(sample) * weight // leaf_rows)), len(sample) // SUPPORT)
        points = self._spread(sample, parts) if parts > 1 else sample[:0]
        if len(points) < 2:
            self.leaves += 1
            return self.leaves - 1
        node = Node(len(self.nodes), points)
        self.nodes.append(node)
        part = distances(sample, points).argmin(axis=1)
        node.parts = [self._grow(sample[part == j], weight, fanout, leaf_rows) for j in range(len(points))]
        return node

    @staticmethod
    def _spread(sample: np.ndarray, count: int) -> np.ndarray:
        """Different points far from each other: each is the one of a spaced-out few that is farthest from those before it."""
        pool = sample[:: max(1, len(sample) // (8 * count))]
        chosen, gap = [0], distances(pool, pool[:1])[:, 0]
        while len(chosen) < count and gap.max() > 0:
            chosen.append(int(gap.argmax()))
            gap = np.minimum(gap, distances(pool, pool[chosen[-1:]])[:, 0])
        return pool[chosen]

    def walk(self, rows: np.ndarray, visit=None) -> np.ndarray:
        """The leaf of every row; ``visit(node, rows, distances, part)`` sees the rows that pass a node."""
        leaf = np.zeros(len(rows), dtype=np.int32)
        waiting = [(self.root, np.arange(len(rows)))]
        while waiting:
            at, own = waiting.pop()
            if not isinstance(at, Node):
                leaf[own] = at
                continue
            gaps = distances(rows[own], at.points)
            part = gaps.argmin(axis=1)
            if visit:
                visit(at, rows[own], gaps, part)
            waiting += [(at.parts[j], own[part == j]) for j in np.unique(part)]
        return leaf

    def clear(self) -> None:
        """Ranges of no rows: a part that no row was seen in can never be met."""
        for node in self.nodes:
            n = len(node.points)
            node.nearest, node.farthest = np.full((n, n), np.inf), np.full((n, n), -np.inf)
            node.least, node.most = np.full(n, np.inf), np.full(n, -np.inf)

    def see(self, node: Node, rows: np.ndarray, gaps: np.ndarray, part: np.ndarray) -> None:
        """Widen the ranges of a node by rows that pass it."""
        size = norms(rows).astype(float)
        for j in np.unique(part):
            own = part == j
            node.nearest[:, j] = np.minimum(node.nearest[:, j], gaps[own].min(axis=0))
            node.farthest[:, j] = np.maximum(node.farthest[:, j], gaps[own].max(axis=0))
            node.least[j], node.most[j] = min(node.least[j], size[own].min()), max(node.most[j], size[own].max())

    def met(self, anchors: np.ndarray, owner: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Which leaves (columns) may hold a row of a score from ``low`` to ``high`` with the anchor that owns the window (rows)."""
        found = np.zeros((len(owner), self.leaves), dtype=bool)
        size = norms(anchors).astype(float)
        waiting = [(self.root, np.arange(len(owner)))]
        while waiting:
            at, own = waiting.pop()
            if not isinstance(at, Node):
                found[own, at] = True
                continue
            gap = distances(anchors, at.points)[owner[own]][:, :, None]
            base = size[owner[own]][:, None]
            room = SLACK * (np.sqrt(base) + np.sqrt(np.maximum(at.most, 0)))[:, None]
            # score = (|a|^2 + |x|^2 - distance^2) / 2, so a window of scores is an annulus of distances.
            outer = base + at.most - 2.0 * low[own, None]
            inner = base + at.least - 2.0 * high[own, None]
            outer, inner = (np.sqrt(np.maximum(x, 0.0))[:, None] for x in (outer, inner))
            alive = (at.nearest <= gap + outer + room) & (at.farthest >= np.maximum(gap - outer, inner - gap) - room)
            alive = alive.all(axis=1) & (at.most >= 0)
            waiting += [(at.parts[j], own[alive[:, j]]) for j in np.flatnonzero(alive.any(axis=0))]
        return found


def indexed(rows: DataFrame, fanout: int = FANOUT, leaf_rows: int = LEAF_ROWS) -> tuple[Tree, DataFrame]:
    """A tree over stored ``rows`` with the ranges of them all, and the rows with their ``leaf``, stored."""
    drawn = rows.orderBy(F.xxhash64("vec"), "row").limit(SAMPLE).select("vec").toArrow()
    tree = Tree(matrix(drawn.column("vec")) if len(drawn) else np.zeros((0, 0), np.int64), rows.count(), fanout, leaf_rows)
    send = rows.sparkSession.sparkContext.broadcast
    bare = send(tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = bare.value.walk(matrix(batch.column("vec")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], [*batch.schema.names, "leaf"])

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bare.value
        own.clear()
        for batch in batches:
            own.walk(matrix(batch.column("vec")), own.see)
        for node in own.nodes:
            n = len(node.points)
            point, part = (x.ravel() for x in np.meshgrid(np.arange(-1, n), np.arange(n), indexing="ij"))
            low, high = np.vstack([node.least, node.nearest]).ravel(), np.vstack([node.most, node.farthest]).ravel()
            seen = low <= high
            made = [np.full(len(part), node.number), point, part]
            yield pa.RecordBatch.from_arrays([*[pa.array(c[seen], pa.int32()) for c in made], pa.array(low[seen]), pa.array(high[seen])], ["node", "point", "part", "low", "high"])

    located = stored(rows.select("row", "vec_id", "label", "vec").mapInArrow(place, "row long, vec_id long, label int, vec array<long>, leaf int"), "located")
    seen = located.select("vec").mapInArrow(ranges, "node int, point int, part int, low double, high double")
    tree.clear()
    # A row per node, split point and part: bounded by the size of the tree, whatever the number of rows.
    for node, point, part, low, high in seen.groupBy("node", "point", "part").agg(F.min("low"), F.max("high")).collect():
        at = tree.nodes[node]
        if point < 0:
            at.least[part], at.most[part] = low, high
        else:
            at.nearest[point, part], at.farthest[point, part] = low, high
    return tree, located


ASKED = "anchor long, vec_id long, label int, vec array<long>, keys array<long>, low array<long>, high array<long>"
FOUND = pa.schema([("anchor", pa.int64()), ("key", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def sent(asked: DataFrame, tree: Tree) -> DataFrame:
    """Anchors with their windows, once per leaf that may hold a row of one of the windows."""
    known = asked.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                windows = pa.compute.list_value_length(part.column("low")).to_numpy(zero_copy_only=False)
                low, high = (part.column(c).flatten().to_numpy().astype(float) for c in ("low", "high"))
                owner = np.repeat(np.arange(len(part)), windows)
                met = known.value.met(matrix(part.column("vec")), owner, low, high)
                alive = np.zeros((len(part), met.shape[1]), dtype=bool)
                np.logical_or.at(alive, owner, met)
                at, leaf = np.nonzero(alive)
                yield pa.RecordBatch.from_arrays([*part.take(pa.array(at)).columns, pa.array(leaf.astype(np.int32))], [*part.schema.names, "leaf"])

    return asked.mapInArrow(run, f"{ASKED}, leaf int")


def best_of(asking: pa.Table, rows: pa.Table, same: bool, k: int) -> pa.Table:
    """Of each anchor's windows the k best rows, of its own label or of others; ties to the smaller id."""
    made: list[list[np.ndarray]] = [[], [], [], []]
    if len(asking) and len(rows):
        vectors, ids, labels = matrix(rows.column("vec")), rows.column("vec_id").to_numpy(), rows.column("label").to_numpy()
        anchors, own_ids, own_labels, names = matrix(asking.column("vec")), *[asking.column(c).to_numpy() for c in ("vec_id", "label", "anchor")]
        windows = list(zip(*[asking.column(c).to_pylist() for c in ("keys", "low", "high")]))
        for start in range(0, len(anchors), 128):
            scores = products(anchors[start : start + 128], vectors)
            for i, row in enumerate(scores, start):
                fits = np.flatnonzero(((labels == own_labels[i]) == same) & (ids != own_ids[i]))
                row = row[fits]
                for key, low, high in zip(*windows[i]):
                    inside = np.flatnonzero((row >= low) & (row <= high))
                    if len(inside) > k:
                        reach = row[inside]
                        inside = inside[reach >= np.partition(reach, -k)[-k]]
                    keep = inside[np.lexsort((ids[fits[inside]], -row[inside]))[:k]]
                    for column, values in zip(made, (np.full(len(keep), names[i]), np.full(len(keep), key), ids[fits[keep]], row[keep])):
                        column.append(values)
    return pa.table([pa.array(np.concatenate(c) if c else [], f.type) for c, f in zip(made, FOUND)], schema=FOUND)


def searched(located: DataFrame, sent_to: DataFrame, same: bool, k: int) -> DataFrame:
    """anchor, key, vec_id, score, rank: the k best rows of each window among the leaves that the anchors were sent to."""
    blocks = located.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    asked = sent_to.groupBy("leaf").agg(F.ceil(F.count("*") / ANCHORS).alias("asking"))
    shape = F.broadcast(stored(blocks.join(asked, "leaf"), "shape"))
    copies = lambda n: F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int")))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    rows = located.join(shape, "leaf").select("leaf", dealt("row", "blocks").alias("block"), copies("asking").alias("part"), "vec_id", "label", "vec")
    asking = sent_to.join(shape, "leaf").drop("blocks").withColumn("part", dealt("anchor", "asking"))
    asking = asking.join(shape.select("leaf", "blocks"), "leaf").select("*", copies("blocks").alias("block")).drop("blocks", "asking")
    keys = ["leaf", "block", "part"]
    pairs = asking.groupBy(*keys).cogroup(rows.groupBy(*keys))
    found = pairs.applyInArrow(lambda a, r: best_of(a, r, same, k), "anchor long, key long, vec_id long, score long")
    order = Window.partitionBy("anchor", "key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(
    embeddings: DataFrame, every: int = 50, positives: int = POSITIVES, negatives: int = NEGATIVES, fanout: int = FANOUT, leaf_rows: int = LEAF_ROWS
) -> DataFrame:
    """Per anchor and positive: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose vec_id ``every`` divides. Rows without an id, label or vector, with an empty vector, with a
    null or non-finite component, or so long that a score might exceed a long take no part. Repeated rows count once;
    different rows of one id are rows of their own, but no row is a partner of an anchor with its own id. Vectors must be
    of one width, else it is an error. Scores are exact and all that qualify are found: the tree only leaves out parts
    that cannot hold any. Pairs without a negative, and tables without anchors, give no rows.
    """
    rows = stored(numbered(usable(embeddings), "row", "usable"), "rows")
    if len(rows.select(F.size("vec")).distinct().limit(2).collect()) > 1:
        raise ValueError("vectors of different widths")
    tree, located = indexed(rows, fanout, leaf_rows)
    anchors = stored(located.filter(F.col("vec_id") % every == 0).withColumnRenamed("row", "anchor"), "anchors")

    def asked(keys, low, high) -> list:
        return ["anchor", "vec_id", "label", "vec", *[F.array(c).alias(n) for n, c in (("keys", keys), ("low", low), ("high", high))]]

    anything = (F.lit(0).cast("long"), F.lit(-int(LARGEST_NORM)), F.lit(int(LARGEST_NORM)))
    # An anchor's own leaf gives a bound on its positives; the tree then leads to all leaves that may hold better ones.
    first = searched(located, anchors.select(*asked(*anything), "leaf"), True, positives)
    bound = first.filter(F.col("rank") == positives).select("anchor", F.col("score").alias("bound"))
    bounded = anchors.join(bound, "anchor", "left").select(*asked(anything[0], F.coalesce("bound", anything[1]), anything[2]))
    near = stored(searched(located, sent(bounded, tree), True, positives).select("anchor", "rank", "vec_id", "score"), "positives")
    # 50 p <= 100 n <= 95 p in whole numbers; no n is that for a negative p.
    window = near.filter("score >= 0").select("anchor", F.struct(
        F.col("rank").cast("long").alias("key"), F.expr("(score + 1) div 2").alias("low"), F.expr("score - (score + 19) div 20").alias("high")
    ).alias("window"))
    wanted = window.groupBy("anchor").agg(F.collect_list("window").alias("windows"))
    hunting = anchors.join(wanted, "anchor").select(
        "anchor", "vec_id", "label", "vec", *[F.col(f"windows.{c}").alias(n) for c, n in (("key", "keys"), ("low", "low"), ("high", "high"))]
    )
    found = searched(located, sent(hunting, tree), False, negatives)
    named = near.select("anchor", F.col("rank").cast("long").alias("key"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    ids = anchors.select("anchor", F.col("vec_id").alias("anchor_id"))
    return found.join(named, ["anchor", "key"]).join(ids, "anchor").select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def oracle_sql(every: int = 50) -> str:
    """All pairs in DuckDB."""
    best = "row_number() OVER (PARTITION BY {0} ORDER BY score DESC, {1}) AS rank"
    return f"""
WITH known AS (
    SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda c: floor({SCALE} * c::DOUBLE)) AS vec
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
),
pairs AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.vec, b.vec)::BIGINT AS score
    FROM known a JOIN known b ON a.vec_id % {every} = 0 AND a.vec_id <> b.vec_id
),
near AS (SELECT * FROM (SELECT *, {best.format('anchor_id', 'other_id')} FROM pairs WHERE same) WHERE rank <= {POSITIVES}),
far AS (
    SELECT n.anchor_id, n.other_id AS positive_id, p.other_id AS negative_id, n.score AS positive_score, p.score AS negative_score, p.score
    FROM near n JOIN pairs p ON p.anchor_id = n.anchor_id AND NOT p.same AND 50 * n.score <= 100 * p.score AND 100 * p.score <= 95 * n.score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score
FROM (SELECT *, {best.format('anchor_id, positive_id', 'negative_id')} FROM far) WHERE rank <= {NEGATIVES}
"""
