"""Near duplicates by MinHash: one-permutation signatures, banded buckets, star-shaped candidate edges.

A document's set holds the hashes of its word shingles. One pass sorts the set into bins and keeps the smallest
of each; an empty bin borrows from the first non-empty one in an order of bins that is its own (optimal
densification). Bands of five bins are the buckets. Documents of equal sets are one node, however many there are.

Every bucket is a star: its members are compared with one centre alone, on whole sets, so a round has at most as many
pairs as rows. Members that the star leaves in another component than its centre get another centre in the next
round. What is still apart then is compared pair by pair across components, as far as parity sketches of the sets
leave a link possible (a bound, not an estimate), so no link is lost to the star.
Sets of at most ``SMALL`` shingles have too few full bins to rely on; they have exact keys besides, the smallest
fifth of their hashes, one of which any two sets linked with each other share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memograph.llm.common import checkpointed, stored, text_slices

WORDS = 5
SIMILARITY = 80
BINS, BAND = 256, 5
SMALL = 64
#: Bits of the parity sketch of a set.
SKETCH = 1024
#: Members of a bucket that one task holds at a time, twice.
BLOCK = 1024
#: Rounds of stars, and pairs across components for each row of the buckets that are few enough to need no more.
STARS, LINEAR = 2, 2
SLICE = 4 << 20
SIGNED_FIELDS = "doc_id long, n_shingles long, cls binary, keys array<long>"


class Shingler:
    """Hashes of word shingles of many texts at once."""

    def __init__(self, words: int):
        draw = np.random.default_rng(20240229)
        odd = lambda n: draw.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.words, self.letters, self.factors, self.counts = words, odd(256), odd(words), odd(words + 1)
        self.letters[65:91] = self.letters[97:123]
        self.gap = np.isin(np.arange(256), [32, *range(9, 14)])
        base = 0x9E3779B97F4A7C15 | 1
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.powers = self.inverses = np.ones(1, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        if n > len(self.powers):
            with np.errstate(over="ignore"):
                self.powers = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, self.base, dtype=np.uint64)])
                self.inverses = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, self.inverse, dtype=np.uint64)])

    def sets(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """The sorted distinct shingle hashes of each text."""
        joined = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
        ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, dtype=np.int64)
        self._grow(len(joined) + 1)
        with np.errstate(over="ignore"):
            blank = self.gap[joined]
            edges = np.flatnonzero(np.diff(np.r_[True, blank].view(np.int8)))
            starts, stops = edges[0::2], edges[1::2]
            running = np.cumsum(self.letters[joined] * self.powers[: len(joined)])
            before = np.where(starts > 0, running[starts - 1], np.uint64(0)) if len(starts) else running[:0]
            hashed = mixed((running[stops - 1] - before) * self.inverses[starts] + (stops - starts).astype(np.uint64))
            first = np.r_[0, np.searchsorted(starts, ends)]
            k = self.words
            if len(hashed) >= k:
                n = len(hashed) - k + 1
                rows = mixed(sum(hashed[j : j + n] * self.factors[j] for j in range(k)) + self.counts[k])
            else:
                rows = hashed[:0]
            for a, b in zip(first[:-1], first[1:]):
                n = int(b - a)
                if n >= k:
                    yield np.unique(rows[a : b - k + 1])
                elif n:
                    yield mixed((hashed[a:b] * self.factors[:n]).sum(keepdims=True) + self.counts[n])
                else:
                    yield hashed[:0]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers (two rounds of shift and multiply)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Signer:
    """Bucket keys of a sorted set of hashes."""

    def __init__(self, bins: int = BINS, band: int = BAND, small: int = SMALL, percent: int = SIMILARITY):
        draw = np.random.default_rng(7)
        self.bins, self.band, self.small, self.percent = bins, band, small, percent
        self.shift = np.uint64(64 - (bins - 1).bit_length())
        self.turns = np.array([draw.permutation(bins) for _ in range(bins)])
        self.bands = bins // band
        self.factors = draw.integers(0, 2**63, band, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.places = draw.integers(0, 2**63, self.bands + 1, dtype=np.uint64)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        at = (hashes >> self.shift).astype(np.int64)
        lowest = np.flatnonzero(np.diff(at, prepend=-1))
        full = np.zeros(self.bins, dtype=bool)
        full[at[lowest]] = True
        kept = np.zeros(self.bins, dtype=np.uint64)
        kept[at[lowest]] = hashes[lowest]
        empty = np.flatnonzero(~full)
        if empty.size:
            turns = self.turns[empty]
            kept[empty] = kept[turns[np.arange(empty.size), full[turns].argmax(axis=1)]]
        return kept

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        if not hashes.size:
            return np.zeros(0, dtype=np.int64)
        with np.errstate(over="ignore"):
            rows = self.signature(hashes)[: self.bands * self.band].reshape(self.bands, self.band)
            made = mixed((rows * self.factors).sum(axis=1) + self.places[: self.bands])
            if hashes.size <= self.small:
                need = -(-self.percent * hashes.size // 100)
                made = np.r_[made, mixed(hashes[: hashes.size - need + 1] + self.places[self.bands])]
        return made.view(np.int64)


def _text_bytes(batch: pa.RecordBatch, start: int, end: int) -> list[bytes]:
    return [t or b"" for t in batch.column(1)[start:end].cast(pa.binary()).to_pylist()]


def signed(docs: DataFrame, words: int = WORDS, percent: int = SIMILARITY) -> DataFrame:
    """Per row: doc_id, set size, digest of the set (equal for equal sets), bucket keys."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("cls", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, signer = Shingler(words), Signer(percent=percent)
        for batch in batches:
            for start, end in text_slices(batch.column(1), SLICE):
                sizes, digests, keys = [], [], []
                for hashes in shingler.sets(_text_bytes(batch, start, end)):
                    sizes.append(hashes.size)
                    digests.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest())
                    keys.append(signer.keys(hashes))
                made = [batch.column(0)[start:end], pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(made, schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SIGNED_FIELDS)


def odd_bits(hashes: np.ndarray) -> np.ndarray:
    """Parity sketch: for each of ``SKETCH`` places, whether an odd number of hashes falls there."""
    places = np.bincount((hashes & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
    return np.packbits((places & 1).astype(bool))


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """Per row: doc_id, digest of the set, the set itself as sorted 64-bit hashes, its parity sketch."""
    schema = pa.schema([("doc_id", pa.int64()), ("cls", pa.binary()), ("hashes", pa.binary()), ("odd", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            for start, end in text_slices(batch.column(1), SLICE):
                hashes = list(shingler.sets(_text_bytes(batch, start, end)))
                sets = [h.tobytes() for h in hashes]
                digests = [hashlib.blake2b(s, digest_size=16).digest() for s in sets]
                odd = pa.array([odd_bits(h).tobytes() for h in hashes], pa.binary())
                made = [batch.column(0)[start:end], pa.array(digests, pa.binary()), pa.array(sets, pa.binary()), odd]
                yield pa.RecordBatch.from_arrays(made, schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, cls binary, hashes binary, odd binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The components (a, b) of those pairs (node, other, a, b) whose whole sets are similar enough, counted in integers."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(z.as_buffer(), dtype=np.uint64) for z in (x, y))
                both = np.sort(np.concatenate([x, y]), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                near.append(100 * common >= percent * (x.size + y.size - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], schema=schema).filter(pa.array(near, pa.bool_()))

    left, right = (sets.select(F.col("node").alias(n), F.col("hashes").alias(f"{n}_hashes")) for n in ("node", "other"))
    both = pairs.join(left, "node").join(right, "other").select("a", "b", "node_hashes", "other_hashes")
    return both.mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """Smallest node reachable from each node of the links (a, b): columns node, label.

    Every round each node takes the smallest label among its neighbours and then its label's own label, so the
    number of rounds grows with the logarithm of the longest path.
    """
    ways = checkpointed(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = checkpointed(ways.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).withColumnRenamed("a", "node"))
    while True:
        around = ways.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("around"))
        lower = labels.join(around, "node").select("node", F.least("label", "around").alias("label"), F.col("label").alias("was"))
        above = lower.select(F.col("node").alias("label"), F.col("label").alias("above"))
        fresh = checkpointed(lower.join(above, "label").select("node", F.col("above").alias("label"), "was"))
        labels = fresh.select("node", "label")
        if fresh.filter("label < was").isEmpty():
            return labels


def _alike(n: str, m: str, percent: int) -> Column:
    """Whether sets of these sizes can be similar enough at all."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _pairs_across(placed: DataFrame) -> int:
    """Pairs of members of a bucket that are in different components, summed over buckets."""
    each = placed.groupBy("key", "label").agg(F.count("*").cast("double").alias("c"))
    inside = each.groupBy("key").agg(((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))) / 2).alias("pairs"))
    return int(inside.agg(F.sum("pairs")).first()[0] or 0)


def _star(placed: DataFrame, percent: int, turn: int) -> DataFrame:
    """Each bucket's centre (node) with its members of other components (other); another centre every turn."""
    centre = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("order"), "node", "n", "label")).alias("centre")
    centres = placed.groupBy("key").agg(centre, F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
    met = placed.join(centres.select("key", "centre"), "key").filter(F.col("label") != F.col("centre.label"))
    met = met.filter(_alike("n", "centre.n", percent))
    return _ordered(met.select(F.col("centre.node").alias("x"), F.col("node").alias("y"), F.col("centre.label").alias("lx"), F.col("label").alias("ly")))


def _across(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of members of a bucket in different components, less those that cannot be similar enough.

    Every bit in which two parity sketches differ stands for at least one shingle that only one of the sets has. With d
    such shingles, intersection and union are (n + m - d) / 2 and (n + m + d) / 2. Buckets are met in pairs of blocks
    of bounded size, and only the pairs that are left become rows.
    """
    split = placed.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rest = placed.join(split.filter("low < high").select("key", "blocks"), "key").join(sets.select("node", "odd"), "node")
    rest = rest.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(F.least(b, "block").alias("i"), F.greatest(b, "block").alias("j")))
    spread = rest.select("key", "node", "n", "label", "block", "odd", F.explode(meets).alias("meet")).select("key", "meet.i", "meet.j", "node", "n", "label", "block", "odd")
    schema = pa.schema([(c, pa.int64()) for c in ("x", "y", "lx", "ly")])

    def compared(rows: pa.Table) -> pa.RecordBatch:
        column = lambda c: rows.column(c).to_numpy()
        node, size, label, block = map(column, ("node", "n", "label", "block"))
        sketch = np.frombuffer(b"".join(rows.column("odd").to_pylist()), dtype=np.uint64).reshape(len(rows), -1)
        first, second = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
        found = []
        for at in np.flatnonzero(block == first):
            others = np.flatnonzero((block == second) & (label != label[at]))
            if first == second:
                others = others[others > at]
            apart = np.maximum(np.bitwise_count(sketch[others] ^ sketch[at]).sum(axis=1, dtype=np.int64), np.abs(size[others] - size[at]))
            both = size[others] + size[at]
            near = others[100 * (both - apart) >= percent * (both + apart)]
            found.append(np.stack([np.full(near.size, node[at]), node[near], np.full(near.size, label[at]), label[near]]))
        made = np.concatenate(found, axis=1) if found else np.zeros((4, 0), dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(m) for m in made], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, 3):
            yield compared(rows)

    dealt = spread.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
    return _ordered(dealt.mapInArrow(run, "x long, y long, lx long, ly long"))


def _runs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.Table]:
    """Consecutive rows that are equal in the first ``width`` columns."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in range(width)])
        starts = np.r_[0, np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, batch.num_rows]
        for a, b in zip(starts[:-1], starts[1:]):
            here = tuple(keys[:, a])
            if held and here != key:
                yield pa.Table.from_batches(held)
                held = []
            key = here
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _ordered(pairs: DataFrame) -> DataFrame:
    """Distinct pairs (node, other) with node < other and their components (a, b)."""
    turned = F.col("x") < F.col("y")
    pick = lambda p, q: F.when(turned, F.col(p)).otherwise(F.col(q))
    return pairs.select(pick("x", "y").alias("node"), pick("y", "x").alias("other"), pick("lx", "ly").alias("a"), pick("ly", "lx").alias("b")).distinct()


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = SIMILARITY) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Words are split at ASCII white space, with A to Z lowered; a text with fewer than ``words`` of them is one
    shingle, one without any (or null) has an empty set and is linked with nothing. Documents are linked if
    100 * intersection >= percent * union; a component's id is the smallest doc_id that is linked to it. Repeated rows
    come back as often as they went in; rows of one doc_id with different texts are judged each by its own text.
    A row without a doc_id counts as a document that is linked with nothing: component_id null, kept true.
    """
    rows = stored(signed(docs, words, percent), "signed")
    real = rows.filter("n_shingles > 0 and doc_id is not null")
    nodes = stored(
        real.groupBy("cls").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys")), "nodes"
    )
    keyed = nodes.select(F.explode("keys").alias("key"), "node", "n")
    shared = keyed.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1").select("key")
    members = stored(keyed.join(shared, "key").select("key", "node", "n"), "members")

    wanted = members.select("node").distinct().join(nodes.select("node", "cls"), "node").withColumnRenamed("node", "doc_id")
    found = docs.select("doc_id", "text").join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    sets = shingle_sets(found, words).join(wanted, ["doc_id", "cls"]).dropDuplicates(["doc_id", "cls"])
    sets = stored(sets.select(F.col("doc_id").alias("node"), "hashes", "odd"), "sets")

    labels = members.select("node", F.col("node").alias("label")).distinct()
    tried, turn, whole, few = None, 0, False, LINEAR * members.count()
    while not whole:
        placed = members.join(labels, "node").select("key", "node", "n", "label")
        whole = turn == STARS or _pairs_across(placed) <= few
        pairs = _across(placed, sets, percent) if whole else _star(placed, percent, turn)
        pairs = stored(pairs if tried is None else pairs.join(tried, ["node", "other"], "left_anti"), "pairs")
        links = checkpointed(confirmed(pairs, sets, percent))
        if not links.isEmpty():
            lower = components(links).select(F.col("node").alias("label"), F.col("label").alias("lower"))
            labels = checkpointed(labels.join(lower, "label", "left").select("node", F.coalesce("lower", "label").alias("label")))
        seen = pairs.select("node", "other")
        tried, turn = seen if tried is None else tried.unionByName(seen), turn + 1

    classes = nodes.select("cls", "node").join(labels, "node", "left").select("cls", F.coalesce("label", "node").alias("component"))
    judged = rows.select("doc_id", "n_shingles", "cls").join(classes, "cls", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return judged.select("doc_id", "n_shingles", component.cast("long").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def kept_rows(docs: DataFrame, words: int = WORDS, percent: int = SIMILARITY) -> DataFrame:
    """One row of ``docs`` for each component, unchanged: the document whose id names it.

    Repeated rows of an id become one, that with the smallest text. Rows without an id all stay.
    """
    kept = near_duplicates(docs, words, percent).filter("kept and doc_id is not null").select("doc_id").distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("by"), row.alias("row"))
    once = rows.join(kept, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by("row", "by").alias("row")).select("row.*")
    return once.unionByName(docs.filter("doc_id is null"))
