"""SimHash near-duplicates by BK-trees.

``fingerprints`` reads every text once. ``linked`` finds which distinct fingerprints are within a
few bits of each other, and ``components`` joins linked ones into groups. Two fingerprints that
differ in at most r bits agree on at least two of r + 2 blocks of their bits, so the fingerprints
are dealt by each pair of blocks; those that agree on a pair form a shard. A shard is kept in
BK-trees of bounded size, whose children are keyed by their integer distance to the parent, and a
search follows only the edges within the radius of its own distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Texts, Words, staged

RADIUS = 4
#: Fingerprints in one BK-tree, and in one block of queries; a larger shard gets more of both.
TREE = 2048

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def simhash_texts(column: pa.Array, shingle: int = 4, seed: int = 42) -> np.ndarray:
    """One unsigned 64-bit fingerprint a text; a text without words has 0."""
    from xxhash import xxh64_intdigest

    texts, out = Texts(column), np.zeros(len(column), np.uint64)
    for first, end, data, offsets in texts.steps():
        words = Words(_LOWER[data], offsets)
        size = words.end - words.start
        if not len(size):
            continue
        # The words again, each followed by one space, so that a shingle is one run of bytes.
        begin = np.concatenate([[0], np.cumsum(size + 1)])
        line = np.full(begin[-1], 0x20, np.uint8)
        line[np.arange(begin[-1] - len(size)) + np.repeat(np.arange(len(size)), size)] = words.data[~SPACED[words.data]]
        line = line.tobytes()
        n_words = np.diff(words.bounds)
        n = np.where(n_words > 0, np.maximum(n_words - shingle + 1, 1), 0)
        of = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + words.bounds[:-1][of]
        to = np.minimum(at + shingle, words.bounds[1:][of])
        los, his = begin[at].tolist(), (begin[to] - 1).tolist()
        h = np.fromiter((xxh64_intdigest(line[a:b], seed) for a, b in zip(los, his, strict=True)), np.uint64, len(los))
        full = np.flatnonzero(n)
        heads = (np.cumsum(n) - n)[full]
        prints = np.zeros(len(full), np.uint64)
        for bit in range(64):
            ones = np.add.reduceat((h >> np.uint64(bit) & np.uint64(1)).astype(np.int32), heads)
            prints |= (2 * ones > n[full]).astype(np.uint64) << np.uint64(bit)
        out[first:end][full] = prints
    return out


SPACED = np.zeros(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = True


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row.

    A null, empty or blank text has fingerprint 0. A null id stays null; repeated rows stay; other
    columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(simhash_texts(batch.column(1), shingle, seed).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """Distinct 64-bit integers under the Hamming distance."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = values
        #: children[i]: {distance to i: child}
        self.children: list[dict[int, int]] = [{} for _ in values]
        listed = values.tolist()
        for i, value in enumerate(listed[1:], 1):
            at = 0
            while True:
                edge = (value ^ listed[at]).bit_count()
                child = self.children[at].get(edge)
                if child is None:
                    self.children[at][edge] = i
                    break
                at = child

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, int]]:
        """Which queries are within the radius of each node that has any: their numbers, the node."""
        stack = [(0, np.arange(len(queries)))] if len(self.values) else []
        while stack:
            node, of = stack.pop()
            far = np.bitwise_count(queries[of] ^ self.values[node])
            if len(near := of[far <= radius]):
                yield near, node
            for edge, child in self.children[node].items():
                if len(on := of[np.abs(far.astype(np.int16) - edge) <= radius]):
                    stack.append((child, on))


def forest(values: np.ndarray, queries: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (larger, smaller) between values and queries that hold together all that are linked."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    listed, nodes = queries.tolist(), values.tolist()
    for near, node in BKTree(values).within(queries, radius):
        a = root(nodes[node])
        for i in near.tolist():
            b = root(listed[i])
            if a != b:
                parent[max(a, b)] = a = min(a, b)
    return [(x, r) for x in list(parent) if (r := root(x)) != x]


def linked(prints: DataFrame, radius: int = RADIUS, tree: int = TREE) -> DataFrame:
    """Links (a, b) of distinct fingerprints ``fp`` of which the connected ones are those connected by
    links of at most ``radius`` bits.

    ``prints``: distinct longs in a column fp. Shards of one fingerprint have no links and go no
    further. A shard of more than ``tree`` fingerprints is dealt into trees and blocks of queries
    of that size, each pair of which is a task's work of its own; a tree is never larger.
    """
    blocks = radius + 2
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in pair) for pair in combinations(range(blocks), 2)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keys = F.array(*[F.struct(F.lit(i).cast("short").alias("table"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("bits")) for i, m in enumerate(masks)])
    dealt = prints.select("fp", F.explode(keys).alias("key")).select("fp", "key.*")
    sizes = dealt.groupBy("table", "bits").agg(F.count("*").alias("n")).where("n > 1")
    shards = dealt.join(sizes, ["table", "bits"])
    trees = F.greatest(F.ceil(F.col("n") / tree), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("fp"), trees.cast("long")).cast("int")
    # Block q meets the trees t <= q: every pair of fingerprints meets once, a block its own tree too.
    one = shards.withColumn("own", own).withColumn("last", trees - 1)
    roles = F.concat(
        F.transform(F.sequence(F.col("own"), F.col("last")), lambda q: F.struct(F.col("own").alias("tree"), q.alias("block"), F.lit(True).alias("node"))),
        F.transform(F.sequence(F.lit(0), F.col("own")), lambda t: F.struct(t.alias("tree"), F.col("own").alias("block"), F.lit(False).alias("node"))),
    )
    met = one.select("table", "bits", "fp", F.explode(roles).alias("role")).select("table", "bits", "fp", "role.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Reads its rows in the order of their shard, tree and block, each a run of rows."""
        kept: list[np.ndarray] = []

        def done(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            links: set[tuple[int, int]] = set()
            cuts = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1)) + 1
            for group in np.split(rows, cuts):
                node = group[:, 5] == 1
                if node.any() and not node.all():
                    pair = group[node, 4].view(np.uint64), group[~node, 4].view(np.uint64)
                    links.update(forest(*pair, radius))
            if links:
                a, b = np.array(list(links), np.uint64).T
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            rows = np.stack([np.asarray(batch.column(c).cast(pa.int64())) for c in ("table", "bits", "tree", "block", "fp", "node")], axis=1)
            if not len(rows):
                continue
            changes = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1))
            if kept and (rows[0, :4] != kept[-1][-1, :4]).any():
                yield from done(np.concatenate(kept))
                kept = []
            if len(changes):
                cut = changes[-1] + 1
                yield from done(np.concatenate([*kept, rows[:cut]]))
                kept = [rows[cut:]]
            else:
                kept.append(rows)
        if kept:
            yield from done(np.concatenate(kept))

    group = ["table", "bits", "tree", "block"]
    return met.withColumn("node", F.col("node").cast("int")).repartition(*group).sortWithinPartitions(*group).mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """node and root for every node of the links (a, b): root is the same for all that are connected.

    Alternates the large-star and small-star steps until nothing changes. Each round moves the
    links closer to stars, so a chain of n nodes takes about log n rounds; the rounds' tables are
    kept in the shared folder. Links of a node with itself are dropped; null ends must not occur.
    """
    edges = staged(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = staged(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e")).select(F.col("e.u").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct()
        edges = staged(small, "small")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = 4, seed: int = 42, tree: int = TREE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over links) of every row.

    All texts without words have fingerprint 0 and are linked like any other. Repeated rows give
    repeated results; a null id is in its component, and is its component_id only if no other is.
    """
    prints = staged(fingerprints(docs, shingle, seed, id_col, text_col), "prints")
    first = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "first")
    roots = components(linked(first.select("fp"), radius, tree)).withColumnRenamed("node", "fp")
    # Most fingerprints have no link: only the linked ones are grouped by root.
    held = roots.join(first, "fp")
    rooted = held.join(held.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    # Staged, so that both sides of the last join are dealt for it and a hot fingerprint can be split.
    named = staged(first.join(rooted, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "named")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")
