"""Near copies by MinHash bands and an exact check.

``keys`` reads every text once: of 100 hash functions over a text's shingles the least values, five
to a band, as one key a band, and its fingerprint of operator 10, whose groups (linked over BK-trees) are one more key. Texts that share a key are joined with three of its texts: two whose order
differs from band to band, and the one that meets most others; of those pairs the Jaccard similarity of their shingles is computed.
That connects most copies. In the keys whose texts are not one component yet, each text outside the
main component is then held against all texts of other components by its shingles, in pairs of
blocks; of the links that a task finds it hands on a forest. So every pair that shares a key is
compared, or connected already, and no task's links are more than its texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Texts, Words, mixed, slim, staged
from .simhash import _LOWER, components, linked, simhash_texts

SHINGLE, SIMILAR = 5, 0.8
#: Of texts of similarity 0.8, 0.9996 share a key.
BANDS, ROWS = 20, 5
#: Texts of a bucket that are compared with as many others at once.
BLOCK = 1024

_random = np.random.default_rng(42)
_FACTORS = _random.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _random.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def shingles(column: pa.Array, shingle: int = SHINGLE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of texts: the number of the first, where each text's hashes begin and end, and the hashes.

    Letters A to Z count as small ones. A text of fewer words is one shingle; one without words has none.
    """
    for first, _, data, offsets in Texts(column).steps():
        words = Words(_LOWER[data], offsets)
        hashes = words.hashes()
        grams, whole = words.grams(hashes, shingle)
        at = np.flatnonzero(whole)
        n_words = np.diff(words.bounds)
        short = np.flatnonzero((n_words > 0) & (n_words < shingle))
        own = np.zeros(len(short), np.uint64)
        for j in range(shingle - 1):
            more = n_words[short] > j
            own[more] = mixed(own[more] * np.uint64(0xD6E8FEB86659FD93) + hashes[words.bounds[short[more]] + j])
        of = np.concatenate([words.text[at], short])
        order = np.argsort(of, kind="stable")
        yield first, np.searchsorted(of[order], np.arange(len(offsets))), np.concatenate([grams[at], own])[order]


def _least(grams: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
    """The least value of each hash function over runs of hashes, none of them empty."""
    for factor, term in zip(_FACTORS, _TERMS, strict=True):
        yield np.minimum.reduceat(grams * factor + term, bounds)


def keys(column: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """A key a band of each text, the same for all texts without words."""
    out = np.zeros((len(column), BANDS), np.uint64)
    for first, bounds, grams in shingles(column, shingle):
        full = np.flatnonzero(np.diff(bounds))
        if len(full):
            for i, least in enumerate(_least(grams, bounds[full])):
                out[first + full, i // ROWS] = mixed(out[first + full, i // ROWS] + least)
    return out.view(np.int64)


def _open_buckets(entries: DataFrame, comps: DataFrame) -> DataFrame:
    """band, key, t, comp and roles of the texts in buckets whose texts aren't all connected.

    ``entries``: band, key and t of the keys that several texts have; ``comps``: node and root. Most texts of a large bucket are in the component of its first one. Those
    need not meet each other: only the others meet them and each other, block by block. A role is a
    pair of blocks and a side.
    """
    entries = staged(entries.join(comps.withColumnRenamed("node", "t"), "t", "left").select("band", "key", "t", F.coalesce("root", "t").alias("comp")), "comps")
    mains = entries.groupBy("band", "key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min_by("comp", F.xxhash64("t", "band")).alias("main")).where("lo <> hi").select("band", "key", "main")
    left = entries.join(mains, ["band", "key"]).withColumn("other", F.col("comp") != F.col("main"))
    sizes = left.groupBy("band", "key").agg(F.count_if("other").alias("n_other"), F.count_if(~F.col("other")).alias("n_main"))
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    one = left.join(sizes, ["band", "key"]).withColumn("o", blocks("n_other")).withColumn("m", blocks("n_main"))
    own = F.pmod(F.xxhash64("t"), F.when(F.col("other"), F.col("o")).otherwise(F.col("m")).cast("long")).cast("int")
    one = one.withColumn("own", own)
    # Blocks of the others are numbered from 0, those of the main component from -1 down; the lesser one is the left side.
    role = lambda a, b, left: F.struct(a.alias("a"), b.alias("b"), left.alias("left"))
    up = lambda lo, hi: F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
    zero, yes, no = F.lit(0), F.lit(True), F.lit(False)
    of_main = F.transform(up(zero, F.col("o") - 1), lambda q: role(-1 - F.col("own"), q, yes))
    of_other = F.concat(
        F.transform(up(zero, F.col("m") - 1), lambda q: role(-1 - q, F.col("own"), no)),
        F.transform(up(F.col("own"), F.col("o") - 1), lambda q: role(F.col("own"), q, yes)),
        F.transform(up(zero, F.col("own")), lambda q: role(q, F.col("own"), no)),
    )
    return one.select("band", "key", "t", "comp", F.explode(F.when(F.col("other"), of_other).otherwise(of_main)).alias("role")).select("band", "key", "t", "comp", "role.*")


def _forest(similar: float):
    """Links of each pair of blocks that hold together all that are similar in it, of different components.

    A side's texts are sets of shingles; the other side's are laid end to end, and what each text has
    in common with all of them is one look-up and a sum a text.
    """

    def solve(sides: list[tuple]) -> set[tuple[int, int]]:
        (lt, lc, lg), (rt, rc, rg) = sides
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        sizes = np.array([len(g) for g in rg])
        some = np.flatnonzero(sizes)
        flat, ids = np.unique(np.concatenate([*lg, *rg]), return_inverse=True)
        bounds = np.cumsum([0, *[len(g) for g in lg]])
        other = ids[bounds[-1] :]
        begins = (np.cumsum(sizes) - sizes)[some]
        has, out = np.zeros(len(flat), bool), set()
        for i, (t, c) in enumerate(zip(lt.tolist(), lc.tolist(), strict=True)):
            mine = ids[bounds[i] : bounds[i + 1]]
            common = np.zeros(len(sizes), np.int64)
            if len(some):
                has[mine] = True
                common[some] = np.add.reduceat(has[other], begins, dtype=np.int64)
                has[mine] = False
            # With Jaccard similarity s, common / (all - common) >= s; 1e-9 for what division rounds.
            either = len(mine) + sizes - common
            for j in np.flatnonzero((rc != c) & (common >= either * similar - 1e-9)).tolist():
                x, y = find(c), find(int(rc[j]))
                if x != y:
                    root[max(x, y)] = min(x, y)
                    out.add((min(t, int(rt[j])), max(t, int(rt[j]))))
        return out

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slim()
        held: list[tuple] = []
        last = None

        def done() -> pa.RecordBatch:
            sides = [[r for r in held if r[2] == side] for side in (True, False)]
            found = solve([(np.array([r[0] for r in x]), np.array([r[1] for r in x]), [r[3] for r in x]) for x in sides]) if all(sides) else set()
            a, b = zip(*found, strict=True) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            grams = batch["grams"]
            ends, values = grams.offsets.to_numpy(), grams.values.to_numpy()
            columns = [batch[c].to_pylist() for c in ("band", "key", "a", "b", "t", "comp", "left")]
            for i, (*group, t, comp, left) in enumerate(zip(*columns, strict=True)):
                if held and group != last:
                    yield done()
                    held = []
                last = group
                held.append((t, comp, left, values[ends[i] : ends[i + 1]].copy()))
        if held:
            yield done()

    return work


def near_copies(docs: DataFrame, similar: float = SIMILAR, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and component_id (the smallest doc_id reachable over texts of Jaccard similarity
    ``similar`` at least) of every row.

    Texts without words, null ones too, are copies of each other. Repeated rows give repeated results;
    a null id is in its component, and is its component_id only if no other is. Very long texts are
    read whole. An empty table has no rows; other columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("t", F.xxhash64("text"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slim()
        for batch in batches:
            flat = pa.array(keys(batch.column(2), shingle).ravel())
            fp = pa.array(simhash_texts(batch.column(2)).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * BANDS), flat), fp], names=["doc_id", "t", "keys", "fp"])

    prints = staged(rows.select("doc_id", "t", "text").mapInArrow(read, "doc_id long, t long, keys array<long>, fp long"), "keys")
    first = staged(prints.groupBy("t").agg(F.min("doc_id").alias("least"), F.first("keys").alias("keys"), F.first("fp").alias("fp")), "texts")
    # A group of operator 10 is a key like any other, so what its fingerprints link is compared, or connected already.
    groups = components(linked(first.select("fp").distinct())).withColumnRenamed("node", "fp")
    grouped = first.select("t", "fp").join(groups, "fp", "left").select("t", F.lit(BANDS).alias("band"), F.coalesce("root", "fp").alias("key"))
    dealt = first.select("t", F.posexplode("keys").alias("band", "key")).unionByName(grouped)
    at = F.struct(F.xxhash64("t", "band").alias("o"), "t")
    # Staged, so that both sides of the join are dealt for it and a hot key can be split.
    ends = staged(dealt.groupBy("band", "key").agg(F.min(at).alias("low"), F.max(at).alias("high"), F.count("*").alias("n")).where("low.t <> high.t").select("band", "key", F.col("low.t").alias("low"), F.col("high.t").alias("high"), "n"), "ends")
    entries = staged(dealt.join(ends, ["band", "key"]), "entries")
    # The text that the others are copies of shares more keys with them than they do with each other.
    wide = entries.join(entries.groupBy("t").agg(F.sum("n").alias("met")), "t")
    hubs = staged(wide.groupBy("band", "key").agg(F.max(F.struct("met", "t")).alias("hub")).select("band", "key", F.col("hub.t").alias("hub")), "hubs")
    met = entries.join(hubs, ["band", "key"]).select("t", F.explode(F.array("low", "high", "hub")).alias("u")).where("t <> u")
    pairs = staged(met.select(F.least("t", "u").alias("a"), F.greatest("t", "u").alias("b")).distinct(), "pairs")

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slim()
        for batch in batches:
            for low, bounds, grams in shingles(batch.column(1), shingle):
                sets = [np.unique(grams[i:j]) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
                flat = np.concatenate(sets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, len(sets)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))], names=["t", "grams"])

    # Every text of a key that several have is in a pair.
    wanted = entries.select("t").distinct()
    sets = staged(rows.select("t", "text").join(wanted, "t", "left_semi").dropDuplicates(["t"]).mapInArrow(spell, "t long, grams array<long>"), "grams")

    x, y = (sets.select(F.col("t").alias(c), F.col("grams").alias(f"g_{c}")) for c in ("a", "b"))
    both = F.size(F.array_intersect("g_a", "g_b"))
    all_of = F.size("g_a") + F.size("g_b")
    # First every text against three of each key, which connects most copies; then, for the keys whose
    # texts are not one component, all that are left against all.
    links = staged(pairs.join(x, "a").join(y, "b").select("a", "b", both.alias("n"), all_of.alias("m")).where((F.col("m") == 0) | (F.col("n") >= (F.col("m") - F.col("n")) * similar - 1e-9)).select("a", "b"), "links")
    open_ = _open_buckets(entries.select("band", "key", "t"), components(links)).join(sets, "t")
    group = ["band", "key", "a", "b"]
    more = open_.select(*group, "t", "comp", "left", "grams").repartition(*group).sortWithinPartitions(*group).mapInArrow(_forest(similar), "a long, b long")
    links = links.union(staged(more.distinct(), "more"))
    roots = components(links).withColumnRenamed("node", "t")
    held = roots.join(first.select("t", "least"), "t")
    rooted = held.join(held.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("t", "component_id")
    named = staged(first.select("t", "least").join(rooted, "t", "left").select("t", F.coalesce("component_id", "least").alias("component_id")), "named")
    return prints.select("doc_id", "t").join(named, "t").select("doc_id", "component_id")
