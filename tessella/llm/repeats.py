"""Suffix-array dedup: every byte of a 400-byte string that also starts anywhere else goes.

Windows of 400 bytes choose a seed each, the 64-byte string in them with the least hash, so equal
windows choose equal seeds. Seeds that come once lie in no repeated window. Around each other seed
all windows that chose it are cut out as one context, and contexts are dealt to shards by seed. A
shard sorts the suffixes of its contexts by Larsson and Sadakane's refinement, finds the common
prefixes of neighbours by Kasai's rule, and so knows which windows come twice in it. A seed with
too many contexts is dealt to several shards; what each of them sees is merged by binary search in
the sorted fingerprints of the windows.

Texts are held once however many copies there are, in a table bucketed by their hash, so that only
seeds, contexts and spans travel.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import STEP_BYTES, Texts, bucketed, mixed, power_tables, staged

#: Bytes that must come again, and bytes of a seed.
WINDOW, SEED = 400, 64
#: Contexts of one seed that one shard takes, about; more are dealt to several.
HOT = 4096
#: Bytes of contexts that are sorted together, unless the contexts of one seed are more.
SHARD_BYTES = 3 << 20
#: Fingerprints that one task merges, about, and that one row holds.
MERGE_ROWS, RUN_ROWS = 1 << 20, 1 << 15
MARK = [("f1", np.int64), ("f2", np.int64), ("t1", np.int64), ("t2", np.int64), ("start", np.int64)]

_LEVELS = np.array([1 << 8 * k for k in range(8)], np.uint64)


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number, zeros past the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), ">u8", padded, strides=(1,))


def suffix_array(data: np.ndarray) -> np.ndarray:
    """The places of ``data`` in the order of the suffixes that begin there.

    Refinement after Larsson and Sadakane: places sorted by eight bytes form groups, and a group is
    sorted by the groups of the places h further on, which doubles h; groups of one are done.
    """
    n = len(data)
    keys = _eights(data)[:n].astype(np.uint64)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    sizes = np.diff(np.append(heads, n))
    # The rank of a place is the last index of its group.
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(heads + sizes - 1, sizes)
    rest = np.flatnonzero(np.repeat(sizes, sizes) > 1)
    h = 8
    while len(rest):
        places = order[rest]
        ahead = places + h
        # A suffix that ends before comes first; of two whose ends the zeros behind them hid, the shorter.
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 8, 7 - np.minimum(ahead - n, 7))
        keys = rank[places] << 32 | second
        by = np.argsort(keys, kind="stable")
        places, keys = places[by], keys[by]
        order[rest] = places
        heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        sizes = np.diff(np.append(heads, len(keys)))
        rank[places] = np.repeat(rest[heads + sizes - 1], sizes)
        rest = rest[np.repeat(sizes, sizes) > 1]
        h *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int, lane: int = 256) -> np.ndarray:
    """For each index of ``order`` the bytes in common with the one before, up to ``most``.

    Kasai's rule: what a place has in common with its neighbour, less one, the next place has with
    its own. Lanes of ``lane`` places take a step together.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    eights, out = _eights(data), np.zeros(n, np.int32)
    at = np.arange(0, n, lane)
    common = np.zeros(len(at), np.int64)
    for _ in range(lane):
        at, common = at[at < n], common[at < n]
        common = np.maximum(common - 1, 0)
        other = before[at]
        common[other < 0] = 0
        room = np.minimum(most, n - np.maximum(at, other))
        rest = np.flatnonzero((other >= 0) & (common < room))
        while len(rest):
            c = common[rest]
            same = 8 - np.searchsorted(_LEVELS, eights[at[rest] + c].astype(np.uint64) ^ eights[other[rest] + c].astype(np.uint64), "right")
            common[rest] = c + same
            rest = rest[(same == 8) & (c + same < room[rest])]
        common = np.minimum(common, room)
        common[other < 0] = 0
        out[at] = common
        at = at + 1
    return out[order]


def _rolling(data: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each ``size`` bytes in a row."""
    power, inverse = power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    values = data.astype(np.uint64) + np.uint64(1)
    np.cumsum((mixed(values + np.uint64(salt)) if salt else values) * power[: len(data)], out=sums[1:])
    n = len(data) - size + 1
    return mixed((sums[size:] - sums[:n]) * inverse[:n] + np.uint64(salt))


def seeds(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """Of some texts the runs of windows that choose one seed: text, first window, last window, hash."""
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    width = window - seed + 1
    if len(data) < window:
        return none
    grams = _rolling(data, seed)
    # The place in the low bits, so of equal hashes the first one is chosen.
    packed = grams & np.uint64(~0xFFFFFF & (1 << 64) - 1) | np.arange(len(grams), dtype=np.uint64)
    rows = -(-len(grams) // width)
    block = np.full((rows, width), ~np.uint64(0))
    block.reshape(-1)[: len(grams)] = packed
    ahead = np.minimum.accumulate(block, axis=1).reshape(-1)
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    n = len(data) - window + 1
    chosen = (np.minimum(back[:n], ahead[width - 1 : width - 1 + n]) & np.uint64(0xFFFFFF)).astype(np.int64)
    text = np.searchsorted(offsets, np.arange(n), "right") - 1
    whole = offsets[text + 1] - np.arange(n) >= window
    new = np.append(True, (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1])) & whole
    first = np.flatnonzero(new)
    # A run ends before the next one, or with the last whole window of its text.
    last = np.minimum(np.append(first[1:], n) - 1, offsets[text[first] + 1] - window)
    return text[first], first - offsets[text[first]], last - offsets[text[first]], grams[chosen[first]]


SEEDS = "t1 long, t2 long, first long, more int, h long, twice boolean"


def _own_repeats(data: np.ndarray, begin: np.ndarray, size: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of some strings those that are equal to another of the same text, and those that are the first of their kind there."""
    power, inverse = power_tables(len(data) + 1)
    keys = [text.astype(np.uint64), size.astype(np.uint64)]
    for salt in (0, 77):
        values = data.astype(np.uint64) + np.uint64(1)
        sums = np.append(np.uint64(0), np.cumsum((mixed(values + np.uint64(salt)) if salt else values) * power[: len(data)]))
        keys.append((sums[begin + size] - sums[begin]) * inverse[begin])
    _, one, kind, copies = np.unique(np.stack(keys, axis=1), axis=0, return_index=True, return_inverse=True, return_counts=True)
    first = np.zeros(len(begin), bool)
    first[one] = True
    return copies[kind.reshape(-1)] > 1, first


def _seeds_of(window: int, seed: int):
    """Rows of ``SEEDS``: of the runs of a text that are equal to others in it one goes on, marked twice; the spans of all of them come without a hash."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, data, offsets in Texts(batch["text"]).steps():
                # A long text goes in overlapping parts; a run that is cut is two runs.
                for a in range(0, len(data), 4 * STEP_BYTES) if len(offsets) == 2 else [0]:
                    part = data[a : a + 4 * STEP_BYTES + window - 1] if len(offsets) == 2 else data
                    bounds = np.array([0, len(part)]) if len(offsets) == 2 else offsets
                    text, first, last, grams = seeds(part, bounds, window, seed)
                    if not len(text):
                        continue
                    twice, one = _own_repeats(part, first + bounds[text], last - first + window, text)
                    # Spans that touch are one.
                    t, f, e = text[twice], first[twice], last[twice]
                    new = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (f[1:] > e[:-1] + window)))[: len(t)]
                    ends = np.append(new[1:] - 1, len(t) - 1)[: len(new)]
                    rows = pa.array(np.append(text[one], t[new]) + lo)
                    first_, last_ = np.append(first[one], f[new]), np.append(last[one], e[ends])
                    h = pa.array(np.append(grams[one].view(np.int64), np.zeros(len(new), np.int64)), mask=np.arange(len(rows)) >= one.sum())
                    yield pa.RecordBatch.from_arrays([batch["t1"].take(rows), batch["t2"].take(rows), pa.array(first_ + a), pa.array((last_ - first_).astype(np.int32)), h, pa.array(np.append(twice[one], np.ones(len(new), bool)))], names=["t1", "t2", "first", "more", "h", "twice"])

    return work


def _contexts_of(window: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = Texts(batch["text"])
            ends, runs = batch["runs"].offsets.to_numpy(), batch["runs"].values
            more, first = runs.field("more").to_numpy(), runs.field("first").to_numpy()
            for row in range(len(batch)):
                text = texts.data[texts.offsets[row] : texts.offsets[row + 1]]
                for lo in range(ends[row], ends[row + 1], 4096):
                    hi = min(lo + 4096, ends[row + 1])
                    starts, size = first[lo:hi], more[lo:hi] + window
                    bounds = np.append(0, np.cumsum(size))
                    cut = text[np.arange(bounds[-1]) + np.repeat(starts - bounds[:-1], size)]
                    contexts = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(cut)])
                    same = pa.array(np.full(hi - lo, row))
                    part = runs.slice(lo, hi - lo)
                    yield pa.RecordBatch.from_arrays([batch["t1"].take(same), batch["t2"].take(same), *[part.field(c) for c in ("first", "h", "n_seed", "twice")], contexts], names=["t1", "t2", "first", "h", "n_seed", "twice", "context"])

    return work


class _Shard:
    """The contexts of some seeds, each with the places it is at."""

    def __init__(self) -> None:
        self.held: dict[bytes, list[tuple]] = {}
        self.copies: dict[bytes, int] = {}
        self.hot: dict[bytes, bool] = {}
        self.size = 0

    def add(self, context: bytes, place: tuple, twice: bool, hot: bool) -> None:
        if context not in self.held:
            self.held[context] = []
            self.hot[context] = hot
            self.size += len(context)
        self.held[context].append(place)
        self.copies[context] = self.copies.get(context, 0) + 1 + twice

    def solve(self, window: int) -> tuple[list[tuple], np.ndarray]:
        """Spans (t1, t2, from, to) of the windows that come twice here, and of hot seeds a sorted run of ``MARK``: a fingerprint of each distinct window, with its place if it comes once."""
        spans, marks = [], np.empty(0, MARK)
        contexts, places = [*self.held], [*self.held.values()]
        sizes = np.array([len(c) for c in contexts])
        data = np.frombuffer(b"".join(contexts), np.uint8)
        begins, starts = np.cumsum(sizes) - sizes, sizes - window + 1
        order = suffix_array(data)
        apart = common_prefixes(data, order, window) < window
        kind = np.empty(len(data), np.int32)
        kind[order] = np.cumsum(apart)
        # Of the places of each kind only those where a window begins count, copies of a context again.
        of = np.repeat(np.arange(len(contexts)), starts)
        at = np.repeat(begins, starts) + np.arange(len(of)) - np.repeat(np.cumsum(starts) - starts, starts)
        kinds = kind[at]
        copies = np.array([self.copies[c] for c in contexts])
        twice = np.bincount(kinds, weights=copies[of])[kinds] > 1
        edges = np.flatnonzero(np.diff(np.concatenate([[False], twice, [False]]).astype(np.int8)))
        firsts = np.cumsum(starts) - starts
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            # A run of windows may go over from one context to the next.
            for c in range(of[a], of[b - 1] + 1):
                lo, hi = max(a - firsts[c], 0), min(b - firsts[c], starts[c])
                spans += [(t1, t2, first + int(lo), first + int(hi) - 1 + window) for t1, t2, first in places[c]]
        hot = np.array([self.hot[c] for c in contexts])
        if hot.any():
            _, one = np.unique(kinds, return_index=True)
            one = one[hot[of[one]]]
            marks = np.empty(len(one), MARK)
            marks["f1"], marks["f2"] = (_rolling(data, window, salt)[at[one]].view(np.int64) for salt in (0, 77))
            marks["t1"], marks["t2"], first = np.array([places[c][0] for c in of[one]], np.int64).reshape(-1, 3).T
            marks["start"] = np.where(twice[one], -1, first + one - firsts[of[one]])
            marks = marks[np.argsort(marks["f1"])]
        return spans, marks


FOUND = "t1 long, t2 long, start long, end long, n_marks long, run binary"


def _repeats_of(window: int, shard_bytes: int, hot: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, last = _Shard(), None

        def solved() -> pa.RecordBatch:
            spans, marks = shard.solve(window)
            runs = [marks[i : i + RUN_ROWS] for i in range(0, len(marks), RUN_ROWS)]
            rows = [(*s, None, None) for s in spans] + [(None, None, None, None, len(r), r.tobytes()) for r in runs]
            columns = zip(*rows, strict=True) if rows else [()] * 6
            kinds = [*[pa.int64()] * 5, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in FOUND.split(", ")])

        for batch in batches:
            for h, salt, n_seed, t1, t2, first, twice, context in zip(*(batch[c].to_pylist() for c in ("h", "salt", "n_seed", "t1", "t2", "first", "twice", "context")), strict=True):
                if (h, salt) != last and shard.size >= shard_bytes:
                    yield solved()
                    shard = _Shard()
                last = (h, salt)
                shard.add(context, (t1, t2, first), twice, n_seed > hot)
        if shard.size:
            yield solved()

    return work


def _cut_of(ranges: int):
    """Each sorted run cut into ranges of fingerprints, their bounds found by binary search."""
    bounds = np.array([(1 << 64) * i // ranges - (1 << 63) for i in range(ranges)] + [(1 << 63) - 1], np.int64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch["run"]:
                run = np.frombuffer(data.as_buffer(), MARK)
                at = np.searchsorted(run["f1"], bounds)
                at[-1] = len(run)
                some = np.flatnonzero(np.diff(at))
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([run[at[i] : at[i + 1]].tobytes() for i in some], pa.binary())], names=["range", "run"])

    return work


def _merge_of(window: int):
    """The runs of a range merged: of windows that two of them have, the places that are left."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for i, data in zip(batch["range"].to_pylist(), batch["run"], strict=True):
                held.setdefault(i, []).append(np.frombuffer(data.as_buffer(), MARK))
        for i in [*held]:
            runs = held.pop(i)
            while len(runs) > 1:
                runs = [_merged(*runs[i : i + 2]) if i + 1 < len(runs) else runs[i] for i in range(0, len(runs), 2)]
            run = runs[0]
            if (run["f1"][1:] == run["f1"][:-1]).any():
                run = run[np.lexsort((run["f2"], run["f1"]))]
            same = (run["f1"][1:] == run["f1"][:-1]) & (run["f2"][1:] == run["f2"][:-1])
            got = run[(np.append(same, False) | np.append(False, same)) & (run["start"] >= 0)]
            yield pa.RecordBatch.from_arrays([pa.array(got["t1"]), pa.array(got["t2"]), pa.array(got["start"]), pa.array(got["start"] + window)], names=["t1", "t2", "start", "end"])

    return work


def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two runs sorted by f1 as one: a binary search in the one gives the place of each row of the other."""
    out = np.empty(len(a) + len(b), MARK)
    at = np.searchsorted(a["f1"], b["f1"]) + np.arange(len(b))
    mine = np.ones(len(out), bool)
    mine[at] = False
    out[at], out[mine] = b, a
    return out


def _kept_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, spans = Texts(batch["text"]), batch["spans"]
        ends, begin, end = spans.offsets.to_numpy(), spans.values.field("start").to_numpy(), spans.values.field("end").to_numpy()
        for row in range(len(batch)):
            text = texts.data[texts.offsets[row] : texts.offsets[row + 1]]
            steps = np.zeros(len(text) + 1, np.int32)
            np.add.at(steps, begin[ends[row] : ends[row + 1]], 1)
            np.add.at(steps, end[ends[row] : ends[row + 1]], -1)
            gone = np.cumsum(steps[:-1]) > 0
            kept = text[~gone].tobytes()
            n_spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[0])
            yield pa.RecordBatch.from_arrays([batch["t1"].slice(row, 1), batch["t2"].slice(row, 1), pa.array([int(gone.sum())], pa.int64()), pa.array([n_spans], pa.int64()), pa.array([hashlib.sha256(kept).hexdigest()]), pa.array([kept], pa.binary())], names=["t1", "t2", "n_removed", "n_spans", "kept_sha256", "kept"])


def _prints(text: str) -> list[Column]:
    """128 bits of a text."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), F.col(text)).alias("t2")]


def long_texts(docs: DataFrame, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """t1, t2, text and copies: the distinct texts of at least ``window`` bytes, bucketed by their hash."""
    given = docs.select(F.col(text_col).cast("string").alias("text")).where(F.octet_length("text") >= window)
    return bucketed(given.select("text", *_prints("text")).groupBy("t1", "t2").agg(F.first("text").alias("text"), F.count("*").alias("copies")), "texts", ["t1", "t2"])


def repeated_spans(texts: DataFrame, window: int = WINDOW, seed: int = SEED, hot: int = HOT, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """t1, t2, start and end of spans that cover just the repeated windows of distinct texts; they may overlap."""
    found = staged(texts.select("t1", "t2", "text").mapInArrow(_seeds_of(window, seed), SEEDS), "seeds")
    again = found.where("h is not null").groupBy("h").agg(F.count("*").alias("n_seed")).where("n_seed > 1")
    runs = found.join(again, "h").groupBy("t1", "t2").agg(F.collect_list(F.struct("first", "more", "h", "n_seed", "twice")).alias("runs"))
    cut = texts.select("t1", "t2", "text").join(runs.hint("shuffle_hash"), ["t1", "t2"]).select("t1", "t2", "text", "runs")
    contexts = cut.mapInArrow(_contexts_of(window), "t1 long, t2 long, first long, h long, n_seed long, twice boolean, context binary")
    # Equal contexts go to one shard, however many shards their seed has.
    salt = F.when(F.col("n_seed") > hot, F.pmod(F.xxhash64("context"), F.ceil(F.col("n_seed") / hot))).otherwise(0)
    dealt = contexts.withColumn("salt", salt).repartition("h", "salt").sortWithinPartitions("h", "salt")
    solved = staged(dealt.mapInArrow(_repeats_of(window, shard_bytes, hot), FOUND), "repeats")
    runs = solved.where("run is not null")
    ranges = 1 + runs.agg(F.coalesce(F.sum("n_marks"), F.lit(0))).first()[0] // MERGE_ROWS
    merged = runs.select("run").mapInArrow(_cut_of(ranges), "range int, run binary").repartitionById(ranges, "range").mapInArrow(_merge_of(window), "t1 long, t2 long, start long, end long")
    own = found.where("h is null").select("t1", "t2", F.col("first").alias("start"), (F.col("first") + F.col("more") + window).alias("end"))
    return solved.where("run is null").select("t1", "t2", "start", "end").unionByName(merged).unionByName(own)


def remove_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED, hot: int = HOT, shard_bytes: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: its id, n_bytes, n_removed, n_spans, kept_sha256, and kept, the bytes that stay.

    A byte goes if a string of ``window`` bytes that covers it also starts at another place, in the same
    text or another; strings don't cross from text to text, and are judged on the texts as given, so
    all of them go and not all but one. n_spans counts the longest removed runs. What stays need not be
    valid UTF-8.

    Null texts are empty; texts shorter than ``window`` stay whole. Rows with equal texts, whether of one
    id or several, are copies of each other, so such texts go whole. Very long texts are taken whole,
    their windows in overlapping parts. An empty table gives no rows. Other columns don't come along,
    whatever they are called.
    """
    texts = long_texts(docs, window, text_col)
    spans = repeated_spans(texts, window, seed, hot, shard_bytes).groupBy("t1", "t2").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    held = texts.where("copies = 1").select("t1", "t2", "text").join(spans.hint("shuffle_hash"), ["t1", "t2"]).select("t1", "t2", "text", "spans")
    kept = held.mapInArrow(_kept_of, "t1 long, t2 long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    whole = texts.where("copies > 1").select("t1", "t2", F.lit(None).cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(""), 256).alias("kept_sha256"), F.lit(b"").alias("kept"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    given = docs.select(F.col(id_col), text.alias("text_")).select(id_col, F.octet_length("text_").cast("long").alias("n_bytes"), F.sha2("text_", 256).alias("all_sha256"), F.encode("text_", "utf-8").alias("all_"), *_prints("text_"))
    met = given.join(kept.unionByName(whole), ["t1", "t2"], "left")
    touched = F.col("n_spans").isNotNull()
    return met.select(
        id_col,
        "n_bytes",
        F.when(touched, F.coalesce("n_removed", "n_bytes")).otherwise(0).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"),
        F.coalesce("kept_sha256", "all_sha256").alias("kept_sha256"),
        F.when(touched, F.col("kept")).otherwise(F.col("all_")).alias("kept"),
    )
