"""Phrase collocations by suffix-sigma: one shuffle of truncated suffixes, one stack a task.

Every word begins one suffix of at most ``max_n`` words within its piece. Suffixes are counted where
they are read, then dealt by language and first word, a word that many suffixes begin with being
split by the words after it: the bounds are quantiles of a sample, and only balance depends on
them. A task sorts its suffixes reverse-lexicographically, so that those with a common prefix
stand together, and one stack of open prefixes counts all of them at once. Prefixes at the
borders of a task are partial, and are summed in an aggregation that is small. The parts of a
phrase are phrases themselves, joined afterwards.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import STEP_BYTES, Texts, staged

MAX_N = 4
#: Phrases that come less often are no candidates.
LEAST = 30
#: Of a longer candidate's count over its part's, in hundredths: from here on the part adds nothing.
COVER = 80
TOP = 2_000
UNKNOWN = "und"

#: Bytes of suffixes that one task sorts, about; and that one task counts before it hands them on.
TASK_BYTES, BLOCK_BYTES = 40 << 20, 16 << 20
#: Suffixes of the sample that the bounds are made from, and documents it is drawn from, about.
SAMPLE, SAMPLE_DOCS = 50_000, 4_000
#: Words whose suffixes are built at once.
STEP_WORDS = 1 << 16

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
BREAKS, BLANKS = np.zeros(256, bool), np.zeros(256, bool)
BREAKS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
BLANKS[[0x20, 0x09]] = True
#: Ends each word of a suffix: no word holds it.
END = 0x0A

BLOCK = "part int, lang string, n_rows long, size long, data binary, lengths binary, counts binary"


def suffixes(data: np.ndarray, offsets: np.ndarray, max_n: int = MAX_N) -> Iterator[pa.Array]:
    """The suffixes of all words of some texts, in runs: words in lower case, each with an ``END``."""
    data = LOWER[data]
    split = BREAKS[data]
    solid = ~(split | BLANKS[data])
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    begins = offsets[:-1][offsets[:-1] < len(data)]
    first[begins] = solid[begins]
    start = np.flatnonzero(first)
    if not len(start):
        return
    # Words of one piece have as many breaks and texts before them.
    before = np.cumsum(split, dtype=np.int64)[start] + np.searchsorted(offsets, start, "right")
    heads = np.flatnonzero(np.diff(before, prepend=-1))
    last = np.repeat(np.append(heads[1:], len(start)) - 1, np.diff(np.append(heads, len(start))))
    end = np.minimum(np.arange(len(start)) + max_n - 1, last)
    word = np.cumsum(first, dtype=np.int64)[solid] - 1
    flat = np.full(len(word) + len(start), END, np.uint8)
    flat[np.arange(len(word)) + word] = data[solid]
    bounds = np.append(0, np.cumsum(np.bincount(word, minlength=len(start)) + 1))
    for lo in range(0, len(start), STEP_WORDS):
        hi = min(lo + STEP_WORDS, len(start))
        a = bounds[lo:hi]
        yield _strings(flat, a, bounds[end[lo:hi] + 1] - a)


def _strings(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Strings of ``flat`` by start and length."""
    ends = np.append(0, np.cumsum(lengths))
    where = np.arange(ends[-1]) + np.repeat(starts - ends[:-1], lengths)
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(flat[where])])


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Language, bytes and offsets of runs of a batch's texts."""
    for lang in batch["lang"].unique():
        mine = batch.filter(pc.equal(batch["lang"], lang))
        for _, _, data, offsets in Texts(mine["text"]).steps():
            for lo, hi in _cuts(data) if len(offsets) == 2 else [(0, len(data))]:
                yield lang.as_py(), data[lo:hi], np.array([0, hi - lo]) if len(offsets) == 2 else offsets


def _cuts(data: np.ndarray, most: int = 2 * STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of whole pieces of one text, of at most ``most`` bytes unless a piece is longer."""
    at = 0
    while at < len(data):
        end = min(at + most, len(data))
        while end < len(data) and not (stops := np.flatnonzero(BREAKS[data[at:end]])).size:
            end = min(end + most, len(data))
        end = len(data) if end == len(data) else at + int(stops[-1]) + 1
        yield at, end
        at = end


def _buffers(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of large binaries."""
    _, offsets, data = strings.buffers()
    ends = np.frombuffer(offsets, np.int64)[strings.offset : strings.offset + len(strings) + 1]
    return ends, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def _blocks(lang: str, held: list[pa.Array], bounds: list[tuple[str, bytes]]) -> Iterator[tuple]:
    """The suffixes counted and sorted, cut at the bounds: rows of ``BLOCK``."""
    counted = pc.value_counts(pa.chunked_array(held))
    values, counts = counted.field("values"), counted.field("counts")
    order = pc.array_sort_indices(values)
    values, counts = values.take(order), counts.take(order).to_numpy(zero_copy_only=False).astype(np.int32)
    lo, hi = (side(bounds, lang, key=lambda b: b[0]) for side in (bisect.bisect_left, bisect.bisect_right))
    squeezed = lambda x: pa.compress(x.tobytes(), "zstd", asbytes=True)
    at = 0
    for part in range(lo, hi + 1):
        to = len(values) if part == hi else bisect.bisect_left(range(len(values)), bounds[part][1], lo=at, key=lambda k: values[k].as_py())
        if to > at:
            ends, data = _buffers(values.slice(at, to - at))
            yield part, lang, to - at, int(ends[-1] - ends[0]), squeezed(data[ends[0] : ends[-1]]), squeezed(np.diff(ends).astype(np.int32)), squeezed(counts[at:to])
        at = to


#: From how on a number has another byte.
_BYTES = np.array([1 << 8 * k for k in range(8)], np.uint64)


def _common(ends: np.ndarray, data: np.ndarray) -> np.ndarray:
    """How many bytes each string has in common with the one before it; 0 for the first."""
    lengths = np.diff(ends)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(padded) - 7,), ">u8", padded, strides=(1,))
    common, most = np.zeros(len(lengths), np.int64), np.append(0, np.minimum(lengths[1:], lengths[:-1]))
    rest = np.arange(1, len(lengths))
    while len(rest):
        differ = eights[ends[rest] + common[rest]].astype(np.uint64) ^ eights[ends[rest - 1] + common[rest]].astype(np.uint64)
        same = 8 - np.searchsorted(_BYTES, differ, "right")
        common[rest] += same
        rest = rest[(same == 8) & (common[rest] < most[rest])]
    return np.minimum(common, most)


def count_prefixes(strings: pa.Array, counts: np.ndarray, least: int) -> Iterator[tuple[int, bytes, int]]:
    """(words, prefix, count) of the prefixes of sorted, distinct suffixes, from ``least`` on.

    Those that the first or the last suffix begins with may go on in another task, and come whatever
    their count; so does the empty prefix.
    """
    ends, data = _buffers(strings)
    ends, data = ends - ends[0], data[ends[0] : ends[-1]]
    stops = np.flatnonzero(data == END) + 1
    firsts = np.searchsorted(stops, ends[:-1], "right")
    depths = np.append(firsts[1:], len(stops)) - firsts
    shared = np.searchsorted(stops, ends[:-1] + _common(ends, data), "right") - firsts
    stack, edge, depth = [0] * (int(depths.max()) + 1), int(depths[0]), 0
    prefix = lambda row, d: data[ends[row] : stops[firsts[row] + d - 1]].tobytes()
    row = 0
    for row, (common, deep, n) in enumerate(zip(shared.tolist(), depths.tolist(), counts.tolist(), strict=True)):
        while depth > common:
            count = stack[depth]
            if count >= least or depth <= edge:
                yield depth, prefix(row - 1, depth), count
            stack[depth] = 0
            depth -= 1
            stack[depth] += count
        if common < edge and row:
            edge = common
        depth = deep
        stack[depth] += n
    while depth:
        yield depth, prefix(row, depth), stack[depth]
        depth -= 1
        stack[depth] += stack[depth + 1]
    yield 0, b"", stack[0]


def frequent(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST, text_col: str = "text", lang_col: str = "lang", task_bytes: int = TASK_BYTES) -> DataFrame:
    """lang, n_words, phrase and n of all phrases of 1 to ``max_n`` words with n >= ``least``; and per lang the number of words, as n_words 0."""
    given = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).cast("string").alias("text")).where("length(text) > 0")
    n_docs, size = given.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    drawn = given.sample(min(1.0, SAMPLE_DOCS / n_docs), 1) if n_docs > SAMPLE_DOCS else given
    rate = min(1.0, SAMPLE / max(1, size / 5 * min(1.0, SAMPLE_DOCS / max(1, n_docs))))
    parts = max(1, -(-size * max_n // task_bytes), min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size * max_n // (1 << 20))))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw = np.random.default_rng(1)
        for batch in batches:
            for lang, data, offsets in _by_lang(batch):
                for run in suffixes(data, offsets, max_n):
                    some = run.filter(pa.array(draw.random(len(run)) < rate))
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), some.cast(pa.binary())], names=["lang", "suffix"])

    seen = sorted((r["lang"], bytes(r["suffix"])) for r in drawn.mapInArrow(sample, "lang string, suffix binary").collect())
    cuts = [seen[len(seen) * i // parts] for i in range(1, parts)] if seen else []
    bounds = sorted({*cuts})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[pa.Array]] = {}
        sizes: dict[str, int] = {}

        def out(lang: str) -> Iterator[pa.RecordBatch]:
            sizes.pop(lang)
            columns = zip(*_blocks(lang, held.pop(lang), bounds), strict=True)
            kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in BLOCK.split(", ")])

        for batch in batches:
            for lang, data, offsets in _by_lang(batch):
                for run in suffixes(data, offsets, max_n):
                    held.setdefault(lang, []).append(run)
                    sizes[lang] = sizes.get(lang, 0) + run.nbytes
                    if sum(sizes.values()) >= BLOCK_BYTES:
                        yield from out(max(sizes, key=sizes.get))
        for lang in [*held]:
            yield from out(lang)

    def stack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[pa.Array, np.ndarray]]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                lengths = np.frombuffer(pa.decompress(r["lengths"], r["n_rows"] * 4, "zstd"), np.int32)
                strings = pa.Array.from_buffers(pa.large_binary(), r["n_rows"], [None, pa.py_buffer(np.append(0, np.cumsum(lengths, dtype=np.int64))), pa.decompress(r["data"], r["size"], "zstd")])
                held.setdefault(r["lang"], []).append((strings, np.frombuffer(pa.decompress(r["counts"], r["n_rows"] * 4, "zstd"), np.int32)))
        for lang in [*held]:
            blocks = held.pop(lang)
            values, counts = _merged(blocks)
            found = [(lang, d, p[:-1].replace(b"\n", b" "), n) for d, p, n in count_prefixes(values, counts, least)]
            cols = [*zip(*found, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary()).cast(pa.string()), pa.array(cols[3], pa.int64())], names=["lang", "n_words", "phrase", "n"])

    dealt = given.mapInArrow(count, BLOCK).repartitionById(parts, "part")
    counted = dealt.mapInArrow(stack, "lang string, n_words int, phrase string, n long")
    return counted.groupBy("lang", "n_words", "phrase").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("n_words") == 0))


def _merged(blocks: list[tuple[pa.Array, np.ndarray]]) -> tuple[pa.Array, np.ndarray]:
    """The distinct suffixes of all blocks, reverse-lexicographically, with the sums of their counts."""
    values = pa.concat_arrays([b[0] for b in blocks])
    counts = np.concatenate([b[1] for b in blocks]).astype(np.int64)
    blocks.clear()
    order = pc.array_sort_indices(values, order="descending").to_numpy()
    values, counts = values.take(pa.array(order)), counts[order]
    ends, data = _buffers(values)
    lengths = np.diff(ends)
    new = (_common(ends, data) < lengths) | (np.append(-1, lengths[:-1]) != lengths)
    new[0] = True
    heads = np.flatnonzero(new)
    return values.filter(pa.array(new)), np.add.reduceat(counts, heads)


def _exact(column: Column) -> Column:
    return column.cast("decimal(19,0)")


def collocations(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST, cover: int = COVER, top: int = TOP, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: the first ``top`` phrases of each language.

    Letters A to Z count as small; pieces end at ``. , ; : ! ?`` and line breaks. A phrase of 2 to
    ``max_n`` words that comes ``a`` >= ``least`` times is a candidate. Of its cuts into two parts,
    that come l and r times, the one with the least floor(2000000 * a / (l + r)) counts, of equal
    ones the first. A candidate inside a longer one that comes at least ``cover`` hundredths as often
    is dropped. Ties go to the larger a, then to the phrase by its bytes.

    Null texts are empty, a null language is ``und``; an empty table or one without candidates gives
    no rows. Repeated rows count each time. Very long texts are taken whole, in runs of words. Only
    text and language are read, so other columns may have any names.
    """
    known = staged(frequent(docs, max_n, least, text_col, lang_col), "phrases")
    words = F.split("phrase", " ")
    part = lambda lo, n: F.array_join(F.slice("words", lo, n), " ")
    candidates = known.where("n_words >= 2").select("lang", "n_words", "phrase", F.col("n").alias("a"), words.alias("words"))
    cuts = candidates.select("lang", "phrase", "a", "n_words", "words", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("n_words") - F.col("k")).alias("rest"))
    counts = known.where("n_words between 1 and %d" % (max_n - 1))
    both = cuts.join(counts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"]).join(counts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    score = F.expr("cast((cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0))) as bigint)")
    scored = both.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("best")).select("lang", "phrase", "best.*")
    inner = F.explode(F.expr("flatten(transform(sequence(2, n_words - 1), m -> transform(sequence(1, n_words - m + 1), i -> array_join(slice(words, i, m), ' '))))"))
    longer = candidates.where("n_words >= 3").select("lang", F.col("a").alias("whole"), inner.alias("phrase")).groupBy("lang", "phrase").agg(F.max("whole").alias("whole"))
    left = scored.join(longer, ["lang", "phrase"], "left").where(F.col("whole").isNull() | (F.lit(100) * _exact(F.col("whole")) < F.lit(cover) * _exact(F.col("a"))))
    ranked = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))).where(F.col("rank") <= top)
    totals = known.where("n_words = 0").select("lang", "n")
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
