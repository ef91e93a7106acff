"""Best-fit packing of token sequences by exact-complement hashing.

``token_pieces`` turns texts into pieces of at most ``capacity`` tokens; ``pack`` gives each piece a
sequence and a place in it. Which lengths share a sequence depends on how many pieces there are of
each length alone, and there are at most ``capacity`` lengths. So the plan is made on the driver
from that histogram, whose size does not grow with the data, and every piece finds its place in the
plan by its length and by its rank among the pieces of that length.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from itertools import compress, filterfalse
from operator import not_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import remembered, staged

CAPACITY = 4096
#: Words, and their stems, whose ids a worker remembers before it starts anew.
WORDS, STEMS = 300_000, 500_000
#: Stems that are encoded together.
TOGETHER = 4_000

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int64()), ("nth", pa.int64())])
PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, nth long"


def _low(stem: str) -> str:
    """A stem of other letters in lower case; empty if that depends on what follows."""
    low = unicodedata.normalize("NFC", stem).lower()
    return low if "Σ" not in stem else ""


class WordEncoder:
    """Encodes texts word by word, and remembers words.

    The vocabulary's pre-tokenizer never joins characters across white space and its normalizer
    works on the characters of one word, so the ids of a text are the ids of its words in a row.
    Only a text with the string of an added token, which the tokenizer takes for that token, is
    encoded as a whole. What is said of words holds for a stem, a word of letters alone, and the comma or full stop after it. The
    ids of a stem end with the first that the vocabulary marks as a word's end, so many stems are
    encoded as one text.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {"": b""}
        self.stems: dict[str, bytes] = {}

    def encode(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def encode_stems(self, stems: list[str]) -> list[bytes]:
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(stems)], add_special_tokens=False)[0].ids, "<u4")
        cuts = [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
        if len(cuts) != len(stems) + 1:  # not words of letters after all
            return self.encode(stems)
        data = ids.tobytes()
        return [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def learn(self, words: set[str]) -> None:
        by_tail: dict[str, list[str]] = {"": [], ",": [], ".": []}
        plain = []
        for word in words:
            by_tail[word[-1] if word[-1] in ",." else ""].append(word)
        stems = self.stems
        tails = dict(zip(",.", self.encode([",", "."]), strict=True)) | {"": b""}
        for tail, some in by_tail.items():
            lows = [x.lower() if x.isascii() else _low(x) for x in (some if not tail else [word[:-1] for word in some])]
            letters = list(map(str.isalpha, lows))
            plain += compress(some, map(not_, letters))
            some, lows = list(compress(some, letters)), list(compress(lows, letters))
            new = list(set(filterfalse(stems.__contains__, lows)))
            for at in range(0, len(new), TOGETHER):
                part = new[at : at + TOGETHER]
                stems.update(zip(part, self.encode_stems(part), strict=True))
            ids = map(stems.__getitem__, lows)
            self.known.update(zip(some, [x + tails[tail] for x in ids] if tail else ids, strict=True))
        self.known.update(zip(plain, self.encode(plain), strict=True))

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.known) > WORDS:
            self.known = {"": b""}
        if len(self.stems) > STEMS:
            self.stems = {}
        whole = {i: self.encode([text])[0] for i, text in enumerate(texts) if text and any(a in text for a in self.added)}
        split = [[] if i in whole else (text or "").replace("\n", " ").split(" ") for i, text in enumerate(texts)]
        known = self.known
        fresh: set[str] = set()
        for words in split:
            fresh.update(filterfalse(known.__contains__, words))
        if fresh:
            self.learn(fresh)
        look = known.__getitem__
        return [whole[i] if i in whole else b"".join(map(look, words)) for i, words in enumerate(split)]


def encoder(path: str) -> WordEncoder:
    return remembered(("packing", path), lambda: WordEncoder(path))


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 1, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``capacity`` tokens of every whole text, each text ended by ``end_id``.

    Only texts of more than ``capacity`` tokens are cut. Columns: doc_id, piece, start, length,
    ids_crc32, part and nth (the task, and the piece's rank among that task's pieces of its
    length), and ids with ``keep_ids``. A null or empty text is one piece of the end id alone;
    repeated rows give repeated pieces; a null id stays null; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        encode, end = encoder(tokenizer_path), np.array([end_id], "<u4").tobytes()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch, out = whole.slice(at, 500), []
                for doc, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist()), strict=True):
                    ids += end
                    for piece, lo in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[lo : lo + 4 * capacity]
                        length = len(own) // 4
                        out.append((doc, piece, lo // 4, length, zlib.crc32(own), part, int(seen[length])) + ((own,) if keep_ids else ()))
                        seen[length] += 1
                columns = list(zip(*out, strict=True))
                arrays = [pa.array(c, f.type) for c, f in zip(columns, PIECES, strict=False)]
                if keep_ids:
                    flat = np.frombuffer(b"".join(columns[-1]), np.int32)
                    ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in columns[-1]])]).astype(np.int32)
                    arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
                yield pa.RecordBatch.from_arrays(arrays, names=[*PIECES.names, *["ids"] * keep_ids])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, PIECES_DDL + ", ids array<int>" * keep_ids)


def complement_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """Kinds of sequences as (how many, {length: pieces of it}), which together use all pieces.

    The longest length that is left opens a sequence. Its gap is looked up in the index of single
    lengths, then of sums of two, then of three. The index is two bit sets over the available
    lengths, one of them mirrored: bit b of ``free & (mirror >> (capacity - gap))`` says that b and
    gap - b are both there, so one operation on 4,096 bits yields the whole entry of that sum, and
    an entry never holds lengths that have run out. A sum of three is a length and an entry for the
    rest. If none fits exactly, the longest piece that fits goes in and the
    rest of the gap is looked up again. Each kind is used until one of its lengths runs out, so
    there are about as many kinds as lengths.
    """
    left = {length: n for length, n in counts.items() if n > 0}
    free = mirror = 0  # bit l of free: there are pieces of length l; mirror: the same at capacity - l
    for length in left:
        free |= 1 << length
        mirror |= 1 << (capacity - length)
    kinds: list[tuple[int, dict[int, int]]] = []

    def pair(gap: int) -> int:
        """Bits of the lengths b for which b and gap - b are both available."""
        return free & (mirror >> (capacity - gap))

    while free:
        used: dict[int, int] = {}

        def take(length: int) -> None:
            nonlocal free, mirror
            used[length] = used.get(length, 0) + 1  # noqa: B023
            if used[length] == left[length]:  # noqa: B023
                free &= ~(1 << length)
                mirror &= ~(1 << (capacity - length))

        def exact(gap: int) -> tuple[int, ...]:
            if free >> gap & 1:
                return (gap,)
            spare = lambda x, n: left.get(x, 0) - used.get(x, 0) >= n  # noqa: B023, E731
            both = pair(gap)
            while both:
                b = both.bit_length() - 1
                if 2 * b != gap or spare(b, 2):
                    return (b, gap - b)
                both &= ~(1 << b)
            rest = free & ((1 << gap) - 1)
            while rest:
                a = rest.bit_length() - 1
                both = pair(gap - a)
                while both:
                    b = both.bit_length() - 1
                    trio = (a, b, gap - a - b)
                    if all(spare(x, trio.count(x)) for x in set(trio)):
                        return trio
                    both &= ~(1 << b)
                rest &= ~(1 << a)
            return ()

        gap = capacity
        top = free.bit_length() - 1
        take(top)
        gap -= top
        while gap > 0 and free & ((1 << (gap + 1)) - 1):
            if found := exact(gap):
                for length in found:
                    take(length)
                gap = 0
            else:
                best = (free & ((1 << (gap + 1)) - 1)).bit_length() - 1
                take(best)
                gap -= best
        times = min(left[length] // n for length, n in used.items())
        kinds.append((times, used))
        for length, n in used.items():
            left[length] -= times * n
            if left[length]:
                free |= 1 << length
                mirror |= 1 << (capacity - length)
            else:
                free &= ~(1 << length)
                mirror &= ~(1 << (capacity - length))
                del left[length]
    return kinds


class Places:
    """Where in the plan the pieces of each length go, by rank. It has a few entries a kind."""

    def __init__(self, kinds: list[tuple[int, dict[int, int]]], capacity: int = CAPACITY) -> None:
        entries, ranks, first = [], {}, 0
        for times, used in kinds:
            offset = 0
            for length, n in sorted(used.items(), reverse=True):
                rank = ranks.get(length, 0)
                entries.append((length, rank, n, first, offset))
                ranks[length] = rank + times * n
                offset += length * n
            first += times
        entries.sort()
        self.sequences = first
        self.table = np.array(entries, np.int64).reshape(-1, 5)
        self.by_length = np.searchsorted(self.table[:, 0], np.arange(capacity + 2))

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.zeros(len(length), np.int64)
        for one in np.unique(length):
            lo, hi = self.by_length[one], self.by_length[one + 1]
            of = length == one
            at[of] = lo + np.searchsorted(self.table[lo:hi, 1], rank[of], "right") - 1
        _, low, n, first, offset = self.table[at].T
        return first + (rank - low) // n, offset + (rank - low) % n * length


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give every piece a ``sequence_id`` and the ``offset`` where it begins there, without gaps.

    ``pieces`` has the columns of ``token_pieces``; all of them stay, but for part and nth. Pieces
    of one length are told apart by task and rank in the task, so a length that most pieces share
    is never brought together: only its counts are, one a task. Without pieces, no rows.
    """
    pieces = staged(pieces, "pieces")
    counts = staged(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths")
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    places = Places(complement_plan(total, capacity), capacity)
    before = counts.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):
        import pandas as pd

        sequence, offset = places(length.to_numpy(), rank.to_numpy())
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    kept: list[Column] = [F.col(c) for c in pieces.columns if c not in ("part", "nth")]
    # The side of counts is the one that is held, so that pieces with all their ids aren't sorted.
    ranked = pieces.join(before.hint("shuffle_hash"), ["length", "part"]).withColumn("_at", place("length", F.col("before") + F.col("nth")))
    return ranked.select(*kept, "_at.sequence_id", "_at.offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """``token_pieces`` and ``pack`` in one."""
    return pack(token_pieces(docs, tokenizer_path, capacity, end_id, keep_ids), capacity)
