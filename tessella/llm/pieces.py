"""SentencePiece encoding and decoding by a max-plus parallel scan.

The vocabulary is used as a unigram model: the ids of a text are those of the segmentation into
pieces with the greatest sum of scores. A giant text is split into chunks. Each chunk yields a
transfer matrix in the max-plus algebra: entry (i, j) is the best score with the chunk entered i
characters in, as the piece before reaches so far across its border, and its last piece reaching
j characters into the next chunk. Matrices combine associatively: runs of ``FAN`` of them are
multiplied, the products again, up to one run a text; then the states at the borders are found from the top
down, each run's inner ones from its outer two. So no task ever has more of a text than ``FAN`` matrices
or one chunk. Each chunk then traces its own pieces back, given only the states at its two borders.

The scores are the vocabulary's own. In a BPE vocabulary they are ranks of merges, not logarithms of
probabilities, so its ids here are not those that merging gives.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import remembered, staged

CHUNK = 1 << 15
#: Matrices that are multiplied in one task.
FAN = 64
#: Whole texts, or chunks of long ones, that a worker holds as strings at once.
ROWS, CHUNKS = 100, 8
SPACE = "▁"
LOW = float("-inf")
#: What a character costs that is spelled in bytes: more than any piece but those never to be used.
BYTES = -100_000.0
#: Words that a worker holds with their ids, in two generations.
REMEMBERED = 500_000


class Vocabulary:
    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.texts = [model.id_to_piece(i) for i in range(self.size)]
        plain = [i for i in range(self.size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.score = {self.texts[i]: model.get_score(i) for i in plain}
        self.id = {self.texts[i]: i for i in plain}
        self.byte = {int(self.texts[i][3:-1], 16): i for i in range(self.size) if model.is_byte(i)}
        self.longest = max(map(len, self.id))
        self.raw = [self.texts[i].encode() for i in range(self.size)]
        for value, i in self.byte.items():
            self.raw[i] = bytes([value])
        for i in range(self.size):
            if model.is_control(i) or model.is_unknown(i):
                self.raw[i] = b""
        # Where no piece goes across, texts may be cut: before a space mark, around line feeds, and
        # after word characters before those of these marks that follow none in any piece.
        crosses = [p for p in self.id if SPACE in p.lstrip(SPACE) or "\n" in p and len(p) > 1]
        marks = "".join(c for c in ".,;:!?" if not any(re.search(rf"\w{re.escape(c)}", p) for p in self.id))
        word = rf"{SPACE}*\w+(?=[{re.escape(marks)}])|" if marks else ""
        self.words = re.compile(f"\n|{word}{SPACE}*[^{SPACE}\n]+|{SPACE}+") if not crosses else re.compile(r"(?s).+")
        self.gain = np.array([self.score[t] if t in self.score else BYTES if r and r[0] & 0xC0 != 0x80 else 0.0 for t, r in zip(self.texts, self.raw, strict=True)])
        #: Words and their ids, and those of the generation before. Giant words are not kept.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.solver = self._solver()
        #: The score of each beginning of a piece; LOW for those that aren't pieces themselves.
        self.beginning: dict[str, float] = {p[:n]: LOW for p in self.id for n in range(1, len(p))} | self.score

    def best(self, text: str, start: int, stop: int) -> tuple[list[float], list[int]]:
        """Best scores from ``start`` to each place from there on, and where the last piece begins.

        Pieces begin before ``stop`` and may end after it. A character that is no piece is spelled
        in bytes. Of equal scores the piece that begins first, the longest, is taken.
        """
        n, look = len(text), self.beginning.get
        score, back = [LOW] * (n + 1), [-1] * (n + 1)
        score[start] = 0.0
        for at in range(start, stop):
            here = score[at]
            if here == LOW:
                continue
            end = at + 1
            gain = look(text[at:end])
            if gain is None or gain == LOW:
                if here + BYTES > score[end]:
                    score[end], back[end] = here + BYTES, at
            while gain is not None:
                if here + gain > score[end]:
                    score[end], back[end] = here + gain, at
                end += 1
                if end > n:
                    break
                gain = look(text[at:end])
        return score, back

    def trace(self, text: str, start: int, end: int, back: list[int]) -> list[int]:
        out: list[int] = []
        while end > start:
            at = back[end]
            piece = self.id.get(text[at:end])
            out.extend([piece] if piece is not None else [self.byte[b] for b in reversed(text[at:end].encode("utf-8", "surrogatepass"))])
            end = at
        return out[::-1]

    def _solver(self):
        """The library's search for the best segmentation, over the same pieces and scores. It takes the
        piece that begins first of equal scores, as ``best`` does."""
        from tokenizers import Tokenizer
        from tokenizers.models import Unigram

        pieces = [(t, self.score[t]) if t in self.score else (f"\0{i}", 2 * BYTES) for i, t in enumerate(self.texts)]
        return Tokenizer(Unigram(pieces, 0, False))

    def word(self, word: str) -> bytes:
        """The ids of a run of characters that no piece leaves, as 32-bit integers."""
        _, back = self.best(word, 0, len(word))
        return np.array(self.trace(word, 0, len(word), back), np.int32).tobytes()

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """The ids of many words. Those with a character that is no piece, where the library gives 0, are searched here."""
        out = {}
        for at in range(0, len(words), 5_000):
            some = words[at : at + 5_000]
            for word, found in zip(some, self.solver.encode_batch_fast(some, add_special_tokens=False), strict=True):
                ids = found.ids
                out[word] = self.word(word) if 0 in ids or "\0" in word else np.array(ids, np.int32).tobytes()
        return out

    def words_of(self, text: str, start: int, end: int) -> bytes:
        return self.all_words([self.words.findall(text, start, end)])[0]

    def all_words(self, split: list[list[str]]) -> list[bytes]:
        """The ids of each list of words."""
        if len(self.known) > REMEMBERED // 2:
            self.older, self.known = self.known, {}
        known = self.known
        fresh: set[str] = set()
        for words in split:
            fresh.update(w for w in words if w not in known)
        again = {w: self.older[w] for w in fresh if w in self.older}
        known.update(again)
        fresh.difference_update(again)
        giant = {}
        if fresh:
            found = self.learn(list(fresh))
            giant = {w: i for w, i in found.items() if len(w) > 64}
            for w in giant:
                del found[w]
            known.update(found)
        look = known.__getitem__ if not giant else lambda w: giant[w] if w in giant else known[w]
        return [b"".join(map(look, words)) for words in split]

    def total(self, ids: bytes) -> float:
        """The score of the ids of whole words; bytes of one character cost once."""
        return float(self.gain[np.frombuffer(ids, np.int32)].sum())

    def fragments(self, text: str, size: int) -> tuple[int, int]:
        """The first and the last place of a chunk, at least one piece's length from its start, that
        no piece goes across; (size, size) if there is none. Between them words are on their own."""
        first = last = -1
        for m in self.words.finditer(text):
            if m.start() >= self.longest and first < 0 and m.start() <= size:
                first = m.start()
            if m.start() <= size:
                last = m.start()
            else:
                break
        return (first, last) if 0 <= first <= last else (size, size)

    def matrix(self, text: str, size: int) -> np.ndarray:
        """The transfer matrix of a chunk: ``text`` is the chunk of ``size`` and what a piece can reach."""
        k = self.longest
        out = np.full((k, k), LOW)
        first, last = self.fragments(text, size)
        if first < size:
            middle = self.total(self.words_of(text, first, last))
            tail, _ = self.best(text[last:], 0, size - last)
            ending = [tail[size - last + j] if size - last + j < len(tail) else LOW for j in range(k)]
            for i in range(k):
                head, _ = self.best(text[:first], i, first)
                out[i] = [head[first] + middle + e for e in ending]
            return out
        for i in range(min(k, size)):
            score, _ = self.best(text, i, size)
            out[i] = [score[size + j] if size + j <= len(text) else LOW for j in range(k)]
        for i in range(size, k):  # the piece before reaches across the whole chunk
            if i - size < k:
                out[i, i - size] = 0.0
        return out

    def encode(self, text: str, size: int, enter: int = 0, leave: int = 0) -> bytes:
        """The ids of the pieces that begin in a chunk, given the states at its borders."""
        if enter >= size:
            return b""
        if not enter and not leave and size == len(text):
            return self.words_of(text, 0, size)
        of = lambda t, start, end, back: np.array(self.trace(t, start, end, back), np.int32).tobytes()
        first, last = self.fragments(text, size)
        if first < size:
            _, head = self.best(text[:first], enter, first)
            rest = text[last:]
            _, tail = self.best(rest, 0, size - last)
            return of(text, enter, first, head) + self.words_of(text, first, last) + of(rest, 0, size - last + leave, tail)
        _, back = self.best(text, enter, size)
        return of(text, enter, size + leave, back)

    def decode(self, ids: list[int]) -> bytes:
        """UTF-8 of the text; the mark before the first word is dropped."""
        raw = self.spelled(ids)
        return raw[1:] if raw[:1] == b" " else raw

    def spelled(self, ids: list[int]) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids)).replace(b"\xe2\x96\x81", b" ")


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product, which is associative: chunk a, then chunk b."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def product(matrices: list[np.ndarray]) -> np.ndarray:
    """All of them combined, in order, pairwise in a tree."""
    while len(matrices) > 1:
        matrices = [combine(*matrices[i : i + 2]) if i + 1 < len(matrices) else matrices[i] for i in range(0, len(matrices), 2)]
    return matrices[0]


def borders(matrices: list[np.ndarray], enter: int = 0, leave: int = 0) -> list[int]:
    """The state at each border of the best way through a run of chunks, from ``enter`` to ``leave``.

    Of states with equal sums that agree with the border before, the smallest is taken.
    """
    k = matrices[0].shape[0]
    after = [np.full(k, LOW) for _ in range(len(matrices) + 1)]
    after[-1][leave] = 0.0
    for i in range(len(matrices) - 1, -1, -1):
        after[i] = (matrices[i] + after[i + 1][None, :]).max(axis=1)
    states = [enter]
    for i, m in enumerate(matrices):
        states.append(int(np.argmax(m[states[-1]] + after[i + 1])))
    return states


def vocabulary(path: str) -> Vocabulary:
    return remembered(("pieces", path), lambda: Vocabulary(path))


def marked(text: str) -> str:
    """As the model normalises a text: a space mark before it and for each space; empty stays empty."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def _lists(ids: list[bytes]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), np.int32)))


def _slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            yield whole.slice(at, rows)


def border_states(matrices: DataFrame, key: list[str], reach: int, most: int, fan: int = FAN) -> DataFrame:
    """key, chunk, enter and leave: the states at the borders of every chunk.

    ``matrices``: key, chunk from 0, and m, the chunk's transfer matrix row by row; ``most`` is the highest
    chunk number. Products are made of runs of ``fan`` until each key has one run, then each
    level's states are found within the runs of the next. There are log(most) / log(fan) levels.
    """

    def run_of(level: DataFrame) -> DataFrame:
        return level.groupBy(*key, F.floor(F.col("chunk") / fan).cast("int").alias("run")).agg(F.sort_array(F.collect_list(F.struct("chunk", "m"))).alias("ms"))

    shaped = lambda one: [np.asarray(x["m"], float).reshape(reach, reach) for x in one]

    @F.pandas_udf("array<double>")
    def multiplied(ms):
        import pandas as pd

        return pd.Series([product(shaped(one)).ravel() for one in ms])

    @F.pandas_udf("array<int>")
    def followed(ms, enter, leave):
        import pandas as pd

        return pd.Series([borders(shaped(one), a, b) for one, a, b in zip(ms, enter, leave, strict=True)])

    levels = [matrices]
    while most >= fan:
        most //= fan
        levels.append(staged(run_of(levels[-1]).select(*key, F.col("run").alias("chunk"), multiplied("ms").alias("m")), "products"))
    states: DataFrame | None = None
    for level in reversed(levels):
        runs = run_of(level)
        if states is None:
            runs = runs.withColumns({"enter": F.lit(0), "leave": F.lit(0)})
        else:
            known = states.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(key)], F.col("chunk").alias("of_run"), "enter", "leave")
            runs = runs.join(known, [*[F.col(c).eqNullSafe(F.col(f"k{i}")) for i, c in enumerate(key)], F.col("run") == F.col("of_run")])
        found = runs.select(*key, "ms", followed("ms", "enter", "leave").alias("states"))
        pairs = F.transform("ms", lambda x, i: F.struct(x["chunk"].alias("chunk"), F.element_at("states", i + 1).alias("enter"), F.element_at("states", i + 2).alias("leave")))
        states = staged(found.select(*key, F.explode(pairs).alias("s")).select(*key, "s.*"), "states")
    return states


def encode(docs: DataFrame, model_path: str, chunk: int = CHUNK, fan: int = FAN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, chunk, n_chunks, text_hash and ids of every whole text, one row a chunk of ``chunk`` characters.

    The ids of a text are those of its chunks in order. A text of one chunk is encoded where it is
    read; only the chunks of longer ones are dealt out and meet again, as matrices, in runs of ``fan``.
    A null or empty text has one row without ids. Repeated rows give repeated results; texts of
    one id are told apart by text_hash; a null id stays null; other columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("text_hash", F.xxhash64("text"))
    rows = rows.withColumn("n_chunks", F.greatest(F.ceil((F.length("text") + 1) / chunk), F.lit(1)).cast("int"))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model_path)
        for b in _slices(batches, ROWS):
            ids = v.all_words([v.words.findall(marked(t)) for t in b.column(1).to_pylist()])
            zero = np.zeros(b.num_rows, np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(zero), pa.array(zero + np.int32(1)), b.column(2), _lists(ids)], names=["doc_id", "chunk", "n_chunks", "text_hash", "ids"])

    one = rows.where("n_chunks = 1").select("doc_id", "text", "text_hash").mapInArrow(short, "doc_id long, chunk int, n_chunks int, text_hash long, ids array<int>")
    key = ["doc_id", "text_hash"]
    long = rows.where("n_chunks > 1").groupBy(*key).agg(F.first("text").alias("text"), F.first("n_chunks").alias("n_chunks"), F.count("*").alias("copies"))
    mark = F.concat(F.lit(SPACE), F.translate("text", " ", SPACE))
    reach = vocabulary(model_path).longest
    cut = long.select(*key, "copies", "n_chunks", mark.alias("text"), F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)).alias("chunk"))
    cut = cut.withColumn("text", F.expr(f"substring(text, chunk * {chunk} + 1, {chunk + reach})")).withColumn("size", F.least(F.length("text"), F.lit(chunk)))
    cut = staged(cut.repartition(F.col("doc_id"), F.col("text_hash"), F.col("chunk")), "chunks")

    def transfer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model_path)
        for b in _slices(batches, CHUNKS):
            ms = [v.matrix(t, s).ravel() for t, s in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)]
            ends = np.arange(len(ms) + 1, dtype=np.int32) * np.int32(reach * reach)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ms)))], names=[*key, "chunk", "m"])

    matrices = staged(cut.select(*key, "chunk", "text", "size").mapInArrow(transfer, "doc_id long, text_hash long, chunk int, m array<double>"), "matrices")
    most = matrices.agg(F.max("chunk")).first()[0] or 0
    states = border_states(matrices, key, reach, most, fan).withColumnsRenamed({"doc_id": "of_doc", "text_hash": "of_text", "chunk": "of_chunk"})
    ready = cut.join(states, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("text_hash") == F.col("of_text")) & (F.col("chunk") == F.col("of_chunk")))

    same = ["doc_id", "chunk", "n_chunks", "text_hash", "copies"]

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model_path)
        for b in _slices(batches, CHUNKS):
            ids = [v.encode(*row) for row in zip(*(c.to_pylist() for c in b.columns[5:]), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], _lists(ids)], names=[*same, "ids"])

    split = ready.select(*same, "text", "size", "enter", "leave").mapInArrow(traced, "doc_id long, chunk int, n_chunks int, text_hash long, copies long, ids array<int>")
    return one.unionByName(split.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies", "copy"))


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """``encoded`` with text, the UTF-8 bytes of the ids of each row.

    No chunk ends inside a character. A first chunk loses the space mark that encoding put before the text. Null ids give null.
    """

    rows = encoded.drop("text")
    at = {c.lower(): i for i, c in enumerate(rows.columns)}

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model_path)
        for b in _slices(batches, ROWS):
            ids = b.column(at["ids"])
            values, ends = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
            out = []
            for i, (chunk, known) in enumerate(zip(b.column(at["chunk"]).to_pylist(), ids.is_valid().to_pylist(), strict=True)):
                one = values[ends[i] : ends[i + 1]].tolist()
                out.append(None if not known else v.decode(one) if chunk == 0 else v.spelled(one))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], names=[*b.schema.names, "text"])

    return rows.mapInArrow(joined, StructType([*rows.schema.fields, StructField("text", BinaryType())]))
