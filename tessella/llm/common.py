"""Helpers that the training-data operators share: staged tables, and Arrow text access."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one vectorised step takes at once; one longer text still goes alone.
STEP_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a session in one JVM (``local[n]``) may leave it unset; it then gets a temporary folder.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    where = "file://" + tempfile.mkdtemp(prefix="tessella-")
    spark.conf.set("spark.checkpoint.dir", where)
    return where


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: what is lost later is read again, not computed again, and a table used
    twice is computed once. The files go when the driver's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Write ``df`` to the shared folder in buckets of ``keys``, as many as shuffles have partitions, and read it back.

    A join on the keys then moves the other side alone. The files go when the driver's process ends.
    """
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/staged/{table}"
    df.write.option("path", path).bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).saveAsTable(table)
    atexit.register(_remove, spark, path)
    return spark.table(table)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended: its folder goes with it
        return


_held: dict[tuple, object] = {}


def remembered(key: tuple, make):
    """What ``make`` gives, kept in this process until another key is asked for.

    A worker serves the stages of a pipeline one after another, and would otherwise hold the
    words that each of them remembers.
    """
    if key not in _held:
        _held.clear()
        slim()
        _held[key] = make()
    return _held[key]


def slim() -> None:
    """Gives back to the system what this process has freed.

    A worker serves one stage after another, and its allocators keep the most that any of them took.
    """
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
        trim(0)


def free(name: str, *frames: DataFrame) -> str:
    """A column name like ``name`` that none of ``frames`` has, whatever the case of its letters."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


class Texts:
    """The UTF-8 bytes of some texts, end to end; a null counts as an empty text."""

    def __init__(self, column: pa.Array) -> None:
        column = column.fill_null("" if not pa.types.is_large_binary(column.type) else b"")
        if not pa.types.is_large_binary(column.type):
            column = column.cast(pa.large_binary())
        _, offsets, data = column.buffers()
        self.offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        self.data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def lengths(self) -> np.ndarray:
        return np.diff(self.offsets)

    def bytes(self) -> np.ndarray:
        return self.data[self.offsets[0] : self.offsets[-1]]

    def steps(self, most: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Runs of texts of at most ``most`` bytes together: first, end, their bytes, their offsets in them."""
        at, n = 0, len(self)
        while at < n:
            end = int(np.searchsorted(self.offsets, self.offsets[at] + most, "right")) - 1
            end = min(n, max(end, at + 1))
            lo, hi = self.offsets[at], self.offsets[end]
            yield at, end, self.data[lo:hi], self.offsets[at : end + 1] - lo
            at = end


#: Bytes that end a word: space and 0x09 to 0x0D.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, STEP_BYTES + 1)
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _powers[i] = np.multiply.accumulate(factors)
    return _powers[0], _powers[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of some texts: where each begins and ends in the bytes, and the text it is from."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data = data
        solid = ~SPACES[data]
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        begins = offsets[:-1][offsets[:-1] < len(data)]
        first[begins] = solid[begins]
        ends = offsets[1:][offsets[1:] > 0] - 1
        last[ends] = solid[ends]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        #: bounds[i] to bounds[i + 1] are the words of text i.
        self.bounds = np.searchsorted(self.start, offsets)
        self.text = np.repeat(np.arange(len(offsets) - 1), np.diff(self.bounds))

    def hashes(self) -> np.ndarray:
        """64 bits for each word, the same wherever the word stands."""
        power, inverse = power_tables(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * power[: len(self.data)], out=sums[1:])
        return mixed((sums[self.end] - sums[self.start]) * inverse[self.start] + (self.end - self.start).astype(np.uint64))

    def grams(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """A hash of each ``k`` words in a row, and whether they are all of one text; by first word."""
        n = max(0, len(hashes) - k + 1)
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[j : j + n]
        return mixed(out), self.text[:n] == self.text[k - 1 : k - 1 + n] if n else np.zeros(0, bool)
