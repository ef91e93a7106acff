from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import repeats

SCHEMA = "doc_id long, text string, t1 string, start int, kept int"


def slow(rows, window):
    """All windows of all texts in one counter."""
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    seen = Counter(t[i : i + window] for _, t in texts for i in range(len(t) - window + 1))
    out = []
    for doc, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - window + 1):
            if seen[t[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=str)


def made(window, seed=1):
    r = random.Random(seed)
    prose = lambda n: "".join(r.choices("abcd é", k=n))
    shared = [prose(r.randint(window - 3, 3 * window)) for _ in range(6)]
    rows = []
    for i in range(80):
        parts = [prose(r.randint(0, 2 * window)) for _ in range(r.randint(1, 3))]
        for s in r.choices(shared, k=r.randint(0, 2)):
            lo = r.randint(0, 5)
            parts.insert(r.randint(0, len(parts)), s[lo : len(s) - r.randint(0, 5)])
        rows.append((i, "".join(parts), "x", 1, 2))
    rows += [(100, rows[3][1], "x", 1, 2), (3, rows[3][1], "x", 1, 2), (101, rows[4][1] + "!", None, 1, 2), (None, rows[5][1][:-1], "x", 1, 2)]
    rows += [(102, None, "x", 1, 2), (103, "", "x", 1, 2), (104, "x" * (window - 1), "x", 1, 2), (105, "y" * window, "x", 1, 2), (106, "z" * (window + 1), "x", 1, 2), (107, "ab" * (3 * window), None, 1, 2)]
    return rows + [(108, prose(window) + "q" * 5 + shared[0] + "q" + shared[0], "x", 1, 2)]


def got(frame):
    return sorted(((r[0], r[1], r[2], r[3], r[4], bytes(r[5])) for r in frame.collect()), key=str)


@pytest.mark.parametrize("window, seed, hot, shard", [(40, 8, 4096, 1 << 20), (40, 8, 2, 100), (25, 5, 1, 1), (400, 64, 4096, 3 << 20), (400, 64, 3, 1)])
def test_against_brute_force(spark, monkeypatch, window, seed, hot, shard):
    if hot < 100:
        monkeypatch.setattr(repeats, "MERGE_ROWS", 500)
        monkeypatch.setattr(repeats, "RUN_ROWS", 70)
    rows = made(window)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = repeats.remove_repeats(docs, window, seed, hot, shard)
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    assert got(out) == slow(rows, window)


def test_long_texts_and_overlapping_parts(spark, monkeypatch):
    """Texts that are searched in parts, with repeats over the parts' borders."""
    monkeypatch.setattr(repeats, "STEP_BYTES", 256)
    r = random.Random(4)
    prose = lambda n: "".join(r.choices("abcdefgh", k=n))
    passage = prose(300)
    rows = [(i, prose(900 + 31 * i) + passage + prose(1200) + (passage[50:200] if i % 2 else "")) for i in range(8)]
    text = np.frombuffer(rows[1][1].encode(), np.uint8)
    assert len(text) > 4 * 256
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(repeats.remove_repeats(docs, 60, 10)) == slow(rows, 60)


def test_texts_of_one_character_have_few_runs(spark):
    """Every window of such a text chooses a seed of its own, all of them equal."""
    rows = [(1, "a" * 20_000), (2, "ab" * 5000 + "c"), (3, "a" * 50 + "b"), (4, "abc" * 30 + "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = repeats.long_texts(docs, 40)
    assert texts.select("t1", "t2", "text").mapInArrow(repeats._seeds_of(40, 8), repeats.SEEDS).count() < 30
    assert got(repeats.remove_repeats(docs, 40, 8)) == slow(rows, 40)


def test_empty_tables(spark):
    docs = spark.createDataFrame(made(40), SCHEMA)
    assert repeats.remove_repeats(docs.limit(0)).collect() == []
    short = docs.where("doc_id in (102, 103, 104)")
    assert [tuple(r)[1:4] for r in repeats.remove_repeats(short).orderBy("doc_id").collect()] == [(0, 0, 0), (0, 0, 0), (39, 0, 0)]
    named = docs.select(F.col("text").alias("body"), F.concat(F.lit("k"), "doc_id").alias("key"))
    assert repeats.remove_repeats(named, 40, 8, id_col="key", text_col="body").where("n_removed > 0").count() > 20


@pytest.mark.parametrize("seed", range(4))
def test_suffix_array_and_prefixes(seed):
    r = random.Random(seed)
    data = bytes(r.choices(range([2, 4, 26, 256][seed]), k=3000)) + b"abc" * 200 + bytes(r.choices(b"ab", k=500)) * 2 + bytes(seed)
    depth = 64
    order = repeats.suffix_array(np.frombuffer(data, np.uint8))
    assert order.tolist() == sorted(range(len(data)), key=lambda i: data[i:])

    def common(a, b):
        n = 0
        while n < depth and max(a, b) + n < len(data) and data[a + n] == data[b + n]:
            n += 1
        return n

    want = [0] + [common(order[i - 1], order[i]) for i in range(1, len(order))]
    for lane in (1, 7, 256, 10_000):
        assert repeats.common_prefixes(np.frombuffer(data, np.uint8), order, depth, lane).tolist() == want


def test_seeds_follow_content():
    r = random.Random(3)
    text = bytes(r.choices(b"ab", k=700))
    for data, offsets in ((text, [0, 700]), (b"x" * 30 + text + b"y" * 50, [0, 30, 730, 780])):
        text_of, first, last, h = repeats.seeds(np.frombuffer(data, np.uint8), np.array(offsets), 40, 8)
        mine = text_of == (1 if len(offsets) > 2 else 0)
        runs = [*zip(first[mine].tolist(), last[mine].tolist(), h[mine].tolist(), strict=True)]
        assert [w for a, b, _ in runs for w in range(a, b + 1)] == [*range(661)]
        of = {}
        for a, b, x in runs:
            for w in range(a, b + 1):
                assert of.setdefault(text[w : w + 40], x) == x
        held = runs if len(offsets) == 2 else held
        assert runs == held
