from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from xxhash import xxh64_intdigest

from tessella.llm import simhash


def slow_print(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        text = text.replace(c, " ")
    words = [w for w in text.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


TEXTS = ["", None, " \n", "One", "one two three", "ONE two\tthree four", "a b c d e f g h i j", "É é Ünder ß x y z", "a " * 5000, "same four words here same four words here", "x\x85y\xa0z \x1c q w e"]


def test_prints_are_the_definition(monkeypatch):
    want = [slow_print(t) for t in TEXTS]
    assert simhash.simhash_texts(pa.array(TEXTS)).tolist() == want
    assert simhash.simhash_texts(pa.array(["skip", *TEXTS]).slice(1)).tolist() == want


def test_tree_finds_all_within():
    r = random.Random(1)
    base = [r.getrandbits(64) for _ in range(20)]
    values = np.array(sorted({b ^ sum(1 << r.randrange(64) for _ in range(r.randint(0, 6))) & (2**64 - 1) for b in base for _ in range(20)}), np.uint64)
    tree = simhash.BKTree(values)
    got = {(int(q), n) for near, n in tree.within(values, 4) for q in near}
    assert got == {(i, j) for i, a in enumerate(values.tolist()) for j, b in enumerate(values.tolist()) if (a ^ b).bit_count() <= 4}


def slow_components(prints, radius=4):
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= radius:
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(prints))]


@pytest.mark.parametrize("tree", [3, 2048])
def test_near_duplicates(spark, tree):
    r = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(12):
        own = r.choices(words, k=r.choice([30, 120, 400]))
        for _ in range(r.choice([1, 2, 12])):
            copy = list(own)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                copy[r.randrange(len(copy))] = r.choice(words)
            texts.append(" ".join(copy))
    texts += TEXTS + TEXTS
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, fp string, least int").repartition(3)
    rows = {x["doc_id"]: x for x in simhash.near_duplicates(docs, tree=tree).collect()}
    prints = [slow_print(t) for t in texts]
    assert [rows[i]["fp"] & (2**64 - 1) for i in range(len(texts))] == prints
    assert [rows[i]["component_id"] for i in range(len(texts))] == slow_components(prints)


def test_chain_of_links(spark):
    base, prints = random.Random(9).getrandbits(63), []
    for i in range(60):  # each differs from the next in 4 bits, and from others in more
        prints.append(base)
        for b in range(4):
            base ^= 1 << (i * 4 + b) % 63
    rows = spark.createDataFrame([(p if p < 2**63 else p - 2**64,) for p in dict.fromkeys(prints)], "fp long")
    got = defaultdict(set)
    for x in simhash.components(simhash.linked(rows)).collect():
        got[x["root"]].add(x["node"])
    want = defaultdict(set)
    distinct = list(dict.fromkeys(prints))
    for p, r in zip(distinct, slow_components(distinct), strict=True):
        want[r].add(p)
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_no_rows_and_repeats(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).collect() == []
    docs = spark.createDataFrame([(7, "a b"), (7, "a b"), (None, "a b"), (9, "c d e f g")], "doc_id long, text string")
    rows = [tuple(x)[::2] for x in simhash.near_duplicates(docs).collect()]
    assert sorted(rows, key=str) == [(7, 7), (7, 7), (9, 9), (None, 7)]
