"""Near copies against all pairs one by one, above all where most texts of a key are related but not similar."""

from __future__ import annotations

import random

import numpy as np
import pytest
from test_simhash import slow_print

from tessella.llm import minhash

SCHEMA = "doc_id long, text string, t string, comp int"


def grams(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or ({" ".join(words)} if words else set())


def slow(rows, similar=0.8):
    """Components over all pairs, and the number of links between different texts."""
    sets = [(d, t, grams(t)) for d, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = []
    for i, (_, _, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][2]
            if not a and not b or a and b and len(a & b) >= similar * len(a | b) - 1e-9:
                links.append((i, j))
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    least = {}
    for i, (d, *_) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(rows))], links


def template(seed, n, words, change):
    """Texts of one template, each word of which is another with a small chance of its own."""
    r = random.Random(seed)
    base = ["".join(r.choices("abcdefghijklmnop", k=6)) for _ in range(words)]
    out = []
    for i in range(n):
        p = r.uniform(0.2, 1.8) * change
        out.append((i, " ".join("".join(r.choices("qrstuvwxyz", k=6)) if r.random() < p else w for w in base), "x", 1))
    return out


@pytest.mark.parametrize("change", [0.035, 0.05, 0.065])
def test_texts_of_one_template(spark, monkeypatch, change):
    """Mean similarity about 0.7, 0.6 and 0.5: both ends of a key are unlike most of its texts."""
    monkeypatch.setattr(minhash, "BLOCK", 50)
    rows = template(1, 300, 200, change)
    want, links = slow(rows)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_copies(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    lost = [p for p in links if got[p[0]] != got[p[1]]]
    assert len(links) > 30 and len(lost) <= 0.002 * len(links)
    # Nothing is connected that isn't by links.
    assert all(want[i] == want[got[i]] for i in range(len(rows)))


def test_cases(spark):
    r = random.Random(2)
    prose = lambda n: " ".join("".join(r.choices("abcdefghij", k=r.randint(2, 9))) for _ in range(n))
    long = prose(20_000)
    rows = [(i, prose(60), "x", 1) for i in range(40)]
    rows += [(50, rows[7][1] + " end", "x", 1), (51, None, "x", 1), (52, "", "x", 1), (53, " \n", None, 1), (None, rows[7][1], "x", 1), (7, rows[7][1], "x", 1), (54, long, "x", 1), (55, long + " more", "x", 1), (56, "one two", "x", 1), (57, "One  two", "x", 1), (None, "alone and without an id", "x", 1)]
    want, _ = slow(rows)
    got = minhash.near_copies(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert got.columns == ["doc_id", "component_id"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(zip([d for d, *_ in rows], want, strict=True), key=str)
    assert minhash.near_copies(spark.createDataFrame([], SCHEMA)).collect() == []


def test_groups_of_fingerprints_are_compared(spark, monkeypatch):
    """Similar texts whose fingerprints link go together even if no MinHash key is shared; unlike ones that link don't."""
    monkeypatch.setattr(minhash, "keys", lambda column, shingle: np.random.default_rng().integers(0, 1 << 62, (len(column), 20)))
    r = random.Random(4)
    rows = []
    for i in range(0, 60, 2):
        words = ["".join(r.choices("abcdefghij", k=6)) for _ in range(400)]
        rows += [(i, " ".join(words), "x", 1), (i + 1, " ".join([*words[:-1], "other"]), "x", 1)]
        assert (slow_print(rows[-1][1]) ^ slow_print(rows[-2][1])).bit_count() <= 4
    # All shingles of four words are equal, and so are the fingerprints, but none of five.
    rows += [(100, "a a a a", "x", 1), (101, "a a a a a a", "x", 1)]
    got = {x["doc_id"]: x["component_id"] for x in minhash.near_copies(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert got == {i: i - i % 2 for i in range(60)} | {100: 100, 101: 101}
