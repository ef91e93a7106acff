"""Fuzzy terms, answers in texts and top-k by vectors, against every pair looked at one by one."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from tessella.functions.text import STOP_RETRIEVAL
from tessella.operators import fuzzy, matching, retrieval


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b, 1):
            row[j] = last[j - 1] + 1 if x == y else max(row[j - 1], last[j])
    return row[-1]


def slow_ratio(a, b):
    return 200 * common(a, b) / (len(a) + len(b)) if a or b else 100.0


def slow_partial(a, b):
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    m = len(a)
    windows = {b[i : i + m] for i in range(len(b) - m + 1)} | {b[:i] for i in range(1, m)} | {b[-i:] for i in range(1, m)}
    best = max(slow_ratio(a, w) for w in windows)
    return max(best, slow_partial_once(b, a)) if len(a) == len(b) else best


def slow_partial_once(a, b):
    m = len(a)
    return max(slow_ratio(a, w) for w in {b} | {b[:i] for i in range(1, m)} | {b[-i:] for i in range(1, m)})


def slow_weighted(a, b):
    """The public definition, with whole strings where a set's ratio is worked out from lengths."""
    if not a or not b:
        return 0.0
    x, y = a.split(), b.split()
    both, left, right = sorted({*x} & {*y}), sorted({*x} - {*y}), sorted({*y} - {*x})
    far = max(len(a), len(b)) / min(len(a), len(b))
    ordered = " ".join(sorted(x)), " ".join(sorted(y))
    if far < 1.5:
        if not x or not y:
            tokens = 0.0
        else:
            s, one, two = " ".join(both), " ".join(both + left), " ".join(both + right)
            sets = 100.0 if both and (not left or not right) else max([slow_ratio(one, two)] + ([slow_ratio(s, one), slow_ratio(s, two)] if both else []))
            tokens = max(slow_ratio(*ordered), sets)
        return max(slow_ratio(a, b), 0.95 * tokens)
    scale = 0.9 if far <= 8 else 0.6
    parts = 0.0 if not x or not y else 100.0 if both else max(slow_partial(*ordered), slow_partial(" ".join(left), " ".join(right)))
    return max(slow_ratio(a, b), scale * slow_partial(a, b), 0.95 * scale * parts)


def strings(seed, n):
    r = random.Random(seed)
    words = ["heart", "hart", "failure", "type", "2", "diabetes", "Diabetes", "mellitus", "acute", "of", "MI", "é"]
    made = [" ".join(r.choices(words, k=r.randint(1, 5))) + r.choice(["", "", "s", " x", "  y"]) for _ in range(n)]
    return [t if r.random() < 0.6 else "".join(c for c in t if r.random() > 0.1) for t in made]


def test_weighted_ratio_is_the_definition():
    for a, b in zip(strings(1, 400), strings(2, 400), strict=True):
        assert fuzzy.ratio(a, b) == pytest.approx(slow_ratio(a, b))
        assert fuzzy.partial_ratio(a, b) == pytest.approx(slow_partial(a, b))
        # A set's ratio by lengths is at least that of the joined strings, which may match otherwise too.
        assert fuzzy.weighted_ratio(a, b) == pytest.approx(slow_weighted(a, b), abs=1e-9) or fuzzy.weighted_ratio(a, b) <= slow_weighted(a, b)
    assert fuzzy.weighted_ratio("type 2 diabetes", "Type 2 Diabetes Mellitus") == pytest.approx(85.5)
    assert fuzzy.weighted_ratio("", "a") == 0 == fuzzy.weighted_ratio("a", "")


def test_no_pair_exceeds_its_bound():
    terms, names = [*strings(3, 80), " ", "a"], [*strings(4, 200), " ", "a  b"]
    columns: dict = {}
    a, b = fuzzy._Strings(terms, columns, True), fuzzy._Strings(names, columns, False)
    most = fuzzy.bounds(a, b, len(columns))
    got = np.array([[fuzzy.weighted_ratio(t, n) for n in names] for t in terms])
    assert (got <= most + 1e-9).all() and (most < 85).sum() > 500


@pytest.mark.parametrize("least", [60.0, 85.0, 95.0])
def test_best_matches_miss_nothing(spark, monkeypatch, least):
    monkeypatch.setattr(fuzzy, "TERM_BLOCK", 50)
    monkeypatch.setattr(fuzzy, "NAME_BLOCK", 64)
    terms, names = [*strings(5, 120), "zzzz", "", None], [*strings(6, 300), "", None, strings(6, 1)[0]]
    frames = [spark.createDataFrame([(x,) for x in v], f"{c} string").repartition(3) for v, c in ((terms, "term"), (names, "name"))]
    got = {r["term"]: (r["name"], round(r["score"], 9)) for r in fuzzy.best_matches(*frames, least).collect()}
    want = {}
    for t in {*terms} - {"", None}:
        score, name = min((-fuzzy.weighted_ratio(t, n), n) for n in names if n)
        if -score >= least:
            want[t] = (name, round(-score, 9))
    assert got == want and len(want) > 5


def test_best_matches_of_nothing(spark):
    some, none = (spark.createDataFrame(rows, "s string") for rows in ([("a b",)], []))
    for t, n in ((some, none), (none, some), (none, none)):
        assert fuzzy.best_matches(t.toDF("term"), n.toDF("name")).collect() == []


def test_contained(spark, monkeypatch):
    r = random.Random(3)
    word = lambda: "".join(r.choices("abAB ", k=r.randint(1, 9)))
    answers = [(i, word()) for i in range(60)] + [(60, ""), (61, None), (3, "a"), (62, "Ünï"), (63, "b")]
    names = [word() for _ in range(150)] + ["", None, "xÜNÏx", "aaaaaa", "aaaaaa"]
    frames = spark.createDataFrame(answers, "id long, answer string"), spark.createDataFrame([(n,) for n in names], "name string").repartition(3)
    want = sorted((i, n) for i, a in answers for n in names if a is not None and n is not None and (a.lower() in n.lower() or len(n) >= 6 and n.lower() in a.lower()))
    for block in (7, 10_000):
        assert sorted(map(tuple, matching.contained(*frames, block=block).collect())) == want


def test_answers_in_texts(spark):
    r = random.Random(4)
    words = ["the", "of", "alpha", "beta", "gamma", "delta", "x1", "é", "Beta"]
    say = lambda n: " ".join(r.choices(words, k=n))
    answers = [(i, say(r.randint(1, 6))) for i in range(50)] + [(50, ""), (51, None), (52, "the of"), (53, "zeta"), (7, "alpha beta x1")]
    texts = [(i, say(r.randint(0, 12))) for i in range(80)] + [(80, None), (81, ""), (82, "ALPHA gamma. Beta-delta")]
    token = lambda s: {*re.findall("[a-z0-9]+", s.lower())} - {*STOP_RETRIEVAL}
    want = []
    for i, a in answers:
        for d, t in texts:
            if a is not None and t is not None:
                own = token(a)
                share = len(own & token(t)) / len(own) if len(own) >= 2 else 0
                if a.lower() in t.lower() or share >= 0.6:
                    want.append((i, d, 1.0 if a.lower() in t.lower() else share))
    frames = spark.createDataFrame(answers, "item_id long, answer string"), spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    for block in (9, 10_000):
        assert sorted(map(tuple, matching.answers_in_texts(*frames, block=block).collect())) == sorted(want)
    assert matching.answers_in_texts(frames[0].limit(0), frames[1]).collect() == [] == matching.answers_in_texts(frames[0], frames[1].limit(0)).collect()


@pytest.mark.parametrize("k, ids", [(3, "long"), (1, "string"), (500, "long")])
def test_nearest_by_blocks(spark, monkeypatch, k, ids):
    for name, value in (("CORPUS_BLOCK", 7), ("QUERY_BLOCK", 5), ("QUERY_BYTES", 200)):
        monkeypatch.setattr(retrieval, name, value)
    r = random.Random(k)
    vector = lambda: [r.choice([0.0, 0.5, 1.0, -1.0]) for _ in range(3)]
    queries, corpus = [(i, vector()) for i in range(12)], [(f"n{i}" if ids == "string" else i, vector()) for i in range(90)]
    frames = spark.createDataFrame([*queries, (99, None)], "query_id long, vector array<float>"), spark.createDataFrame([*corpus, (None, None)], f"id {ids}, vector array<float>").repartition(4)
    want = []
    for q, v in queries:
        best = sorted((-round(float(np.dot(v, w)), 6), i) for i, w in corpus)[:k]
        want += [(q, i, -s + 0.0, n) for n, (s, i) in enumerate(best)]
    got = [(x["query_id"], x["id"], x["sim"] + 0.0, x["rank"]) for x in retrieval.nearest(*frames, k).collect()]
    assert sorted(got) == sorted(want)
    assert retrieval.nearest(frames[0].limit(0), frames[1], k).collect() == [] == retrieval.nearest(frames[0], frames[1].limit(0), k).collect()


def test_nearest_of_copies_is_nearest(spark, monkeypatch):
    """Equal vectors on both sides, opposite ones and ties between classes; every class is compared once."""
    from pyspark.sql import functions as F

    from tessella.operators import retrieval

    v = lambda i: [[1.0, 0.0], [0.0, 1.0], [0.6, 0.8], [0.8, 0.6], [-1.0, 0.0]][i % 5]
    corpus = spark.createDataFrame([(i * 7 % 101, v(i)) for i in range(100)] + [(500, None)], "id long, vector array<float>")
    queries = spark.createDataFrame([(i, v(i * 3)) for i in range(40)] + [(99, None)], "query_id long, vector array<float>")
    want = {k: sorted(retrieval.nearest(queries, corpus, k).collect()) for k in (5, 30)}
    compared, real = [], retrieval.nearest
    monkeypatch.setattr(retrieval, "nearest", lambda q, c, *rest: compared.append((q.count(), c.count())) or real(q, c, *rest))
    for k, rows in want.items():
        got = retrieval.nearest_of_copies(queries, corpus, k).select("query_id", "id", "sim", "rank")
        assert sorted(got.collect()) == rows
        assert got.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") != k).count() == 0
    assert set(compared) == {(5, 5)}
