from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tessella.llm import phrases

SCHEMA = "text string, lang string, phrase string, n int, part int"


def slow(rows, max_n=4, least=30, cover=80, top=2000):
    """All grams counted in dictionaries."""
    f, n = defaultdict(Counter), Counter()
    for text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, max_n + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = defaultdict(int)
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], a)
        kept = []
        for p, a in found.items():
            score, k = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            if 100 * inside[p] < cover * a:
                kept.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def made():
    r = random.Random(2)
    words = ["the", "of", "New", "york", "é", "ÉA", "city", "hall", "a\x01", "a", "a\x00b", "ab", "x" * 40, "😀"]
    weights = [30, 20, 8, 8, 3, 3, 6, 4, 5, 5, 3, 3, 1, 1]
    ends = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\v", "\r\n", " - "]
    text = lambda n: "".join(w + r.choice(ends) for w in r.choices(words, weights, k=n))
    rows = [(text(r.randint(0, 60)), r.choice(["en", "en", "en", "de", None, "", "a\nb"]), "x", 1, 1) for _ in range(300)]
    rows += [("hot phrase here now", "en", None, 2, 2)] * 500 + [("new york city hall opens", "en", "x", 1, 1)] * 40
    return rows + [(None, "en", "x", 1, 1), ("", None, "x", 1, 1), (" .,\n", "zz", "x", 1, 1), (text(20_000), "de", "x", 1, 1), ("y " * 30_000, "long", "x", 1, 1)]


@pytest.mark.parametrize("how", [{}, {"max_n": 3, "least": 5, "cover": 50, "top": 20}, {"max_n": 2, "least": 2}])
def test_against_brute_force(spark, how, monkeypatch):
    docs = spark.createDataFrame(made(), SCHEMA).repartition(3)
    want = slow(made(), **how)
    assert len(want) > 20
    got = phrases.collocations(docs, **how)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == want


@pytest.mark.parametrize("task_bytes", [1 << 11, 1 << 16])
def test_any_number_of_tasks(spark, task_bytes):
    docs = spark.createDataFrame(made(), SCHEMA).repartition(2)
    few = phrases.frequent(docs, 4, 10, task_bytes=task_bytes)
    count = Counter()
    for text, lang, *_ in made():
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, 5):
                count.update(("und" if lang is None else lang, k, " ".join(words[i : i + k])) for i in range(len(words) - k + 1))
    got = {(r["lang"], r["n_words"], r["phrase"]): r["n"] for r in few.where("n_words > 0").collect()}
    assert got == {p: c for p, c in count.items() if c >= 10}


def test_nothing_to_find(spark):
    docs = spark.createDataFrame(made(), SCHEMA)
    assert phrases.collocations(docs.limit(0)).collect() == []
    assert phrases.collocations(spark.createDataFrame([(None, None), ("", "en"), ("one two", "en")], "text string, lang string")).collect() == []


def test_scores_past_64_bits(spark, monkeypatch):
    """Counts whose products don't fit a long: one phrase, said to come three thousand million million times."""
    big = 3 * 10**15
    known = spark.createDataFrame([("en", 0, "", 9 * big), ("en", 1, "a", 2 * big), ("en", 1, "b", big), ("en", 2, "a b", big)], "lang string, n_words int, phrase string, n long")
    monkeypatch.setattr(phrases, "frequent", lambda *a: known)
    got = phrases.collocations(spark.createDataFrame([("a b", "en")], "text string, lang string")).collect()
    assert [tuple(r) for r in got] == [("en", 1, "a b", big, 2 * big, big, 9 * big, 2000000 // 3)]


def test_prefixes_of_runs():
    r = random.Random(1)
    rows = sorted({b"".join(r.choices([b"a\n", b"ab\n", b"b\n", b"\x00\n"], k=r.randint(1, 4))) for _ in range(150)}, reverse=True)
    counts = np.array([r.randint(1, 5) for _ in rows])
    want = Counter()
    for s, n in zip(rows, counts, strict=True):
        parts = s.split(b"\n")[:-1]
        for k in range(len(parts) + 1):
            want[k, b"".join(p + b"\n" for p in parts[:k])] += n
    got = [*phrases.count_prefixes(pa.array(rows, pa.large_binary()), counts, 1)]
    assert len({g[:2] for g in got}) == len(got) and {g[:2]: g[2] for g in got} == dict(want)
    few = {g[:2] for g in phrases.count_prefixes(pa.array(rows, pa.large_binary()), counts, 10)}
    edges = {(k, b"".join(p + b"\n" for p in s.split(b"\n")[:k])) for s in (rows[0], rows[-1]) for k in range(s.count(b"\n") + 1)}
    assert few == {k for k, c in want.items() if c >= 10} | edges


def test_long_texts_are_cut_between_pieces():
    data = np.frombuffer(b"one two. three four, five\nsix " * 5 + b"word " * 50, np.uint8)
    runs = [*phrases._cuts(data, 40)]
    assert runs[0][0] == 0 and runs[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(runs, runs[1:], strict=False))
    whole = [x for run in phrases.suffixes(data, np.array([0, len(data)])) for x in run.to_pylist()]
    cut = [x for lo, hi in runs for run in phrases.suffixes(data[lo:hi], np.array([0, hi - lo])) for x in run.to_pylist()]
    assert whole == cut
