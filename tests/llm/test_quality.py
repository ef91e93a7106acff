from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from tessella.llm import quality

TEXTS = [None, "", " \n\t", "one", "a b c d e a b c d e", "x y\nx y\n\n \nx y\nz", "é ß#|& <b>$%*", "a\x85b c\xa0d \x1c e", "w " * 4000, "a b c d e f " * 3 + "g", "same line\n same line\nsame line", "p q r s t u v w p q r s t", "\n\n\n"]


def slow(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = set()
    for i in range(len(words) - 4):
        if windows[tuple(words[i : i + 5])] > 1:
            hit.update(range(i, i + 5))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), sum(c in quality.SYMBOLS for c in text), dup, len(hit)]


def test_statistics_are_the_definition():
    r = random.Random(2)
    texts = TEXTS + [" ".join(r.choices("abcdefg", k=r.randint(0, 60))) for _ in range(200)]
    assert quality.text_stats(pa.array(texts)).tolist() == [slow(t) for t in texts]


def test_chi2():
    assert abs(quality.chi2_quantile(0.95, 5) - 11.0705) < 1e-3
    assert abs(quality.chi2_quantile(0.99, 2) - 9.2103) < 1e-3


def slow_mcd(x, floors, share=0.5, tries=200):
    """The least determinant over many random starts, and the estimate made anew from it."""
    k, g = x.shape[1], np.random.default_rng(0)
    scale = lambda p: p / quality.chi2_quantile_share(quality.chi2_quantile(p, k), k + 2)
    shape = lambda rows, s: (rows.mean(0), np.cov(rows.T, bias=True).reshape(k, k) * s + np.diag(np.square(floors)))
    dist = lambda m: np.einsum("ij,jk,ik->i", x - m[0], np.linalg.inv(m[1]), x - m[0])
    best = None
    for _ in range(tries):
        model, det = shape(x[g.choice(len(x), k + 1, replace=False)], 1.0), np.inf
        for _ in range(50):
            bins = np.floor(np.log2(dist(model) + 1e-9) * 64)
            after = shape(x[bins <= np.sort(bins)[int(np.ceil(share * len(x))) - 1]], scale(share))
            now = np.linalg.slogdet(after[1])[1]
            if now >= det - 1e-6:
                break
            model, det = after, now
        if best is None or det < best[1]:
            best = model, det
    anew = shape(x[dist(best[0]) <= quality.chi2_quantile(quality.NOT_FAR, k)], scale(quality.NOT_FAR))
    return anew, best[1]


def clustered(g, share):
    """Correlated rows, and a tight cluster of others beside them."""
    n = round(600 * share)
    return np.concatenate([g.multivariate_normal([0, 5, 1], [[1, 0.8, 0], [0.8, 1, 0.2], [0, 0.2, 1]], 600 - n), g.multivariate_normal([4, 1, 6], 0.05 * np.eye(3), n)])


def test_models_are_the_least_determinant(spark):
    g = np.random.default_rng(4)
    parts = {"a": clustered(g, 0.1), "b": clustered(g, 0.3), "c": clustered(g, 0.2), "d": g.normal(0, 3, (200, 3)), "e": np.array([[1.0, 2.0, 3.0]])}
    rows = spark.createDataFrame([(name, *map(float, v)) for name, x in parts.items() for v in x], "g string, x0 double, x1 double, x2 double").repartition(5)
    got = {r["g"]: r for r in quality.mcd_models(rows, ["g"], ["x0", "x1", "x2"], [0.1] * 3).collect()}
    for name in "abcd":
        (center, cov), det = slow_mcd(parts[name], [0.1] * 3)
        assert got[name]["det"] <= det + (0.05 if name != "d" else 0.1), name
        if name != "d":
            assert np.allclose(got[name]["m"]["center"], center, atol=0.02)
            assert np.allclose(np.linalg.inv(np.reshape(got[name]["m"]["inverse"], (3, 3))), cov, rtol=0.1, atol=0.05)
            assert np.allclose(center, [0, 5, 1], atol=0.3)  # the cluster doesn't draw it
    assert got["e"]["m"]["center"] == [1.0, 2.0, 3.0]
    assert quality.mcd_models(rows.limit(0), ["g"], ["x0", "x1", "x2"], [0.1] * 3).collect() == []


def test_verdicts_are_the_definition(spark):
    """kept by brute force: statistics, least determinant and distance of each document, in numpy."""
    r = random.Random(12)
    prose = lambda n, p: " ".join("".join(r.choices("abcdefghij", k=r.randint(2, 9))) + "#" * (r.random() < p) for _ in range(n))
    texts = [prose(r.randint(40, 400), 0.0 if i % 10 else r.random()) for i in range(250)] + ["x " * 30, "few"]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").repartition(3)
    stats = np.array([slow(t) for t in texts], float)
    n = np.maximum(stats[:, 0], 1)
    failed = (stats[:, 0] < 10) | (100 * stats[:, 4] > 20 * stats[:, 0])
    x = np.stack([np.log1p(stats[:, 0]), np.log1p(stats[:, 1] / n), *[np.sqrt(stats[:, i] / n) for i in (2, 3, 4)]], axis=1)
    (center, cov), _ = slow_mcd(x[~failed], [f for _, _, f in quality.FEATURES])
    far = np.einsum("ij,jk,ik->i", x - center, np.linalg.inv(cov), x - center)
    limit = quality.chi2_quantile(0.99999, 5)
    for row in quality.quality(docs).collect():
        i = row["doc_id"]
        assert row["base_failed"] == failed[i]
        if abs(far[i] - limit) > 3:
            assert row["kept"] == (not failed[i] and far[i] <= limit), (i, far[i], row)


def test_quality(spark):
    r = random.Random(8)
    prose = lambda n: " ".join("".join(r.choices("abcdefghij", k=r.randint(2, 9))) for _ in range(n))
    rows = [(i, prose(r.randint(40, 400)), "en", "s", 1) for i in range(300)]
    rows += [(1000, " ".join("".join(r.choices("#$%&*|", k=5)) for _ in range(200)) + " " + prose(60), "en", "s", 1), (1001, "too short", "en", "s", 1), (1002, None, None, None, 1), (1003, "w " * 50, "en", None, 1), (1004, prose(80), None, "s", 1), (None, prose(80), "en", "s", 1), (0, rows[0][1], "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept int").repartition(3)
    got = quality.quality(docs).collect()
    assert len(got) == len(rows)
    by = {x["doc_id"]: x for x in got}
    assert all(by[i]["kept"] for i in [*range(300), 1004, None])
    assert not by[1000]["kept"] and not by[1000]["base_failed"]
    assert [by[i]["base_failed"] for i in (1001, 1002, 1003)] == [True] * 3 and not any(by[i]["kept"] for i in (1001, 1002, 1003))
    assert quality.quality(docs.limit(0)).collect() == []


def test_moderate_outliers(spark):
    """Texts of about two symbols in five words go, of which no symbol more than one a word has to be; ordinary ones stay."""
    r = random.Random(9)
    words = lambda n: ["".join(r.choices("abcdefghij", k=r.randint(2, 9))) for _ in range(n)]
    rows = [(i, " ".join(words(r.randint(60, 400))), "en", "s") for i in range(300)]
    rows += [(1000 + i, " ".join(w + "#" * (j % 5 < 2) for j, w in enumerate(words(200))), "en", "s") for i in range(5)]
    got = {x["doc_id"]: x for x in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)).collect()}
    assert all(got[i]["kept"] for i in range(300))
    for i in range(1000, 1005):
        assert not got[i]["base_failed"] and got[i]["distance"] < 90 and not got[i]["kept"], got[i]
