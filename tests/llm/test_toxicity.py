from __future__ import annotations

import random
from pathlib import Path

import numpy as np
import pytest

from tessella.llm import toxicity

DATA = "/root/testdata/sf0.1"


def test_ordinal_fit_finds_the_weights():
    g = np.random.default_rng(0)
    n, true, cuts = 6000, np.array([2.0, -1.5, 0.0]), np.array([-1.0, 0.5, 2.0])
    x = g.integers(0, 3, (n, 3)).astype(float)
    z = x @ true
    grades = (np.log(1 / g.random(n) - 1)[:, None] * -1 + z[:, None] > cuts).sum(axis=1)
    rows, columns = np.nonzero(x)
    w, t = toxicity.fit_ordinal(rows, columns, x[rows, columns], grades, 3, ridge=0.0, rounds=800)
    assert np.allclose(w, true, atol=0.25) and np.allclose(t, cuts, atol=0.3)
    assert (np.diff(t) > 0).all()


def test_expected_severity():
    m = toxicity.Model({"bad": 0}, np.array([3.0]), np.array([2.0, 3.0, 4.0]))
    one, many = m.above(toxicity.word_counts("Bad.")), m.above(toxicity.word_counts("bad bad BAD bad"))
    assert (np.diff(one) < 0).all() and (many > one).all()


def made(r, i, toxic):
    words = [r.choice(["alpha", "beta", "gamma", "delta"]) + r.choice(["", "x", "y"]) for _ in range(40)]
    if toxic:
        for _ in range(r.choice([1, 3, 9])):
            words[r.randrange(40)] = r.choice(["vile", "Awful!", "scum,"])
    return (i, " ".join(words), int(toxic), "x")


def test_made_labels(spark):
    r = random.Random(4)
    rows = [made(r, i, i % 5 == 0) for i in range(600)]
    docs = spark.createDataFrame([*rows, (900, None, 0, "x"), (901, "", 0, "x"), (None, "vile scum", 1, "x"), (0, rows[0][1], 1, "x")], "doc_id long, text string, toxic int, severity string")
    labels = spark.createDataFrame([(i, t) for i, _, t, _ in rows if i < 300] + [(None, 1), (5, None), (10**9, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == 604
    by = {x["doc_id"]: x for x in got}
    assert all(by[i]["toxic"] == bool(t) for i, _, t, _ in rows)
    assert not by[900]["toxic"] and not by[901]["toxic"] and by[None]["toxic"]
    mild = [by[i]["expected_severity"] for i, text, t, _ in rows if t and sum(w in text for w in ("vile", "Awful", "scum")) == 1]
    assert max(x["expected_severity"] for x in got) > np.mean(mild) > by[900]["expected_severity"]
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 600 - 120 + 2


def test_no_model(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for labels in ([], [(1, 0)], [(1, 1)]):
        frame = spark.createDataFrame(labels, "doc_id long, toxic int")
        assert [r["toxic"] for r in toxicity.toxicity(docs, frame).collect()] == [False]
    assert toxicity.toxicity(docs.limit(0), spark.createDataFrame([], "doc_id long, toxic int")).collect() == []


def test_texts_with_one_header(spark):
    """All labelled texts begin with the same 200 characters; exact copies count once a verdict."""
    r, header = random.Random(12), "one header of a hot source " * 8
    rows = [made(r, i, i % 4 == 0) for i in range(400)]
    rows = [(i, header + text, t, s) for i, text, t, s in rows]
    copies = [(1000 + i, rows[1][1], 0, "x") for i in range(50)]
    docs = spark.createDataFrame(rows + copies, "doc_id long, text string, toxic int, severity string")
    labels = spark.createDataFrame([(i, t) for i, _, t, _ in rows[:200] + copies], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert model is not None
    got = {x["doc_id"]: x["toxic"] for x in toxicity.score(docs, model).collect()}
    assert all(got[i] == bool(t) for i, _, t, _ in rows)


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the synthetic tables")
def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    held = labels.where("doc_id % 3 = 0")
    model = toxicity.fit(docs, labels.where("doc_id % 3 <> 0"))
    rows = toxicity.score(docs, model).join(held.withColumnRenamed("toxic", "want"), "doc_id").collect()
    hits = [(r["toxic"], bool(r["want"])) for r in rows]
    true = sum(a and b for a, b in hits)
    assert true / sum(b for _, b in hits) >= 0.85 and true / max(sum(a for a, _ in hits), 1) >= 0.9
