"""What one task holds and does, called on its batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tessella.operators import fuzzy
from tessella.operators import retrieval as R


def test_a_block_of_queries_is_compared_in_slices():
    rng = np.random.default_rng(1)
    q, c = rng.integers(-4, 5, (300, 3)).astype(float), rng.integers(-4, 5, (500, 3)).astype(float)
    one = lambda ids, m: [pa.array([ids], pa.list_(pa.int64())), pa.array([m.tobytes()], pa.binary())]
    batch = pa.RecordBatch.from_arrays([*one([*range(300)], q), *one([*range(500)], c)], names=["q_ids", "q_matrix", "ids", "matrix"])
    got = [*R._best(7, 6)(iter([batch]))]
    assert len(got) == 3
    rows = {(a, b) for x in got for a, b in zip(x["query_id"].to_pylist(), x["id"].to_pylist(), strict=True)}
    assert rows == {(i, int(j)) for i in range(300) for j in np.lexsort((np.arange(500), -(c @ q[i])))[:7]}


def test_a_terms_best_is_kept_over_all_of_a_tasks_names(monkeypatch):
    names = [f"Supplier#{i:09d}" for i in range(1, 400)] + ["", " a  b", "Supplier"]
    terms = [n[:4] + "x" + n[5:] for n in names[:40]] + ["b a", "nothing like it"]
    want = {}
    for t in terms:
        score, name = min((-fuzzy.weighted_ratio(t, n), n) for n in names if n)
        if -score >= 85:
            want[t] = (name, -score)
    calls = []
    ratio = fuzzy.weighted_ratio
    monkeypatch.setattr(fuzzy, "weighted_ratio", lambda a, b: calls.append(1) or ratio(a, b))
    batches = lambda: iter([pa.RecordBatch.from_arrays([pa.array([n for n in names if n][lo : lo + 50])], names=["name"]) for lo in range(0, len(names), 50)])
    got = [*fuzzy._matcher(terms, 85.0)(batches())]
    assert len(got) == 1
    assert {r["term"]: (r["name"], r["score"]) for r in got[0].to_pylist()} == want
    together = len(calls)
    calls.clear()
    for b in batches():
        [*fuzzy._matcher(terms, 85.0)(iter([b]))]
    assert together < 0.6 * len(calls)
