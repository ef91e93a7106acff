from __future__ import annotations

import duckdb

from tessella.llm import chat
from tessella.llm.queries import ORACLE_SQL

SCHEMA = "conv_id long, turn long, role string, text string, n int"
ROWS = [
    (1, 0, "user", "hi", 1), (1, 1, "assistant", "hello", 1), (1, 2, "user", "é?", 1), (1, 3, "assistant", "déjà", 1), (1, 4, "user", "bye", 1),
    (2, 0, "assistant", "alone", 1), (3, 0, "user", "no answer", 1), (4, 0, "system", "", 1), (4, 1, "user", None, 1), (4, 2, "assistant", "", 1),
    (5, 0, "user", "same", 1), (5, 1, "assistant", "same", 1), (6, 0, None, "x", 1), (6, 1, "assistant", "y" * 50_000, 1), (7, 0, "assistant", "a", 1), (7, 0, "assistant", "a", 1), (None, 0, "user", "x", 1),
]


def show(turns):
    return "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns)


def masked(text, spans):
    return [text[int(a) : int(b)] for a, b in (s.split(":") for s in spans.split(",") if s)]


def slow(convs):
    out = {}
    for key, turns in convs.items():
        turns = sorted((n, r or "", t or "") for n, r, t in turns)
        c = [(r, t) for _, r, t in turns]
        w = list(c)
        if last := [i for i, (r, _) in enumerate(c) if r == "assistant"]:
            w[last[-1]] = ("assistant", c[last[-1] - 1][1] if last[-1] else "")
        n = 0
        while n < len(c) and c[n] == w[n]:
            n += 1
        out[key] = (n, show(c[:n]), show(c[n:]), [t + "<|im_end|>" for r, t in c[n:] if r == "assistant"], show(w[n:]), [t + "<|im_end|>" for r, t in w[n:] if r == "assistant"])
    return out


def test_preference_pairs(spark):
    turns = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    convs = {}
    for c, n, r, t, _ in ROWS:
        if c is not None:
            convs.setdefault(c, []).append((n, r, t))
    rows = chat.preference_pairs(turns, chat.parroted(turns)).collect()
    got = {r["pair_id"]: (r["n_prefix"], r["prompt"], r["chosen"], masked(r["chosen"], r["chosen_spans"]), r["rejected"], masked(r["rejected"], r["rejected_spans"])) for r in rows}
    assert got == slow(convs) and len(rows) == len(convs)
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar, n int)")
    con.executemany("insert into conversations values (?, ?, ?, ?, ?)", ROWS)
    names = ["pair_id", "n_prefix", "prompt", "chosen", "chosen_spans", "rejected", "rejected_spans"]
    assert sorted(con.execute(ORACLE_SQL["op2_preference_chat"]).fetchall()) == sorted(tuple(r[n] for n in names) for r in rows)


def test_sides(spark):
    chosen = spark.createDataFrame([(1, 0, "user", "q", 0), (1, 1, "assistant", "a", 0), (2, 0, "user", "q", 0), (9, 0, "user", "q", 0)], SCHEMA)
    rejected = spark.createDataFrame([(1, 0, "user", "q", 0), (2, 0, "user", "q", 0), (2, 1, "assistant", "b", 0), (8, 0, "user", "q", 0)], SCHEMA)
    got = {r["pair_id"]: r for r in chat.preference_pairs(chosen, rejected).collect()}
    assert set(got) == {1, 2}
    assert got[1]["prompt"] == got[2]["prompt"] == show([("user", "q")])
    assert (got[1]["chosen"], got[1]["rejected"]) == (show([("assistant", "a")]), "")
    assert (got[2]["chosen"], got[2]["chosen_spans"], got[2]["rejected_spans"]) == ("", "", "22:33")
    assert chat.preference_pairs(chosen.limit(0), rejected).collect() == []
