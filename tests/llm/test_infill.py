from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tessella.llm import infill

SCHEMA = "doc_id long, text string, form string, output int"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def slow(doc, text, seed=7, rate=100, spm=50, marks=("<P>", "<S>", "<M>")):
    text = text or ""
    p, s, m = marks
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    d = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(d[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    if not text or any(x in text for x in marks) or h3 % 100 >= rate:
        return doc, n, "plain", None, None, text, sha(text), sha(text)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b, c = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    form = "spm" if h4 % 100 < spm else "psm"
    out = f"{s}{c}{p}{a}{m}{b}" if form == "spm" else f"{p}{a}{s}{c}{m}{b}"
    return doc, n, form, len(a), len(b), out, sha(out), sha(text)


def made():
    r = random.Random(5)
    lines = ["", "a", "é ü\t", "longer line of words", "< S>", "<", "<P", "P>", "S>x", "\r", "  not a line", "\x0b\x0c", "😀 two", "\x00"]
    rows = [(i, "\n".join(r.choices(lines, k=r.randint(0, 12))) + r.choice(["", "\n", "\n\n"]), "x", 1) for i in range(400)]
    rows += [(i, f"one <{c}> two\nthree", None, 2) for i, c in enumerate("PSMQ", 500)]
    return rows + [(600, None, "x", None), (601, "", "x", 1), (602, "\n", "x", 1), (602, "\n", "x", 1), (None, "no id\nat all\n", "x", 1), (603, "x" * 300_000 + "\n" + "y\n" * 200_000, "x", 1), (604, "z" * (5 << 20), "x", 1)]


def columns(rows):
    return sorted((tuple(r) for r in rows), key=str)


@pytest.mark.parametrize("how", [{}, {"seed": 11, "rate": 60, "spm": 20}, {"marks": ("[pre]", "{suf}", "(mid)")}])
def test_against_brute_force(spark, how):
    docs = spark.createDataFrame(made(), SCHEMA).repartition(3)
    got = infill.fill_in_middle(docs, **how)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256", "restored_sha256"]
    want = [slow(d, t, **how) for d, t, *_ in made()]
    assert columns(got.collect()) == columns(want)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}


def test_empty_tables_and_other_ids(spark):
    docs = spark.createDataFrame(made(), SCHEMA)
    assert infill.fill_in_middle(docs.limit(0)).collect() == []
    named = docs.select(F.concat(F.lit("k"), "doc_id").alias("key"), F.col("text").alias("body")).where("body is null or length(body) < 1000")
    got = infill.fill_in_middle(named, id_col="key", text_col="body")
    assert columns(got.collect()) == columns(slow(r["key"], r["body"]) for r in named.collect())


def test_marks_must_not_arise_between_parts(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for marks in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("aba", "<S>", "<M>"), ("<P>", ">S", "<M>"), ("<P", "<P>", "<M>")):
        with pytest.raises(ValueError):
            infill.fill_in_middle(docs, marks=marks)


def test_the_sql_agrees(spark):
    import duckdb

    from tessella.llm.queries import ORACLE_SQL

    rows = [(d, t) for d, t, *_ in made() if d is not None and (t is None or len(t) < 1000)]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    got = con.execute(ORACLE_SQL["op11_fill_in_middle"]).fetchall()
    keep = lambda r: r[:5] + r[6:]
    assert columns(got) == columns(keep(slow(d, t)) for d, t in rows)
