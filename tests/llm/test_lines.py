from __future__ import annotations

import random
from collections import defaultdict

import duckdb
import pytest

from tessella.llm import lines
from tessella.llm.queries import ORACLE_SQL

SCHEMA = "doc_id long, text string, source string, n_lines string"


def slow(rows, sites):
    seen, first = defaultdict(set), {}
    key = lambda r: (r[0] is not None, r[0] or 0)
    for r in sorted(rows, key=key):
        for pos, line in enumerate((r[1] or "").split("\n")):
            if body := line.translate(str.maketrans("\t\r\v\f", "    ")).strip(" "):
                seen[body].add(r[2] or "")
                first.setdefault(body, (r[0], pos))
    out = []
    for doc, text, *_ in rows:
        if text is None:
            out.append((doc, None, 1, 0))
            continue
        held = text.split("\n")
        stay = [x for p, x in enumerate(held) if not (b := x.translate(str.maketrans("\t\r\v\f", "    ")).strip(" ")) or len(seen[b]) < sites or first[b] == (doc, p)]
        out.append((doc, "\n".join(stay), len(held), len(held) - len(stay)))
    return out


def made():
    r = random.Random(3)
    common = [f"footer {i}" for i in range(30)]
    rows = []
    for i in range(120):
        own = [f"line {i} {j}" for j in range(r.randint(0, 4))] + r.choices(common, k=r.randint(0, 6)) + ["", "  ", " Licence \t"]
        r.shuffle(own)
        rows.append((i, "\n".join(own), f"s{r.randrange(14)}", "x"))
    return rows + [(500, None, None, "x"), (501, "", "s1", None), (502, "Licence", None, "x"), (502, "Licence", None, "x"), (None, "Licence\nx", "s3", "x"), (503, "footer 1\n" * 2000, "s1", "x")]


@pytest.mark.parametrize("sites", [2, 5, 10, 13])
@pytest.mark.parametrize("near", [0.1, 5.0])
def test_line_dedup(spark, sites, near):
    docs = spark.createDataFrame(made(), SCHEMA).repartition(3)
    out = lines.line_dedup(docs, sites, near=near)
    assert out.columns == ["doc_id", "text", "source", "n_lines", "n_removed"]
    got = [(r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in out.collect()]
    assert sorted(got, key=str) == sorted(slow(made(), sites), key=str)


def test_the_sql_agrees(spark):
    rows = [r for r in made() if r[0] is not None and r[1] is not None and r[0] != 502]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, source varchar, n varchar)")
    con.executemany("insert into documents values (?, ?, ?, ?)", rows)
    want = con.execute(ORACLE_SQL["op7_line_dedup"]).fetchall()
    assert sorted(want) == sorted(slow(rows, 10))


def test_many_sites_are_estimated(spark):
    rows = [(i, "everywhere\nonly {i}", f"site {i}") for i in range(3000)] + [(i, f"rare {i}", "s") for i in range(3000, 3100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    assert lines.line_dedup(docs, 2000).where("n_removed > 0").count() == 2999
    assert lines.line_dedup(docs, 3001).where("n_removed > 0").count() == 0
    assert lines.line_dedup(docs.limit(0)).collect() == []
