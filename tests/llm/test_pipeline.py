from __future__ import annotations

import random
from collections import defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from test_lines import slow as slow_lines
from test_packing import check_packed
from test_pii import slow_spans
from test_simhash import slow_components, slow_print
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from tessella.llm import pii

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
DATA = "/root/testdata/sf0.001"


def prose(r, n):
    return " ".join("".join(r.choices("abcdefghijklmnop", k=r.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    r = random.Random(11)
    rows, labels = [], []
    for i in range(160):
        text = "\n".join(prose(r, r.randint(5, 30)) for _ in range(4))
        if i % 4 == 0:
            text = text.replace(" ", " vile ", 4).replace(" ", " scum ", 2)
        if i % 5 == 1:
            text += "\nshared footer of many sites\nmail me at a.b@example.com or 10.0.0.1"
        rows.append((i, text, "en", f"s{i % 20}", len(text)))
        labels.append((i, int(i % 4 == 0), 1))
    for i in range(200, 212):
        rows.append((i, rows[7][1], "en", "s1", 1))  # copies
    rows += [(300, None, "en", None, None), (301, "", None, "s1", 0), (302, "x " * 20_000, "en", "s2", 40_000)]
    where = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{where}/labels.parquet")
    return where, rows


def test_every_stage_against_brute_force(spark, planted):
    where, rows = planted
    docs, kept = spark.read.parquet(f"{where}/documents.parquet"), rows
    columns = docs.columns
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, where)
        got = [tuple(x) for x in out.collect()]
        if name == "toxicity":
            kept = [x for x in rows if not (x[0] < 160 and x[0] % 4 == 0)]
        elif name == "line_dedup":
            new = {(d, t) for d, t, *_ in slow_lines([(d, t, s) for d, t, _, s, _ in kept], 10)}
            texts = dict(new)
            kept = [(d, texts[d], lang, s, None if texts[d] is None else len(texts[d])) for d, _, lang, s, _ in kept]
        elif name == "simhash":
            kept = sorted(kept)
            roots = slow_components([slow_print(x[1]) for x in kept])
            kept = [x for i, x in enumerate(kept) if roots[i] == i]
        elif name == "pii":
            masked = [pii.masked(x[1] or "", pii.joined(slow_spans(x[1] or ""))) for x in kept]
            kept = [(x[0], None if x[1] is None else m, x[2], x[3], None if x[1] is None else len(m)) for x, m in zip(kept, masked, strict=True)]
        else:
            check_packed(out.collect(), 4096)
            t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            lengths = defaultdict(int)
            for x in out.collect():
                lengths[x["doc_id"]] += x["length"]
            assert lengths == {x[0]: len(t.encode(x[1] or "", add_special_tokens=False).ids) + 1 for x in kept}
            break
        assert out.columns == columns
        assert sorted(got, key=str) == sorted(kept, key=str), name
        path = f"{where}/stage{n}.parquet"
        out.write.parquet(path)
        docs = spark.read.parquet(path)


def test_run_is_its_stages(spark, planted):
    where, _ = planted
    once = {tuple(x)[:5] for x in corpus_pipeline.run(spark, where).collect()}
    assert once == {tuple(x)[:5] for x in __spark_entry__.queries()["pipeline"](spark, where).collect()}
    assert len(once) > 50 and np.all([len(x) == 5 for x in once])


def test_packed_pieces_hold_their_tokens(spark, planted):
    """The ids of the last stage's pieces, joined, are those of each text."""
    where, _ = planted
    docs = spark.read.parquet(f"{where}/documents.parquet").where("doc_id between 200 and 205 or doc_id >= 300")
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {x["doc_id"]: t.encode(x["text"] or "", add_special_tokens=False).ids + [1] for x in docs.collect()}
    got = defaultdict(list)
    for x in sorted(corpus_pipeline.pack(spark, docs, where).collect(), key=lambda x: (x["doc_id"], x["piece"])):
        assert len(x["ids"]) == x["length"]
        got[x["doc_id"]] += x["ids"]
    assert got == want


def slow_similarity(a, b):
    x, y = ({tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
    return len(x & y) / len(x | y)


def test_near_copies_go(spark):
    """Copies with 1 to 12 of 200 words changed; those of similarity 0.8 and more go, the others stay."""
    r, rows, near = random.Random(13), [], set()
    for i in range(120):
        text = prose(r, 200)
        words = text.split()
        for at in r.sample(range(200), 1 + i % 12):
            words[at] = prose(r, 2).replace(" ", "")
        rows += [(2 * i, text, "en", "s", 1), (2 * i + 1, " ".join(words), "en", "s", 1)]
        if slow_similarity(text, rows[-1][1]) >= 0.8:
            near.add(2 * i + 1)
    assert 30 < len(near) < 80
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    kept = {x["doc_id"] for x in corpus_pipeline.dedup_near(spark, docs, "").collect()}
    assert kept == set(range(240)) - near


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the synthetic tables")
def test_queries_are_registered(spark):
    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op") and n[2].isdigit()} == {f"op{i}" for i in range(1, 11)}
    assert names["op5_tiff_media"](spark, DATA).count() == spark.read.parquet(f"{DATA}/documents.parquet").count()
