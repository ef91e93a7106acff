from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest

from tessella.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def v():
    return pieces.Vocabulary(PATH)


def slow(v, text):
    """Plain dynamic programming over the whole text: the best score, and the ids of one best way."""
    marked = pieces.marked(text)
    best = [0.0] + [float("-inf")] * len(marked)
    back = [0] * (len(marked) + 1)
    for end in range(1, len(marked) + 1):
        for start in range(max(0, end - v.longest), end):
            gain = v.score.get(marked[start:end])
            if gain is None:
                if end - start > 1:
                    continue
                gain = pieces.BYTES
            if best[start] + gain > best[end]:
                best[end], back[end] = best[start] + gain, start
    return best[-1]


def of(v, ids):
    return v.total(np.array(ids, np.int32).tobytes())


WORDS = ["the", "tion", "Überraschung", "naïve", "日本語", "x", "\n", "\n\n", "  ", "aaaaaaaaaaaaaaaaaaaaa", "zzzz", "ሴ", "😀", "▁", "a▁b", "\t", "international"]


def texts(n):
    r = random.Random(n)
    out = ["", " ", "a", "\n", "▁", "  lead", "trail  "]
    return out + [r.choice([" ", ""]).join(r.choices(WORDS, k=r.randint(1, 30))) for _ in range(n)]


def chunked(v, text, size):
    marked = pieces.marked(text)
    cuts = range(0, len(marked), size)
    parts = [(marked[c : c + size + v.longest], len(marked[c : c + size])) for c in cuts]
    states = pieces.borders([v.matrix(*p) for p in parts])
    return b"".join(v.encode(t, s, a, b) for (t, s), a, b in zip(parts, states, states[1:], strict=False))


@pytest.mark.parametrize("size", [1, 7, 16, 17, 40])
def test_chunks_are_as_good_as_the_whole(v, size):
    for text in texts(60):
        if not text:
            continue
        ids = np.frombuffer(chunked(v, text, size), np.int32).tolist()
        assert of(v, ids) == pytest.approx(slow(v, text))
        assert v.decode(ids).decode() == text.replace("▁", " ")


def test_whole_texts(v):
    for text in texts(200):
        marked = pieces.marked(text)
        ids = np.frombuffer(v.encode(marked, len(marked)), np.int32).tolist()
        assert (of(v, ids) if ids else 0) == pytest.approx(slow(v, text) if text else 0)
        assert v.decode(ids).decode() == text.replace("▁", " ")


def test_products_are_associative():
    g = np.random.default_rng(0)
    a, b, c = (np.where(g.random((5, 5)) < 0.3, pieces.LOW, g.integers(-9, 0, (5, 5)).astype(float)) for _ in range(3))
    assert (pieces.combine(pieces.combine(a, b), c) == pieces.combine(a, pieces.combine(b, c))).all()


def test_a_product_is_the_fold():
    g = np.random.default_rng(1)
    for n in (1, 2, 3, 7, 8):
        ms = [np.where(g.random((4, 4)) < 0.3, pieces.LOW, g.integers(-9, 0, (4, 4)).astype(float)) for _ in range(n)]
        whole = ms[0]
        for m in ms[1:]:
            whole = pieces.combine(whole, m)
        assert (pieces.product(ms) == whole).all()


def test_words_of_the_library_are_those_of_the_search(v):
    r = random.Random(4)
    words = ["".join(r.choices("aeiounrst▁lhé\n日x", k=r.randint(1, 14))) for _ in range(2000)] + ["\0" + "1", "▁", "▁▁▁", "😀a"]
    assert v.learn(words) == {w: v.word(w) for w in words}


@pytest.mark.parametrize("fan", [2, 3])
def test_levels_of_products(spark, v, fan):
    """Texts of up to some hundred chunks, whose states come down from several levels."""
    r = random.Random(9)
    rows = [(i, "".join(r.choices(["the", " ", "tion", "aaaa", "日本", "zz"], k=n))) for i, n in enumerate((3, 40, 90, 400, 11))]
    rows += [(5, rows[2][1]), (5, rows[2][1]), (None, rows[1][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {}
    for x in pieces.encode(docs, PATH, chunk=10, fan=fan).collect():
        got.setdefault((x["doc_id"], x["text_hash"]), {}).setdefault(x["chunk"], []).append(x["ids"])
    assert sorted(len(x[0]) for x in got.values()) == [1] * 6 + [2]
    for (doc, _), chunks in got.items():
        text = next(t for i, t in rows if i == doc)
        assert of(v, [j for c in sorted(chunks) for j in chunks[c][0]]) == pytest.approx(slow(v, text))


def test_encode(spark, v):
    rows = [(i, t, "x") for i, t in enumerate(texts(40))] + [(900, None, "x"), (3, texts(40)[3], "x"), (None, "the cat " * 30, "x"), (901, "the cat " * 30, "x"), (901, "the cat " * 30, "x"), (902, "x" * 3000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    coded = pieces.decode(pieces.encode(docs, PATH, chunk=50), PATH).collect()
    got = {}
    for r in coded:
        got.setdefault((r["doc_id"], r["text_hash"]), {}).setdefault(r["chunk"], []).append(r)
    total = 0
    for i, text, _ in rows:
        text = text or ""
        match = [x for (d, _), x in got.items() if d == i and b"".join(bytes(x[c][0]["text"]) for c in sorted(x)).decode() == text.replace("▁", " ")]
        assert match, text
        one = match[0]
        assert sorted(one) == list(range(one[0][0]["n_chunks"]))
        ids = [j for c in sorted(one) for j in one[c][0]["ids"]]
        if text:
            assert of(v, ids) == pytest.approx(slow(v, text))
        total += one[0][0]["n_chunks"]
        assert {len(x) for x in one.values()} == {rows.count((i, text or None, "x")) if text else 1} or i is None
    assert total == len(coded)
    assert pieces.encode(docs.limit(0), PATH).collect() == []


def test_decode_of_null_ids_and_other_columns(spark, v):
    ids = v.id["▁the"], v.id["▁the"]
    rows = [(0, [ids[0]], "x"), (1, [ids[0]], "x"), (0, None, None), (0, [], "y"), (None, [ids[1]], "z")]
    got = pieces.decode(spark.createDataFrame(rows, "chunk int, ids array<int>, text string"), PATH).collect()
    assert [None if r["text"] is None else bytes(r["text"]) for r in got] == [b"the", b" the", None, b"", b" the"]
