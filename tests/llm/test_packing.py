from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessella.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, length string, part string"
ODD = ["", " ", "Hello, World. it's 42 l'été", "a\tb\x0bc\x85d\xa0e\x1cf", "ΟΔΟΣ, ΟΔΟΣ.", "İİ, x İ ŉ ǰ ẖ ΐ ﬁ Ω K क़, क़ x क़क़.", "don't 'stop' <|endoftext|> x", "é ́x İstanbul.", "x" * 3000, "日本語 テスト。", "word,. ,a .b a..", "\n\n", "naïve  double  space", "<|startoftext|>", "a<|startoftext|>b <|endoftext|>", "One. Two<|endoftext|><|endoftext|> three, four", "<|ENDOFTEXT|> <|endoftext |>"]


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_word_ids_are_the_tokenizers(plain):
    got = packing.encoder(PATH)([*ODD, None])
    assert [np.frombuffer(b, "<u4").tolist() for b in got] == [plain(t) for t in ODD] + [[]]


def test_word_ids_survive_forgetting(plain, monkeypatch):
    monkeypatch.setattr(packing, "WORDS", 3)
    monkeypatch.setattr(packing, "STEMS", 3)
    encode = packing.WordEncoder(PATH)
    for _ in range(3):
        for text in ODD:
            assert np.frombuffer(encode([text])[0], "<u4").tolist() == plain(text)


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_piece_once(seed):
    r = random.Random(seed)
    capacity = r.choice([16, 64, 4096])
    counts = {r.randint(1, capacity): r.choice([1, 2, 3, 50, 1000]) for _ in range(r.choice([1, 3, 40, 400]))}
    kinds = packing.complement_plan(counts, capacity)
    used = Counter()
    for times, held in kinds:
        assert times > 0 and sum(length * n for length, n in held.items()) <= capacity
        for length, n in held.items():
            used[length] += times * n
    assert used == counts
    assert len(kinds) <= 2 * len(counts) * 12


def test_plan_fills_exact_complements():
    assert packing.complement_plan({10: 5, 6: 5}, 16) == [(5, {10: 1, 6: 1})]
    assert packing.complement_plan({9: 2, 4: 2, 3: 2, 8: 1}, 16)[0] == (2, {9: 1, 4: 1, 3: 1})
    assert sum(t for t, _ in packing.complement_plan({8: 3, 5: 3, 2: 3, 1: 3}, 16)) == 3
    assert packing.complement_plan({}, 16) == []


def test_plan_is_close_to_the_bound():
    r = random.Random(5)
    counts = Counter(min(4096, int(r.lognormvariate(6.5, 1))) or 1 for _ in range(50_000))
    n = sum(t for t, _ in packing.complement_plan(counts))
    assert n <= 1.002 * sum(k * v for k, v in counts.items()) / 4096 + 1


def check_packed(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in by.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity


def test_pack_documents(spark, plain):
    texts = [*ODD, None, "the cat sat on the mat " * 40, "the cat sat on the mat " * 40]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)] + [(3, texts[3], "x", "y"), (None, "a b", None, None)], SCHEMA).repartition(3)
    rows = packing.pack_documents(docs, PATH, capacity=50, keep_ids=True).collect()
    check_packed(rows, 50)
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], tuple(r["ids"]), r["ids_crc32"]))
    assert set(got) == {*range(len(texts)), None}
    for i, text in enumerate(texts):
        ids = plain(text or "") + [1]
        cut = [ids[a : a + 50] for a in range(0, len(ids), 50)]
        want = [(p, 50 * p, len(c), tuple(c), zlib.crc32(np.array(c, "<u4").tobytes())) for p, c in enumerate(cut)]
        assert sorted(got[i]) == sorted(want * (2 if i == 3 else 1))


def test_pack_nothing(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_hot_length(spark):
    docs = spark.createDataFrame([(i, "a b c") for i in range(3000)], "doc_id long, text string").repartition(7)
    rows = packing.pack_documents(docs, PATH, capacity=17).collect()
    check_packed(rows, 17)
    assert len({r["sequence_id"] for r in rows}) == 750
