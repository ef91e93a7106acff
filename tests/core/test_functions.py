from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.functions import vectors as V
from tessella.operators import parsing, profile, rewards, traces


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*[F.lit(x) for x in v]).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("items", "said"), [(["a"], "a"), (["a", "b"], "a and b"), (["a", "b", "c"], "a, b, and c"), (["a", "b", "c", "d"], "a, b, c, and d")])
def test_english_list(spark, items, said):
    assert one(spark, T.english_list(F.col("v")), v=items) == said


@pytest.mark.parametrize(("s", "part", "at"), [("banana", "an", 4), ("banana", "x", 0), ("abc", "abc", 1), ("", "a", 0)])
def test_last_position(spark, s, part, at):
    assert one(spark, T.last_position(F.col("s"), F.col("p")), s=s, p=part) == at


def test_sections_and_tags(spark):
    assert one(spark, T.section(F.col("s"), "Final Response"), s="## Thinking x\n## final response\n B \n") == "B"
    assert one(spark, T.section(F.col("s"), "Final (R)"), s="## Final (R) C") == "C"
    assert one(spark, T.section(F.col("s"), "Final"), s="nothing") is None
    assert one(spark, T.tag(F.col("s"), "answer"), s="<answer> A\n</answer><answer>B</answer>") == "A"
    assert one(spark, T.without_think(F.col("s")), s="<think>no</think> <answer>B</answer>") == "B"
    assert one(spark, T.without_control(F.col("s")), s="<|im_start|>x<|im_end|>\n") == "x"
    assert one(spark, T.without_tool_calls(F.col("s")), s="a<tool_call>{}\n</tool_call>b") == "ab"


def test_nfkc(spark):
    assert one(spark, T.nfkc(F.col("s")), s="ＡＢＣ  ﬁn\tX") == "abc fin x"


@pytest.mark.parametrize(("p", "g", "f1"), [("a b b", "b b c", 2 / 3), ("x", "y", 0.0), ("", "y", 0.0), ("same text", "Same TEXT", 1.0)])
def test_token_f1(spark, p, g, f1):
    assert one(spark, T.token_f1(F.col("p"), F.col("g")), p=p, g=g) == pytest.approx(f1)


CASES = [
    ("b", "b", "answer_section:explicit", False), ("the correct option is c, final answer: d", "D", "full_text:explicit", True), ("## Final Response\nred", "A", "answer_section:option_text", True),
    ("red then blue", "B", "full_text:option_text", True), ("## Final Response\nI say (C)", "C", "answer_section:single_letter", True), ("## Final Response\nA or C", None, "unparsed", True), ("", None, "unparsed", True),
]


@pytest.mark.parametrize(("text", "pred", "source", "check"), CASES)
def test_mcq_rules(spark, text, pred, source, check):
    options = F.create_map(F.lit("A"), F.lit("Red"), F.lit("B"), F.lit("blue"), F.lit("C"), F.lit(" "))
    got = one(spark, parsing.mcq(F.col("s"), options), s=text)
    assert got["pred"] == (pred if check else "B")
    assert not check or got["parse_source"] == source


def test_letters(spark):
    assert one(spark, parsing.letter(F.col("s")), s="A patient took B") == "A"
    assert one(spark, parsing.letter(F.col("s")), s=" c ") == "C"
    assert one(spark, parsing.letter(F.col("s"), "J"), s="surely H.") == "H"
    assert one(spark, parsing.tag_letter(F.col("s")), s="<answer>The one</answer>") == "E"
    assert one(spark, parsing.tag_letter(F.col("s")), s="<answer>b) yes</answer>") == "B"
    assert one(spark, parsing.trace_letter(F.col("s")), s="<answer>dog</answer>") is None
    assert one(spark, parsing.yes_no_maybe(F.col("s")), s="## Final Response\nI think no way")["pred"] == "no"
    assert one(spark, parsing.options_from_literal(F.col("s")), s="{'A': 'x'}") == {"A": "x"}
    assert one(spark, parsing.options_from_literal(F.col("s")), s="oops") == {}


@pytest.mark.parametrize(("pred", "reward"), [("Gold Text", 1.0), ("b. because", 1.0), ("B", 1.0), ("so the answer is B then", 0.8), ("it is gold text surely", 0.5), ("", 0.0), ("gold thing", 0.5)])
def test_answer_reward(spark, pred, reward):
    assert one(spark, rewards.answer(F.col("p"), F.col("g"), F.col("i")), p=pred, g="gold text", i="B") == pytest.approx(reward)


def test_other_rewards(spark):
    assert one(spark, rewards.form(F.col("s"), F.lit(1), F.lit(1)), s="<think>x</think><answer>B</answer>") == pytest.approx(1.25)
    assert one(spark, rewards.structure(F.col("s")), s="<answer>" + "w " * 11 + "</answer>") == pytest.approx(0.5)
    assert one(spark, rewards.tool_quality(F.lit(1), F.lit(0.95), F.lit(0.9), F.lit(True)), s="") == pytest.approx(0.10 + 0.069 + 0.1155 + 0.05)
    assert one(spark, rewards.tool_quality(F.lit(0), F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(False), -0.4), s="") == -0.4
    assert one(spark, rewards.grounded(F.col("a"), F.col("b")), a="alpha beta gamma", b="gamma beta alpha delta") is True


def test_vectors(spark):
    assert one(spark, V.dot(F.col("a"), F.col("b")), a=[1.0, 2.0], b=[3.0, 4.0]) == 11.0
    assert one(spark, V.normalized(F.col("a")), a=[0.0, 0.0]) == [0.0, 0.0]
    assert one(spark, V.max_sim(F.array(F.col("a"), F.col("b")), F.array(F.col("a"))), a=[1.0, 0.0], b=[0.0, 2.0]) == 0.5


def slow_spans(ids, opening, closing):
    out = []
    for i in range(len(ids) - len(opening) + 1):
        if ids[i : i + len(opening)] == opening:
            start = i + len(opening)
            out.append((start, next((j + 1 for j in range(start, len(ids)) if ids[j] == closing), len(ids))))
    return out


@pytest.mark.parametrize("ids", [[1, 2, 5, 6, 9, 1, 2, 7], [1, 2], [5], [1, 2, 9], [1, 1, 2, 3, 9, 9]])
def test_spans_and_masks(spark, ids):
    got = one(spark, traces.assistant_spans(F.col("v"), [1, 2], 9), v=ids)
    assert [(x["start"], x["end"]) for x in got] == slow_spans(ids, [1, 2], 9)
    labels = one(spark, traces.masked_labels(F.col("v"), traces.assistant_spans(F.col("v"), [1, 2], 9), 4), v=ids)
    want = [x if any(a <= i < b for a, b in slow_spans(ids, [1, 2], 9)) else -100 for i, x in enumerate(ids)]
    assert labels == want[-4:]


def test_profile(spark):
    df = spark.createDataFrame([("a", v) for v in (1, 2, 3, 4, 100)] + [("b", 7)], "k string, v long")
    s = {x["k"]: x for x in profile.summary(df, "v", ["k"]).collect()}
    assert (s["a"]["p50"], s["a"]["iqr"], s["b"]["std"]) == (3.0, 2.0, 0.0)
    b = {x["k"]: (x["low"], x["high"]) for x in profile.box(df, "v", ["k"]).collect()}
    assert b == {"a": (1.0, 4.0), "b": (7.0, 7.0)}
    assert sum(x["n"] for x in profile.histogram(df, "v", 10).collect()) == 6
