"""Raw tool calls, the loop with tools, adapters, evaluation with failures, token columns, the handle and the loader."""

from __future__ import annotations

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tessella.operators import adapters, evaluation, rewards, token_counts, tool_calls
from tessella.serving import Searcher
from tessella.sources import readers, sinks

TOOL = tool_calls.TOOL


def call(arguments, name=TOOL, **more):
    return {"type": "function", "function": {"name": name, "arguments": arguments} if arguments is not ... else {"name": name}} | more


CALLS = [
    call('{"query": "two words"}', id="a"), call({"query": "two words", "k": 1}), call({"query": "one"}), call({"query": " ".join("w" * 25)}), call({"query": " ".join("w" * 26)}), call({"query": 7}),
    call({"query": None}), call({"q": "two words"}), call(["two words"]), call('["two words"]'), call('"two words"'), call("{bad"), call(""), call(None), call(...), call({"query": "two words"}, "other"), call({"query": "two words"}, None, id=None),
    {"function": "x"}, {}, "text", 5, call('{"query": "a \\"quoted\\" é"}', id=3),
]


def slow_ok(c):
    try:
        f = c["function"]
        args = f["arguments"]
        args = json.loads(args) if isinstance(args, str) else args
        return f["name"] == TOOL and isinstance(args["query"], str) and 2 <= len(args["query"].split()) <= 25
    except (KeyError, TypeError, ValueError):
        return False


def test_gates_of_calls_one_by_one(spark):
    rows = [(i, json.dumps([c])) for i, c in enumerate(CALLS)]
    m = tool_calls.with_calls(spark.createDataFrame(rows, "i int, tool_calls string"))
    assert {r["i"]: r["call_ok"] for r in m.collect()} == {i: slow_ok(c) for i, c in enumerate(CALLS)}


def test_several_calls_and_none(spark):
    rows = [(0, json.dumps([CALLS[0], CALLS[1]])), (1, json.dumps([CALLS[0], CALLS[2]])), (2, "[]"), (3, None), (4, "{not json"), (5, '{"a": 1}')]
    got = {r["i"]: (r["called"], r["call_ok"]) for r in tool_calls.with_calls(spark.createDataFrame(rows, "i int, tool_calls string")).collect()}
    assert got == {0: (True, True), 1: (True, False), **{i: (False, None) for i in (2, 3, 4, 5)}}


def test_cleaned_messages(spark):
    good, more = call('{"query": "alpha"}', id="x"), call({"query": "beta", "b": 1})
    rows = [
        (0, "assistant", None, json.dumps([good]), "kept?"), (1, "assistant", " \n", json.dumps([good, more]), None), (2, "assistant", "said", json.dumps([more, call({}, id=None)]), None), (3, "tool", "result", None, "x"),
        (4, "tool", None, None, ""), (5, "user", None, json.dumps([good]), None), (6, "assistant", "", json.dumps([call("{bad")]), None), (7, "assistant", "", "[]", None),
    ]
    got = {r["seq"]: r for r in tool_calls.cleaned(spark.createDataFrame(rows, "seq int, role string, content string, tool_calls string, tool_call_id string")).collect()}
    one, many, none = "<think>\nI need to look up information about alpha.\n</think>", "<think>\nI need to search for multiple concepts:\n- alpha\n- beta\n</think>", tool_calls.THOUGHT_NONE
    assert [got[i]["content"] for i in range(8)] == [one, many, "said", "result", "", "", none, ""]
    ids = lambda i: [c["id"] for c in got[i]["tool_calls"]] if got[i]["tool_calls"] else None
    assert [ids(i) for i in range(8)] == [["x"], ["x", "call_1"], ["call_0", None], None, None, ["x"], ["call_0"], None]
    assert [got[i]["tool_call_id"] for i in (0, 3, 4)] == [None, "x", None]
    second = got[1]["tool_calls"][1]
    assert second["type"] == "function" and second["function"]["name"] == TOOL and json.loads(second["function"]["arguments"]) == {"query": "beta", "b": 1}
    assert got[1]["tool_calls"][0]["function"]["arguments"] == '{"query": "alpha"}'


def slow_loop(question, outputs, search, most):
    """One conversation at a time."""
    messages, texts, answers, n = [("user", question)], [], [], 0
    for turn in range(most + 1):
        if turn >= len(outputs):
            return messages, n, texts, answers, turn + 1, "silent"
        said, found = outputs[turn], []
        for inner in re.findall(tool_calls.TAGGED, said):
            try:
                found.append(json.loads(inner))
            except ValueError:
                pass
        messages.append(("assistant", said))
        if not found or turn == most:
            return messages, n, texts, answers, turn + 1, "turns" if found else "answered"
        n += len(found)
        for c in found:
            try:
                args = c.get("arguments", {})
                args = json.loads(args) if isinstance(args, str) else args
                if not isinstance(args, dict):
                    raise TypeError("arguments are no object")
                query = args.get("query", "")
                if query:
                    texts.append(query)
                result = search(query)
            except ValueError:
                result = "ERROR: arguments are not JSON"
            except (TypeError, LookupError) as e:
                result = f"ERROR: {e.args[0]}"
            answers.append(result)
            messages.append(("user", f"<tool_response>\n{result}\n</tool_response>"))
    raise AssertionError


@pytest.mark.parametrize("most", [0, 1, 3])
def test_tool_loop(spark, most):
    r = random.Random(most)
    tag = lambda args: f'<tool_call>\n{{"name": "s", "arguments": {args}}}\n</tool_call>'
    parts = [tag('{"query": "k1"}'), tag('"{\\"query\\": \\"k2\\"}"'), tag('{"query": "gone"}'), tag('"{oops"'), tag("[1]"), tag("null"), tag("{}"), '<tool_call>{"name": "s"}</tool_call>', "<tool_call>{bad}</tool_call>", "words "]
    outputs = {i: ["".join(r.choices(parts, k=r.randint(1, 3))) if r.random() < 0.8 else "<answer>A</answer>" for _ in range(r.randint(0, 5))] for i in range(60)}
    table = {"k1": "fact one", "k2": "fact two", "": "nothing asked"}

    def search(q):
        if q not in table:
            raise LookupError(f"no {q}")
        return table[q]

    want = {i: slow_loop(f"q{i}", outputs[i], search, most) for i in outputs}
    start = spark.createDataFrame([(i, [("user", f"q{i}")]) for i in outputs], "conv_id long, messages array<struct<role:string,content:string>>")
    said = spark.createDataFrame([(i, t, s) for i, o in outputs.items() for t, s in enumerate(o)], "conv_id long, turn int, generated string")
    known = spark.createDataFrame([*table.items()], "query string, result string")
    asked = []

    def retrieve(queries):
        rows = [x["query"] for x in queries.collect()]
        asked.append(rows)
        assert len(rows) == len({*rows})
        return queries.join(known, "query", "left").withColumn("error", F.when(F.col("result").isNull(), F.concat(F.lit("no "), "query")))

    done = tool_calls.tool_loop(start, lambda open_, turn: open_.join(said.where(F.col("turn") == turn), "conv_id"), retrieve, most)
    got = {x["conv_id"]: ([tuple(m) for m in x["messages"]], x["n_tool_calls"], x["query_texts"], x["tool_responses"], x["n_turns"], x["stop"]) for x in done.collect()}
    assert got == want and len(asked) <= most
    if most:
        assert {w[5] for w in want.values()} == {"answered", "turns", "silent"}


def test_queries_of_a_trace(spark):
    t = lambda q: f'<tool_call>{{"arguments": {{"query": "{q}"}}}}</tool_call>'
    rows = [(1, 0, t("a") + t("b") + t("a"), json.dumps([call({"query": "a"}), call({"query": "a"}), call({"query": ""})])), (1, 1, t("c") + t("b"), json.dumps([call('{"query": "c"}')])), (2, 0, None, None), (3, 0, t(""), "[]")]
    got = {r["conv_id"]: r["queries"] for r in tool_calls.trace_queries(spark.createDataFrame(rows, "conv_id int, seq int, content string, tool_calls string")).collect()}
    assert got == {1: ["a", "a", "b", "c"], 2: [], 3: []}


def test_tool_signals(spark):
    """One trace whose thought after the tool uses its words, one whose thought comes before, one without calls."""
    c = json.dumps([call({"query": "heart pills"})])
    rows = [
        (1, 0, "assistant", "<think>plan</think>", c), (1, 1, "tool", "aspirin thins blood platelets quickly", None), (1, 2, "assistant", "<think>aspirin thins blood platelets</think>", None),
        (2, 0, "assistant", "<think>aspirin thins blood platelets</think>", c), (2, 1, "tool", "aspirin thins blood platelets quickly", None), (2, 2, "assistant", "done", None), (3, 0, "assistant", "x", None),
    ]
    m = spark.createDataFrame(rows, "conv_id int, seq int, role string, content string, tool_calls string")
    q = spark.createDataFrame([(1, "heart?", "aspirin"), (2, "heart?", None), (3, "", "b")], "conv_id int, question string, answer string")
    axis = F.when(F.col("text").startswith("heart"), F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.6), F.lit(0.8)))
    got = {r["conv_id"]: (r["n_calls"], r["query_sim"], r["retrieval_sim"], r["grounded"]) for r in rewards.tool_signals(m, q, lambda t: t.withColumn("vector", axis)).collect()}
    assert got == {1: (1, 1.0, pytest.approx(0.6), True), 2: (1, 1.0, None, False), 3: (0, None, None, False)}


def test_adapters_have_every_style(spark):
    rows = spark.createDataFrame([("q?", {"B": "two", "A": "one", "E": "five"}, "a")], "question string, options map<string,string>, answer_idx string")
    a = adapters.ADAPTERS["four"]
    n = a.normalize(rows)
    texts = {name: n.select(a.prompt(style)).first()[0] for name, style in adapters.STYLES.items()}
    assert texts["huatuo"] == texts["medreason"] == texts["custom"] != texts["think_tag"]
    assert texts["huatuo"].endswith("Question:\nq?\n\nOptions:\nA. one\nB. two\n") and "## Thinking" in texts["huatuo"] and "<think>" in texts["think_tag"]
    assert n.select(a.fallback(F.lit("draft"))).first()[0].endswith("Options:\nA. one\nB. two\n\nDraft response:\ndraft")


def test_a_second_try_is_read_only_where_the_first_gave_nothing(spark):
    rows = spark.createDataFrame([("q", {"A": "one"}, "a", "Final answer: A", "Final answer: B"), ("q", {"A": "one"}, "a", "hm", "Final answer: A"), ("q", {"A": "one"}, "a", "hm", None)], "question string, options map<string,string>, answer_idx string, output string, again string")
    done = adapters.predictions(rows, adapters.ADAPTERS["four"], adapters.STYLES["custom"], "output", "again")
    assert [(r["pred"], r["parse_source"], r["fallback_used"], r["correct"]) for r in done.collect()] == [("A", "full_text:explicit", False, True), ("A", "fallback_extract", True, True), (None, "unparsed", True, False)]
    assert tuple(adapters.run_summary(done, []).first()) == (3, 2, 0.666667, 1, 2, 1)


def test_models_that_fail_leave_a_row(spark):
    docs = spark.createDataFrame([(i, [1.0, i / 10]) for i in range(10)], "id long, text array<double>")
    asks = spark.createDataFrame([(0, [0.0, 1.0]), (1, [0.0, -1.0])], "query_id long, text array<double>")
    plain = lambda t: t.withColumnRenamed("text", "vector")
    flipped = lambda t: t.withColumn("vector", F.transform("text", lambda x: -x))
    bad = lambda t: t.withColumn("vector", F.when(F.col("id") > 3, F.raise_error(F.lit("boom"))).otherwise(F.col("text")))

    def gone(t):
        raise OSError("no such model")

    judge = lambda found: found.withColumn("match", F.col("id") == 9)
    rows = evaluation.over_models({"flipped": (flipped, plain), "gone": (gone, plain), "plain": (plain, plain), "bad": (bad, plain)}, docs, asks, judge, 5).collect()
    assert [r["model"] for r in rows] == ["flipped", "plain", "bad", "gone"] and [r["error"] is None for r in rows] == [True, True, False, False]
    assert (rows[1]["n"], rows[1]["hit_5"], rows[1]["mrr_20"]) == (2, 0.5, 0.5) and rows[3]["error"] == "OSError: no such model"


def test_token_columns(spark):
    rows = spark.createDataFrame([(0, "id7", "what is it", None, "think hard", "yes!"), (1, None, "q", "own", "ignored", "a")], "row_idx int, id string, question string, reasoning string, Complex_CoT string, Answer string")
    got = [r.asDict() for r in token_counts.token_columns(rows, "d").orderBy("row_idx").collect()]
    assert [(g["source_id"], g["question_tokens"], g["reasoning_tokens"], g["response_tokens"]) for g in got] == [("id7", 3, 2, 2), (None, 1, 1, 1)]
    # Marks of sections: two times ##, and three words.
    assert got[0]["completion_tokens"] == 2 + 2 + 4 + 3 and got[0]["full_tokens"] > got[0]["prompt_tokens"] + got[0]["completion_tokens"]
    with pytest.raises(KeyError):
        token_counts.texts(rows.drop("question"))


def test_token_columns_by_a_tokenizer(spark):
    tokenizers = pytest.importorskip("tokenizers")
    names = pytest.importorskip("public_tokenizers")
    path = names.path("word_bpe_49k.json")
    rows = [(i, "some words of text " * i, "more", "é ü") for i in range(5)] + [(9, "", "", "")]
    df = spark.createDataFrame(rows, "row_idx int, question string, reasoning string, answer string").repartition(2)
    encode = tokenizers.Tokenizer.from_file(path).encode
    got = {r["row_idx"]: (r["question_tokens"], r["response_tokens"]) for r in token_counts.token_columns(df, "d", count=token_counts.tokenizer(path)).collect()}
    assert got == {i: tuple(len(encode(t, add_special_tokens=False).ids) for t in (q, a)) for i, q, _, a in rows}


@pytest.fixture()
def search(spark):
    hedges = spark.createDataFrame([(f"h{i}", f"fact {i} on topic{i % 3}", "r", "t", f"e{i}", [f"e{i}", f"e{(i + 1) % 6}"]) for i in range(6)], "id string, description string, relation string, type string, anchor string, entities array<string>")
    vector = lambda i: [float(i % 3 == j) for j in range(3)]
    hv = spark.createDataFrame([(f"h{i}", vector(i)) for i in range(6)], "id string, vector array<double>")
    ev = spark.createDataFrame([(f"e{i}", vector(i)) for i in range(6)], "id string, vector array<double>")
    index = spark.createDataFrame([(e, f"h{i}", p) for i in range(6) for p, e in enumerate([f"e{i}", f"e{(i + 1) % 6}"])], "name string, id string, pos int")
    n = F.regexp_extract("text", "topic([0-9])", 1)
    encode = lambda rows: rows.withColumn("vector", F.when(n == "0", F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))).when(n == "1", F.array(F.lit(0.0), F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0))))
    return Searcher(spark, lambda: {"hedges": hedges, "hedge_vectors": hv, "entity_vectors": ev, "index": index}, encode)


REQUESTS = "request_id string, queries array<string>, top_k int"


def test_batch_and_stream_give_the_same(spark, search, tmp_path):
    rows = [("a", ["about topic0", "about topic1"], 2), ("b", ["about topic0"], None), ("c", [], 3), ("d", ["about topic2", ""], 1)]
    batch = search.search(spark.createDataFrame(rows, REQUESTS)).collect()
    got = {(r["request_id"], r["pos"]): r["results"] for r in batch}
    assert sorted(got) == [("a", 0), ("a", 1), ("b", 0), ("d", 0), ("d", 1)]
    assert [len(got[k]) for k in (("a", 0), ("b", 0), ("d", 0))] == [2, 5, 1] and got["a", 0][0].endswith("topic0") and got["d", 0][0].endswith("topic2")
    for i, row in enumerate(rows):
        spark.createDataFrame([row], REQUESTS).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    running = search.stream(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    with pytest.raises(RuntimeError):
        search.reset()
    search.closed(running)
    again = spark.read.parquet(f"{tmp_path}/out").select(*batch[0].asDict()).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, batch)) and search.loads == 1


def test_reset_frees_the_tables(spark, search):
    one = spark.createDataFrame([("a", ["about topic0"], 1)], REQUESTS)
    first = search.search(one).collect()
    assert search.health() == {"status": "ok", "hyperedges": 6, "entities": 6}
    files = [f for t in search.tables().values() for f in t.inputFiles()]
    exists = lambda: [spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f.rpartition("/")[0]).count() for f in files]
    assert all(exists())
    search.reset()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        exists()
    assert search.search(one).collect() == first and search.loads == 2


def test_loader_by_kind(spark, tmp_path):
    rows = lambda *ids: spark.createDataFrame([(i, f"t{i}") for i in ids], "id long, text string")
    sinks.parquet(rows(1), f"{tmp_path}/flat")
    for split, ids in (("test", (2,)), ("train", (3, 4))):
        sinks.parquet(rows(*ids), f"{tmp_path}/splits/{split}")
        sinks.jsonl(rows(*ids), f"{tmp_path}/configs/en/{split}")
        sinks.jsonl(rows(9), f"{tmp_path}/configs/zh/{split}")
    (tmp_path / "lines.jsonl").write_text('{"id": 5, "text": "t5"}\n')
    ids = lambda df: sorted((r["id"], r["split"] if "split" in df.columns else None) for r in df.collect())
    assert ids(readers.loaded(spark, f"{tmp_path}/flat")) == [(1, None)]
    assert ids(readers.loaded(spark, f"{tmp_path}/splits")) == [(2, "test"), (3, "train"), (4, "train")] == ids(readers.loaded(spark, f"{tmp_path}/configs", "en"))
    assert ids(readers.loaded(spark, f"{tmp_path}/configs")) == [(2, "test"), (3, "train"), (4, "train")]
    assert ids(readers.loaded(spark, f"{tmp_path}/lines.jsonl", schema="id long, text string")) == [(5, None)]
    for bad, error in ((("nothing",), FileNotFoundError), (("configs", "fr"), KeyError)):
        with pytest.raises(error):
            readers.loaded(spark, f"{tmp_path}/{bad[0]}", *bad[1:])
    assert readers.newest(spark, f"{tmp_path}/none*", f"{tmp_path}/s*", f"{tmp_path}/f*").endswith("splits")
    assert readers.split_of(readers.loaded(spark, f"{tmp_path}/splits")).count() == 1
