"""Tool calls as models send them: JSON text whose arguments are an object or a string that holds one.

A message has a column ``tool_calls`` with a JSON array, of which any part may be wrong; nothing is
rejected while reading. All of it is VARIANT expressions in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.sources.workdir import written

# The tool's name, and the thoughts that stand in for missing ones.
TOOL = "search_medical_knowledge"
THOUGHT_NONE = "<think>\nI need to search the medical knowledge graph for more information.\n</think>"
THOUGHT_ONE = ("<think>\nI need to look up information about ", ".\n</think>")
THOUGHT_MANY = ("<think>\nI need to search for multiple concepts:\n", "\n</think>")
#: Words of a query.
WORDS = (2, 25)


def _kind(v: Column) -> Column:
    """STRING, OBJECT, ARRAY and so on; null for what isn't there."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _text(v: Column) -> Column:
    """A string as it is, anything else as JSON with its keys in the order of their names."""
    return F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.to_json(v))


def calls(tool_calls: Column) -> Column:
    """An array of (id, has_id, name, arguments, query, n_words) of the calls in a JSON array; empty for null, an empty array or what isn't one.

    ``arguments`` is JSON text, null if there are none. ``query`` is text, null unless the arguments
    parse to an object with a query that is a string.
    """
    each = F.coalesce(F.try_variant_get(F.try_parse_json(tool_calls), "$", "array<variant>"), F.array().cast("array<variant>"))

    def one(call: Column) -> Column:
        given = F.try_variant_get(call, "$.function.arguments", "variant")
        # A string is parsed once more, so both forms end as the same value.
        value = F.try_parse_json(_text(given))
        query = F.try_variant_get(value, "$.query", "variant")
        said = F.when((_kind(value) == "OBJECT") & (_kind(query) == "STRING"), F.try_variant_get(query, "$", "string"))
        name = F.try_variant_get(call, "$.function.name", "variant")
        id_ = F.try_variant_get(call, "$.id", "variant")
        return F.struct(
            F.try_variant_get(id_, "$", "string").alias("id"),
            id_.isNotNull().alias("has_id"),
            F.when(_kind(name) == "STRING", F.try_variant_get(name, "$", "string")).alias("name"),
            _text(given).alias("arguments"),
            said.alias("query"),
        )

    return F.transform(each, one)


def well_formed(call: Column, tool: str = TOOL, words: tuple[int, int] = WORDS) -> Column:
    """Whether a call names the tool and has a query of the right number of words."""
    return (call["name"].eqNullSafe(F.lit(tool))) & F.coalesce(T.word_count(call["query"]).between(*words), F.lit(False))


def with_calls(messages: DataFrame, tool: str = TOOL, words: tuple[int, int] = WORDS) -> DataFrame:
    """``messages`` with calls, called (whether there is one) and call_ok (null without calls)."""
    c = messages.withColumn("calls", calls(F.col("tool_calls")))
    called = F.size("calls") > 0
    return c.withColumn("called", called).withColumn("call_ok", F.when(called, F.forall("calls", lambda x: well_formed(x, tool, words))))


def thought(queries: Column) -> Column:
    """The thought that leads to some queries."""
    lines = F.array_join(F.transform(queries, lambda q: F.concat(F.lit("- "), q)), "\n")
    return (
        F.when(F.size(queries) == 0, F.lit(THOUGHT_NONE))
        .when(F.size(queries) == 1, F.concat(F.lit(THOUGHT_ONE[0]), F.try_element_at(queries, F.lit(1)), F.lit(THOUGHT_ONE[1])))
        .otherwise(F.concat(F.lit(THOUGHT_MANY[0]), lines, F.lit(THOUGHT_MANY[1])))
    )


def cleaned(messages: DataFrame) -> DataFrame:
    """Messages as a chat template takes them: content is text, calls have an id, a type, a name and JSON text as arguments.

    An assistant message with calls and no content gets a thought about their queries; a call whose
    arguments are no object has none there, and one without a query has an empty one. Calls without
    an id are named by their place in the message, from call_0; an id that is null stays so. Only tool
    messages keep a tool_call_id, and only one that isn't empty.
    """
    m = messages.withColumn("calls", calls(F.col("tool_calls")))
    value = lambda c: F.try_parse_json(c["arguments"])
    asked = F.transform(F.filter("calls", lambda c: F.coalesce(_kind(value(c)) == "OBJECT", F.lit(False))), lambda c: F.coalesce(_text(F.try_variant_get(value(c), "$.query", "variant")), F.lit("")))
    text = F.coalesce("content", F.lit(""))
    empty = (F.col("role") == "assistant") & (F.size("calls") > 0) & (F.trim(text, F.lit(" \n\t\r\v\f")) == "")
    clean = F.transform(
        "calls",
        lambda c, i: F.struct(
            F.when(c["has_id"], c["id"]).otherwise(F.concat(F.lit("call_"), i.cast("string"))).alias("id"),
            F.lit("function").alias("type"),
            F.struct(c["name"].alias("name"), c["arguments"].alias("arguments")).alias("function"),
        ),
    )
    kept = F.when((F.col("role") == "tool") & (F.col("tool_call_id") != ""), F.col("tool_call_id"))
    return m.withColumns({"content": F.when(empty, thought(asked)).otherwise(text), "tool_calls": F.when(F.size("calls") > 0, clean), "tool_call_id": kept}).drop("calls")


#: Marks calls in generated text.
TAGGED = r"(?s)<tool_call>\s*(\{.*?\})\s*</tool_call>"


def tagged_calls(text: Column) -> Column:
    """An array of (query, error, run) of the calls in tags; JSON that doesn't parse is no call.

    A call with an error has no query to run. A missing query is an empty one, and is run too.
    """
    found = F.filter(F.transform(F.regexp_extract_all(text, F.lit(TAGGED), F.lit(1)), F.try_parse_json), lambda v: v.isNotNull())

    def one(call: Column) -> Column:
        given = F.try_variant_get(call, "$.arguments", "variant")
        value = F.when(given.isNull(), F.parse_json(F.lit("{}"))).otherwise(F.try_parse_json(_text(given)))
        query = F.try_variant_get(value, "$.query", "variant")
        error = F.when(value.isNull(), "arguments are not JSON").when(_kind(value) != "OBJECT", "arguments are no object")
        return F.struct(F.when(error.isNull(), F.coalesce(_text(query), F.lit(""))).alias("query"), error.alias("error"))

    return F.transform(found, one)


ANSWERED = ("<tool_response>\n", "\n</tool_response>")


def tool_loop(conversations: DataFrame, generate: Callable[[DataFrame, int], DataFrame], retrieve: Callable[[DataFrame], DataFrame], most: int = 3, key: str = "conv_id") -> DataFrame:
    """Conversations carried on turn by turn, with tools, until a turn calls none or ``most`` turns have called some.

    ``conversations``: the key and messages, an array of (role, content). ``generate`` gets the open
    conversations (key, messages) and the turn's number, and returns key and generated. ``retrieve``
    gets a table of different queries and returns query, and result or error; a query without a row
    is an error too. The calls of a turn are run together, each answer comes as a user message in the
    order of the calls, and errors are answers as well, so one bad call ends no conversation. A
    conversation that ``generate`` leaves out ends there.

    Returns the key, messages, n_tool_calls, query_texts (without empty ones), tool_responses, n_turns
    and stop: answered, turns (the last turn still called) or silent. Each turn is written and read
    again, so a lost executor costs no generation; only open conversations move.
    """
    message = "array<struct<role:string,content:string>>"
    none = F.array().cast("array<string>")
    open_ = conversations.select(key, F.col("messages").cast(message).alias("messages"), F.lit(0).alias("n_tool_calls"), none.alias("query_texts"), none.alias("tool_responses"))
    done: list[DataFrame] = []
    for turn in range(most + 1):
        said = open_.join(generate(open_.select(key, "messages"), turn).select(key, "generated"), key, "left")
        said = written(said.withColumn("turn_calls", F.coalesce(tagged_calls(F.col("generated")), F.array().cast("array<struct<query:string,error:string>>"))), f"turn{turn}")
        goes_on = (F.size("turn_calls") > 0) & F.lit(turn < most)
        spoken = F.concat("messages", F.array(F.struct(F.lit("assistant").alias("role"), F.col("generated").alias("content"))))
        ended = said.where(~goes_on)
        stop = F.when(F.col("generated").isNull(), "silent").when(F.size("turn_calls") > 0, "turns").otherwise("answered")
        done.append(ended.select(key, F.when(F.col("generated").isNull(), F.col("messages")).otherwise(spoken).alias("messages"), "n_tool_calls", "query_texts", "tool_responses", F.lit(turn + 1).alias("n_turns"), stop.alias("stop")))
        if turn == most:
            break
        calling = said.where(goes_on)
        each = calling.select(key, F.posexplode("turn_calls").alias("nth", "call")).select(key, "nth", "call.*")
        found = retrieve(each.where("error is null").select("query").distinct()).select("query", "result", F.col("error").alias("failed"))
        answer = F.when(F.col("error").isNotNull(), F.concat(F.lit("ERROR: "), "error")).when(F.col("result").isNotNull(), F.col("result")).otherwise(F.concat(F.lit("ERROR: "), F.coalesce("failed", F.lit("no result"))))
        answers = each.join(found, "query", "left").withColumn("answer", answer).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "answer"))), lambda x: x["answer"]).alias("answers"))
        replies = F.transform("answers", lambda a: F.struct(F.lit("user").alias("role"), F.concat(F.lit(ANSWERED[0]), a, F.lit(ANSWERED[1])).alias("content")))
        asked = F.filter(F.transform("turn_calls", lambda c: c["query"]), lambda q: q != "")
        open_ = written(calling.join(answers, key).select(key, F.concat(spoken, replies).alias("messages"), (F.col("n_tool_calls") + F.size("turn_calls")).alias("n_tool_calls"), F.concat("query_texts", asked).alias("query_texts"), F.concat("tool_responses", "answers").alias("tool_responses")), f"open{turn}")
        if open_.isEmpty():
            break
    return reduce(DataFrame.unionByName, done)


def trace_queries(messages: DataFrame, key: str = "conv_id") -> DataFrame:
    """The key and queries, an array: what a trace's calls ask for, message by message.

    Of each message the JSON calls come first, with repeats, then the tagged ones in its content that
    haven't been asked before. Empty queries and such that are no text are left out.
    """
    some = lambda q: F.filter(q, lambda x: x != "")
    own = some(F.transform(calls(F.col("tool_calls")), lambda c: c["query"]))
    tagged = some(F.transform(F.coalesce(tagged_calls(F.col("content")), F.array().cast("array<struct<query:string,error:string>>")), lambda c: c["query"]))
    rows = messages.select(key, "seq", own.alias("own"), tagged.alias("tagged"))
    each = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", "own", "tagged"))).alias("m"))
    fresh = lambda acc, q: F.when(F.array_contains(acc, q), acc).otherwise(F.array_append(acc, q))
    folded = F.aggregate("m", F.array().cast("array<string>"), lambda acc, m: F.aggregate(m["tagged"], F.concat(acc, m["own"]), fresh))
    return each.select(key, folded.alias("queries"))
