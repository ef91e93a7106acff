"""Rewards of multi-turn completions, as columns over one row a completion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.functions.vectors import dot
from tessella.operators.tool_calls import calls, trace_queries

# How a final answer names a letter in running text.
FINAL_LETTER = r"(?i)(?:answer\s+is|therefore|correct\s+(?:answer|option)[:\s]*)\s*(?:\*\*)?([A-E])\b"


def structure(assistant: Column) -> Column:
    """.25 for a thought, .50 for an answer, .25 more for one of ten words at most."""
    answer = T.tag(assistant, "answer")
    thought = F.when(F.regexp_like(assistant, F.lit("(?s)<think>.*?</think>")), 0.25).otherwise(0.0)
    return thought + F.when(answer.isNull(), 0.0).when(T.word_count(answer) <= 10, 0.75).otherwise(0.50)


def form(assistant: Column, n_calls: Column, n_responses: Column) -> Column:
    return structure(assistant) + F.when((n_calls > 0) & (n_responses > 0), 0.25).otherwise(0.0)


def answer(prediction: Column, gold: Column, gold_letter: Column) -> Column:
    """1 for the text or its letter, .8 for the letter in running text, .5 for the text inside, else F1."""
    p, g = F.trim(F.coalesce(prediction, F.lit("")), F.lit(" \n\t\r")), F.upper(F.trim(gold_letter))
    has = g.isNotNull() & (g != "")
    return (
        F.when(p == "", 0.0).when(F.lower(p) == F.lower(gold), 1.0)
        .when(has & ((F.upper(F.regexp_extract(p, r"^\s*([A-Ea-e])[.\):\s]", 1)) == g) | (F.upper(p) == g)), 1.0)
        .when(has & (F.upper(F.regexp_extract(p, FINAL_LETTER, 1)) == g), 0.8)
        .when(F.contains(F.lower(p), F.lower(gold)), 0.5).otherwise(T.token_f1(p, gold))
    )


def prediction(assistant: Column, last: Column) -> Column:
    """What the first answer tag holds, even if that is nothing; without a tag the last assistant message that isn't empty."""
    return F.coalesce(T.tag(assistant, "answer"), last)


def tool_frequency(n_calls: Column) -> Column:
    return F.when(n_calls == 0, -0.3).when(n_calls <= 2, 0.4).otherwise(0.0)


def tool_quality(n_calls: Column, query_sim: Column, retrieval_sim: Column, grounded: Column, none: float = -0.30) -> Column:
    """A base by calls, and gains for queries near the question (less so beyond .80, where they copy
    it), for results near the answer, and for thoughts that use them. Null similarities gain nothing."""
    damped = F.when(query_sim > 0.80, 0.80 + (query_sim - 0.80) * 0.3).otherwise(query_sim)
    clip = lambda x, top: F.least(F.lit(top), F.greatest(F.lit(0.0), x))
    gains = F.coalesce(clip((damped - 0.5) * 0.2, 0.10), F.lit(0.0)) + F.coalesce(clip((retrieval_sim - 0.55) * 0.33, 0.15), F.lit(0.0)) + F.when(grounded, 0.05).otherwise(0.0)
    return F.when(n_calls == 0, none).otherwise(F.when(n_calls <= 2, 0.10).otherwise(0.05) + gains)


def grounded(thoughts: Column, results: Column) -> Column:
    """At least three shared tokens of three letters and more, and a fifth of the thought's first fifteen."""
    a, b = (T.tokens(s, T.STOP_GROUNDING, 3) for s in (thoughts, results))
    shared = F.size(F.array_intersect(a, b))
    return (shared >= 3) & (F.try_divide(shared, F.least(F.size(a), F.lit(15))) >= 0.2)


#: Characters of a tool's answer that are compared.
ANSWER_CHARS = 512

# The weights of format, answer and tool rewards, by way of training.
WEIGHTS = {"grpo": [0.25, 0.50, 0.25], "gdpo": [0.20, 0.50, 0.30], "a100": [0.15, 0.70, 0.15]}


def tool_signals(messages: DataFrame, questions: DataFrame, encode: Callable[[DataFrame], DataFrame], key: str = "conv_id") -> DataFrame:
    """The key, n_calls, query_sim, retrieval_sim and grounded of each trace: what ``tool_quality`` takes.

    ``messages``: key, seq, role, content and tool_calls; ``questions``: key, question, answer, either may
    be empty or missing. ``encode`` gets a table of different texts and returns text and vector, of unit
    length. query_sim is the best of the question with a query, retrieval_sim the best of the
    question and answer with the beginning of a tool's answer; null where a side is missing. grounded
    says whether the thoughts after the first tool message use what the tool messages say.
    """
    m = messages.join(questions.select(key, "question", "answer"), key, "left")
    w = Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    tool = F.col("role") == "tool"
    text = F.coalesce("content", F.lit(""))
    marked = messages.select(key, "seq", "role", text.alias("content"), (F.size(calls(F.col("tool_calls"))) > 0).alias("called")).withColumn("after", F.coalesce(F.max(tool).over(w), F.lit(False)))
    thoughts = F.when((F.col("role") == "assistant") & F.col("after"), F.array_join(T.tags(F.col("content"), "think"), " "))
    joined = lambda value: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct("seq", value.alias("v"))))), lambda x: x["v"]), " ")
    one = marked.groupBy(key).agg(F.count_if("called").alias("n_calls"), joined(thoughts).alias("thoughts"), joined(F.when(tool, F.col("content"))).alias("results"))
    sides = m.groupBy(key).agg(F.first("question").alias("q"), F.first("answer").alias("a")).where("q <> ''")
    asked = trace_queries(messages, key).select(key, F.lit("query").alias("kind"), F.explode("queries").alias("text"))
    answered = messages.where(tool).select(key, F.lit("result").alias("kind"), F.substring(text, 1, ANSWER_CHARS).alias("text"))
    anchors = sides.select(key, F.lit("query").alias("kind"), F.col("q").alias("anchor")).unionByName(sides.where("a <> ''").select(key, F.lit("result").alias("kind"), F.concat("q", F.lit(" The answer is "), "a").alias("anchor")))
    pairs = asked.unionByName(answered).join(anchors, [key, "kind"])
    vectors = encode(pairs.select("text").union(pairs.select(F.col("anchor").alias("text"))).distinct())
    near = pairs.join(vectors.select("text", F.col("vector").alias("v")), "text").join(vectors.select(F.col("text").alias("anchor"), F.col("vector").alias("u")), "anchor")
    best = near.groupBy(key).agg(*[F.max(F.when(F.col("kind") == kind, dot(F.col("u"), F.col("v")))).alias(name) for kind, name in (("query", "query_sim"), ("result", "retrieval_sim"))])
    used = F.coalesce(grounded(F.col("thoughts"), F.col("results")), F.lit(False))
    return one.join(best, key, "left").select(key, "n_calls", "query_sim", "retrieval_sim", used.alias("grounded"))


def weighted(rewards: list[Column], weights: list[float]) -> Column:
    total = F.lit(0.0)
    for r, w in zip(rewards, weights, strict=True):
        total = total + r * w
    return total
