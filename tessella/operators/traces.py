"""Conversation traces: gates, clean-up, augmentation, masks. A trace is rows (key, seq, role, content, tool_query)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators.parsing import trace_letter


def summarized(messages: DataFrame, key: str = "conv_id", called: Column | None = None, call_ok: Column | None = None) -> DataFrame:
    """One row a trace: assistant text, messages with calls, tool messages and texts, in message order.

    ``called`` and ``call_ok`` say whether a message has calls and whether they are well formed; without
    them a message has one call if it has a tool_query, of 2 to 25 words. Message texts of a trace
    meet in one row, as they do in a trace's own record.
    """
    called = F.col("tool_query").isNotNull() if called is None else called
    call_ok = F.when(called, T.word_count(F.col("tool_query")).between(2, 25)) if call_ok is None else call_ok
    by = lambda cond, value: F.transform(F.sort_array(F.collect_list(F.when(cond, F.struct("seq", value.alias("v"))))), lambda x: x["v"])
    assistant, tool = F.col("role") == "assistant", F.col("role") == "tool"
    return messages.groupBy(key).agg(
        F.array_join(by(assistant, F.coalesce("content", F.lit(""))), " ").alias("assistant_text"),
        F.count_if(called).alias("n_calls"), F.count_if(tool).alias("n_responses"), F.min(call_ok).alias("calls_ok"),
        F.array_join(by(tool, F.coalesce("content", F.lit(""))), " ").alias("tool_text"),
        F.count("*").alias("n_messages"), F.sum(F.length(F.coalesce("content", F.lit("")))).alias("n_chars"),
    )


def gates(traces: DataFrame, expected: Column, skip_empty: bool = False, mismatch: str = "call") -> DataFrame:
    """``summarized`` rows with reason: the first gate that a trace fails, or ok.

    ``skip_empty`` lets traces without an expected letter pass the third gate; ``mismatch`` "ratio"
    writes the fifth gate's reason as n/m. The last gate wants one of the first 20 long words of
    the tool texts in the last thought of a trace that has calls and two thoughts.
    """
    predicted = trace_letter(F.col("assistant_text"))
    wrong = F.when(F.lit(skip_empty) & (F.coalesce(expected, F.lit("")) == ""), F.lit(False)).otherwise(~predicted.eqNullSafe(expected))
    counts = F.concat("n_calls", F.lit("calls/"), "n_responses", F.lit("resps")) if mismatch == "call" else F.concat("n_calls", F.lit("/"), "n_responses")
    thoughts = T.tags(F.col("assistant_text"), "think")
    long_words = F.slice(F.filter(T.words(F.lower("tool_text")), lambda w: (F.length(w) > 5) & F.regexp_like(w, F.lit(r"^\p{L}+$"))), 1, 20)
    last = F.lower(F.try_element_at(thoughts, F.lit(-1)))
    idle = (F.col("n_calls") > 0) & (F.size(thoughts) >= 2) & (F.col("n_responses") > 0) & (F.size(long_words) > 0) & ~F.exists(long_words, lambda w: F.contains(last, w))
    reason = (
        F.when(F.size(thoughts) == 0, "missing_think").when(predicted.isNull(), "missing_answer")
        .when(wrong, F.concat(F.lit("wrong_answer:"), predicted, F.lit("≠"), expected))
        .when(~F.coalesce("calls_ok", F.lit(True)), "invalid_tool_call_json")
        .when(F.col("n_calls") != F.col("n_responses"), F.concat(F.lit("call_response_mismatch:"), counts))
        .when(idle, "no_retrieval_integration").otherwise("ok")
    )
    return traces.withColumn("predicted", predicted).withColumn("reason", reason)


def cleaned(messages: DataFrame, key: str = "conv_id") -> DataFrame:
    """Null contents empty; empty assistant calls get a thought about their query; calls get ids and JSON arguments."""
    blank = F.trim(F.coalesce("content", F.lit(""))) == ""
    thought = F.concat(F.lit("<think>\nI need to look up information about "), F.col("tool_query"), F.lit(".\n</think>"))
    content = F.when((F.col("role") == "assistant") & F.col("tool_query").isNotNull() & blank, thought).otherwise(F.coalesce("content", F.lit("")))
    call = F.to_json(F.struct(F.lit("call_0").alias("id"), F.lit("function").alias("type"), F.struct(F.lit("search").alias("name"), F.to_json(F.struct(F.col("tool_query").alias("query"))).alias("arguments")).alias("function")))
    return messages.withColumn("content", content).withColumn("tool_call", F.when(F.col("tool_query").isNotNull(), call))


def prefix_splits(messages: DataFrame, key: str = "conv_id") -> DataFrame:
    """Shorter versions of traces of two and more calls: up to the k-th call and its response, then
    the final assistant message. Only where that is last and a response follows the k-th call."""
    w = Window.partitionBy(key).orderBy("seq")
    every = Window.partitionBy(key)
    m = messages.withColumn("k", F.sum(F.when(F.col("tool_query").isNotNull(), 1).otherwise(0)).over(w)).withColumn("next_role", F.lead("role").over(w)).withColumn("nth", F.row_number().over(w))
    m = m.withColumn("n_calls", F.max("k").over(every)).withColumn("n", F.count("*").over(every)).withColumn("last_role", F.max_by("role", "seq").over(every))
    m = m.where((F.col("n_calls") >= 2) & (F.col("last_role") == "assistant"))
    cuts = m.where(F.col("tool_query").isNotNull() & (F.col("next_role") == "tool") & (F.col("k") < F.col("n_calls"))).select(F.col(key).alias("_key"), F.col("k").alias("split"), (F.col("nth") + 1).alias("upto"))
    out = m.join(cuts, F.col(key) == F.col("_key")).where((F.col("nth") <= F.col("upto")) | (F.col("nth") == F.col("n")))
    return out.select(key, "split", F.format_string("split_%dof%d", "split", "n_calls").alias("augment_type"), "seq", "role", "content", "tool_query")


def verbose_answers(messages: DataFrame, answers: DataFrame, key: str = "conv_id") -> DataFrame:
    """The last assistant message that has an answer tag, with the letter's text put after the letter.

    ``answers``: key and answer_text; traces without one have no row.
    """
    tagged = messages.where((F.col("role") == "assistant") & F.regexp_like("content", F.lit("(?s)<answer>.*?</answer>")))
    last = tagged.groupBy(key).agg(F.max_by("content", "seq").alias("content"), F.max("seq").alias("seq"))
    inside = F.regexp_extract("content", "(?s)<answer>(.*?)</answer>", 1)
    new = F.concat(F.lit("<answer>"), F.trim(inside), F.lit(". "), F.col("answer_text"), F.lit("</answer>"))
    return last.join(answers, key).select(key, "seq", F.replace("content", F.concat(F.lit("<answer>"), inside, F.lit("</answer>")), new).alias("content"))


def tool_flags(messages: DataFrame, key: str = "conv_id") -> DataFrame:
    """after_tool: whether a tool message stands before; call_no: calls so far."""
    w = Window.partitionBy(key).orderBy("seq")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return messages.withColumn("after_tool", F.coalesce(F.max((F.col("role") == "tool").cast("int")).over(before), F.lit(0))).withColumn("call_no", F.sum(F.col("tool_query").isNotNull().cast("int")).over(w))


def assistant_spans(ids: Column, opening: list[int], closing: int) -> Column:
    """Spans [start, end) of ids after each ``opening`` run to the ``closing`` id, itself included; to the end without one."""
    n, k = F.size(ids), len(opening)
    opens = F.filter(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: (n >= k) & (F.slice(ids, i, k) == F.array(*[F.lit(x) for x in opening])))
    ends = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.try_element_at(ids, i) == closing)
    return F.transform(opens, lambda i: F.struct((i + k - 1).alias("start"), F.coalesce(F.array_min(F.filter(ends, lambda e: e > i + k - 1)), n).alias("end")))


def masked_labels(ids: Column, spans: Column, max_len: int) -> Column:
    """ids inside the spans, -100 elsewhere, of the last ``max_len`` places."""
    inside = F.transform(ids, lambda x, i: F.when(F.exists(spans, lambda s: (s["start"] <= i) & (i < s["end"])), x).otherwise(-100))
    n = F.size(ids)
    return F.slice(inside, F.greatest(n - max_len + 1, F.lit(1)), F.lit(max_len))


def padded(values: Column, length: Column, fill: int) -> Column:
    return F.concat(values, F.array_repeat(F.lit(fill), F.greatest(length - F.size(values), F.lit(0))))


def trainable(labels: Column) -> Column:
    return F.size(F.filter(labels, lambda x: x != -100))


def resumed(items: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Items whose keys have not been done yet."""
    return items.join(done.select(*keys).na.drop().distinct(), keys, "left_anti")
