"""Prompts, chat text and normalised question rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def option_lines(options: Column) -> Column:
    """``K. text`` lines in the order of keys."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(options)), lambda e: F.concat(e["key"], F.lit(". "), e["value"])), "\n")


def question_with_options(question: Column, options: Column) -> Column:
    return F.when(F.coalesce(F.size(options), F.lit(0)) <= 0, question).otherwise(F.concat(question, F.lit("\n\nOptions:\n"), option_lines(options)))


def messages(system: str, user: Column) -> Column:
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))


def chatml(turns: Column) -> Column:
    """The literal markup, with the assistant's turn opened."""
    each = F.transform(turns, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>\n")))
    return F.concat(F.array_join(each, ""), F.lit("<|im_start|>assistant\n"))


def user_assistant(prompt: Column) -> Column:
    return F.concat(F.lit("### User:\n"), prompt, F.lit("\n\n### Assistant:\n"))


def answer_prompt(question: Column, options: Column, form: str, choices: str = "A/B/C/D", thinking: str = "Thinking", final: str = "Final Response") -> Column:
    """The instruction of the header or of the tag form, then the question."""
    shape = f"<think>\n<step-by-step reasoning>\n</think>\n<answer>\nThe answer is <{choices}>. <brief justification>\n</answer>\n\n" if form == "tag" else f"## {thinking}\n<step-by-step reasoning>\n\n## {final}\nThe answer is <{choices}>. <brief justification>\n\n"
    head = "You are answering a medical multiple-choice question.\nRespond in exactly this format:\n" + shape
    return F.concat(F.lit(head + "Question:\n"), question, F.lit("\n\nOptions:\n"), option_lines(options), F.lit("\n"))


def completion(reasoning: Column, answer: Column, form: str, thinking: str = "Thinking", final: str = "Final Response") -> Column:
    r, a = F.trim(reasoning), F.trim(answer)
    if form == "tag":
        return F.concat(F.lit("<think>\n"), r, F.lit("\n</think>\n<answer>\n"), a, F.lit("\n</answer>"))
    return F.concat(F.lit(f"## {thinking}\n"), r, F.lit(f"\n\n## {final}\n"), a)


def four_options(df: DataFrame) -> DataFrame:
    """question, options and gold from rows with options and answer_idx, or with opa to opd and cop."""
    if {"options", "answer_idx"} <= set(df.columns):
        return df.withColumn("gold", F.upper(F.col("answer_idx").cast("string")))
    options = F.create_map(*[x for k in "ABCD" for x in (F.lit(k), F.col("op" + k.lower()))])
    cop = F.lower(F.col("cop").cast("string"))
    gold = F.coalesce(*[F.when(cop.isin(str(i), "abcd"[i]), "ABCD"[i]) for i in range(4)], F.lit(""))
    return df.withColumn("options", options).withColumn("gold", gold)


def ten_options(df: DataFrame) -> DataFrame:
    return df.withColumn("gold", F.upper(F.trim(F.col("label"))))


def context_question(df: DataFrame) -> DataFrame:
    """context_text from an array of paragraphs: trimmed, blank ones left out, with blank lines between; gold in lower case."""
    parts = F.filter(F.transform("contexts", lambda p: F.trim(p)), lambda p: p != "")
    return df.withColumn("context_text", F.array_join(parts, "\n\n")).withColumn("gold", F.lower(F.trim("final_decision")))


def answer_text(options: Column, letter: Column) -> Column:
    return F.coalesce(F.try_element_at(options, letter), F.lit(""))


def first_of(df: DataFrame, names: list[str]) -> Column:
    """The first of the columns that exist, cast to string, that isn't null; an error if none exists."""
    found = [F.col(n).cast("string") for n in names if n in df.columns]
    if not found:
        raise KeyError(f"none of {', '.join(names)} is a column")
    return F.coalesce(*found, F.raise_error(F.lit(f"no value in {', '.join(names)}")))
