"""Question sets by kind: how rows are normalised, asked, asked again, and how outputs are read.

A kind is an ``Adapter``; adding one adds its prompts, parser and reports. Styles say in which form a
model was trained to answer.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators import parsing, prompts

# The texts of the prompts, by kind.
ZERO_SHOT_4 = "Read the medical multiple-choice question and select the single best answer.\nReturn only one letter: A, B, C, or D.\n\n"
ZERO_SHOT_10 = "Read the medical multiple-choice question and select the single best answer.\nReturn only one letter: A, B, C, D, E, F, G, H, I, or J.\n\n"
ZERO_SHOT_ABSTRACT = "Read the following biomedical research abstract and answer the question.\nReturn only one word: yes, no, or maybe.\n\n"
ASK_CHOICE = "You are answering a medical multiple-choice question.\n"
ASK_ABSTRACT = "You are answering a biomedical yes/no/maybe question based on the abstract.\n"
FORMAT = "Respond in exactly this format:\n"
TAG_FORM = "<think>\n<step-by-step reasoning>\n</think>\n<answer>\nThe answer is {choices}. <brief justification>\n</answer>\n\n"
HEADER_FORM = "## {thinking}\n<step-by-step reasoning>\n\n## {final}\nThe answer is {choices}. <brief justification>\n\n"
AGAIN_CHOICE = "You are extracting the final option from a draft answer to a medical multiple-choice question.\n"
AGAIN_ABSTRACT = "You are extracting the final answer from a draft response to a biomedical question.\n"
AGAIN_FORMAT = "Return exactly one line in this format and nothing else:\nFinal Answer: {choices}\n\n"
CHOICES_4, CHOICES_10, CHOICES_ABSTRACT = "<A/B/C/D>", "<A/B/C/D/E/F/G/H/I/J>", "yes/no/maybe"


@dataclass(frozen=True)
class Style:
    """The form in which a model answers."""

    form: str = "header"
    thinking: str = "Thinking"
    final: str = "Final Response"


# The styles by name.
STYLES = {"huatuo": Style(), "medreason": Style(), "think_tag": Style("tag", "", ""), "custom": Style()}


@dataclass(frozen=True)
class Adapter:
    """``normalize`` adds gold and what the others read; ``body`` is what is asked, after the instruction."""

    normalize: Callable[[DataFrame], DataFrame]
    body: Callable[[], Column]
    zero_shot_head: str
    ask: str
    again: str
    choices: str
    question: Callable[[], Column]
    bare: Callable[[Column], Column]
    read: Callable[[Column, Style], Column]

    def zero_shot(self) -> Column:
        """One letter or word is asked for."""
        return F.concat(F.lit(self.zero_shot_head), self.body(), F.lit("\n\nAnswer:"))

    def prompt(self, style: Style) -> Column:
        """Reasoning and an answer are asked for, in the style's form."""
        form = (TAG_FORM if style.form == "tag" else HEADER_FORM).format(choices=self.choices, thinking=style.thinking, final=style.final)
        return F.concat(F.lit(self.ask + FORMAT + form), self.body(), F.lit("\n"))

    def fallback(self, draft: Column) -> Column:
        """The answer alone is asked for, out of a draft that could not be read."""
        return F.concat(F.lit(self.again + AGAIN_FORMAT.format(choices=self.choices)), self.question(), F.lit("\n\nDraft response:\n"), draft)

    def parse(self, text: Column, style: Style) -> Column:
        """pred and parse_source."""
        return self.read(text, style)


def _question() -> Column:
    return F.concat(F.lit("Question:\n"), F.col("question"))


def _with_options() -> Column:
    """The options A to D that there are."""
    some = F.map_filter("options", lambda k, _: k.isin(*"ABCD"))
    return F.concat(_question(), F.lit("\n\nOptions:\n"), prompts.option_lines(some))


def _abstract() -> Column:
    return F.concat(F.lit("Abstract:\n"), F.col("context_text"), F.lit("\n\n"), _question())


ADAPTERS = {
    "four": Adapter(prompts.four_options, _with_options, ZERO_SHOT_4, ASK_CHOICE, AGAIN_CHOICE, CHOICES_4, _with_options, lambda s: parsing.letter(s, "D"), lambda s, y: parsing.mcq(s, F.col("options"), y.form, y.final, "D")),
    # The question holds its own options, which are kept for the parser alone.
    "ten": Adapter(prompts.ten_options, lambda: F.col("question"), ZERO_SHOT_10, ASK_CHOICE, AGAIN_CHOICE, CHOICES_10, _question, lambda s: parsing.letter(s, "J"), lambda s, y: parsing.mcq(s, F.col("options"), y.form, y.final, "J")),
    "abstract": Adapter(prompts.context_question, _abstract, ZERO_SHOT_ABSTRACT, ASK_ABSTRACT, AGAIN_ABSTRACT, CHOICES_ABSTRACT, _question, parsing.yes_no, lambda s, y: parsing.yes_no_maybe(s, y.form, y.final)),
}


def predictions(rows: DataFrame, adapter: Adapter, style: Style, output: str = "output", again: str | None = None) -> DataFrame:
    """Normalised ``rows`` with pred, parse_source, fallback_used and correct.

    ``again`` names the output of a second try, which is read only where the first gave nothing; a
    prediction from there has the source fallback_extract. A null prediction is wrong.
    """
    n = adapter.normalize(rows)
    n = n.withColumn("first_", adapter.parse(F.col(output), style))
    first = F.col("first_.pred")
    second = adapter.parse(F.col(again), style)["pred"] if again else F.lit(None).cast("string")
    n = n.withColumns({"again_": second, "fallback_used": first.isNull()})
    pred = F.coalesce(first, "again_")
    source = F.when(first.isNull() & F.col("again_").isNotNull(), "fallback_extract").otherwise(F.col("first_.parse_source"))
    n = n.withColumns({"pred": pred, "parse_source": source})
    return n.withColumn("correct", F.coalesce(F.col("pred") == F.col("gold"), F.lit(False))).drop("first_", "again_")


def run_summary(done: DataFrame, by: list[str]) -> DataFrame:
    """Of ``predictions`` per group: num_samples, correct, accuracy, invalid_predictions, fallback_attempts and fallback_recovered."""
    return done.groupBy(*by).agg(
        F.count("*").alias("num_samples"), F.count_if("correct").alias("correct"), F.round(F.avg(F.col("correct").cast("int")), 6).alias("accuracy"),
        F.count_if(F.col("pred").isNull()).alias("invalid_predictions"), F.count_if("fallback_used").alias("fallback_attempts"), F.count_if(F.col("parse_source") == "fallback_extract").alias("fallback_recovered"),
    )
