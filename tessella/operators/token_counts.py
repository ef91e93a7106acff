"""Token counts of training rows: question, reasoning, response, completion, prompt and the whole.

What counts a text is a column function: terms in the JVM, or a tokenizer in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.prompts import first_of

# The columns that hold a row's question, reasoning and response in the known sets, and the layout of completions and chats.
QUESTION = ["question", "Question", "prompt"]
REASONING = {"medreason": ["reasoning", "Reasoning", "Complex_CoT", "complex_cot"], "medical_o1": ["Complex_CoT", "complex_cot", "complex_cot_en", "reasoning", "Reasoning"]}
RESPONSE = {"medreason": ["answer", "Answer", "Response", "response", "final_response"], "medical_o1": ["Response", "response", "final_response", "answer", "Answer"]}
COMPLETION = ("## Thinking\n\n", "\n\n## Final Response\n\n")
CHAT = ("<|im_start|>user\n\n", "<|im_end|>\n<|im_start|>assistant\n\n", "<|im_end|>\n")

PARTS = ["question", "reasoning", "response", "completion", "prompt", "full"]


def texts(df: DataFrame, label: str = "medreason") -> DataFrame:
    """``df`` with the six texts of a row; the first column that exists and isn't null gives each of the first three."""
    own = df.select("*", first_of(df, QUESTION).alias("question_"), first_of(df, REASONING[label]).alias("reasoning_"), first_of(df, RESPONSE[label]).alias("response_"))
    own = own.withColumn("completion_", F.concat(F.lit(COMPLETION[0]), "reasoning_", F.lit(COMPLETION[1]), "response_"))
    own = own.withColumn("prompt_", F.concat(F.lit(CHAT[0]), "question_", F.lit(CHAT[1])))
    return own.withColumn("full_", F.concat("prompt_", "completion_", F.lit(CHAT[2])))


def terms(s: Column) -> Column:
    """Runs of letters and digits, and single marks: a count without a tokenizer."""
    return F.size(F.regexp_extract_all(s, F.lit(r"[A-Za-z0-9]+|[^A-Za-z0-9\s]"), F.lit(0)))


def tokenizer(path: str) -> Callable[[Column], Column]:
    """Counts by a tokenizer file that every executor can read; it is set up once a task.

    A text's special tokens are counted as the file says, none are added.
    """

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        encode = Tokenizer.from_file(path).encode_batch
        for batch in batches:
            # Few texts at once, as encodings hold more than the ids.
            out = []
            for lo in range(0, len(batch), 256):
                out += [len(e.ids) for e in encode(batch.iloc[lo : lo + 256].fillna("").tolist(), add_special_tokens=False)]
            yield pd.Series(out, dtype="int32")

    return count


def token_columns(df: DataFrame, dataset: str, label: str = "medreason", count: Callable[[Column], Column] = terms, row: str = "row_idx") -> DataFrame:
    """dataset, dataset_label, ``row``, source_id and the six counts.

    source_id is id_in_dataset or id, null without either.
    """
    ids = [F.col(c).cast("string") for c in ("id_in_dataset", "id") if c in df.columns]
    source = F.coalesce(*ids) if ids else F.lit(None).cast("string")
    counts = [count(F.col(f"{p}_")).alias(f"{p}_tokens") for p in PARTS]
    return texts(df, label).select(F.lit(dataset).alias("dataset"), F.lit(label).alias("dataset_label"), row, source.alias("source_id"), *counts)
