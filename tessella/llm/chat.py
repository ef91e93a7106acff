"""Preference pairs as chat text: one prompt of the turns in common, two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free

# Fixed values of the chat markup.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _turns(turns: DataFrame, pair_col: str, name: str) -> DataFrame:
    """One row a pair: its turns in order. Nulls count as empty; repeated turns of a pair stay."""
    one = F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.groupBy(F.col(pair_col).alias("pair_id")).agg(F.transform(F.sort_array(F.collect_list(one)), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias(name))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE))), "")


def _spans(turns: Column) -> Column:
    """start:end of what is trained on in the rendered turns: each assistant text with its end mark."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(s: Column, t: Column) -> Column:
        begin = s["at"] + len(OPEN) + F.length(t["role"]) + 1
        end = begin + F.length(t["text"]) + len(CLOSE) - 1
        span = F.array(F.concat_ws(":", begin, end))
        return F.struct((end + 1).alias("at"), F.when(t["role"] == "assistant", F.concat(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    return F.array_join(F.aggregate(turns, start, step)["spans"], ",")


def preference_pairs(chosen: DataFrame, rejected: DataFrame, pair_col: str = "conv_id") -> DataFrame:
    """One row for each pair that both tables of turns (pair, turn, role, text) have.

    The prompt renders the longest common prefix of turns, those equal in role and text, once. The
    completions render what follows on each side. Spans are start:end in code points of the
    completion, comma-joined: the assistant's texts with their end marks, without the line feed
    after. All else is masked. Where one side is a prefix of the other its completion is empty.
    A null pair id, and pairs of one side alone, have no row; null roles and texts are empty; turns
    of equal number stand by role and text; other columns are not read.
    """
    both = _turns(chosen, pair_col, "c").join(_turns(rejected, pair_col, "r"), "pair_id")
    differ = F.transform(F.arrays_zip("c", "r"), lambda z: ~z["c"].eqNullSafe(z["r"]))
    first = F.array_position(differ, True)
    n = F.when(first == 0, F.size(differ).cast("long")).otherwise(first - 1).cast("int")
    both = both.withColumn("n", n)
    rest = lambda side: F.slice(side, F.col("n") + 1, F.greatest(F.size(side) - F.col("n"), F.lit(0)))
    return both.select(
        "pair_id", F.col("n").cast("long").alias("n_prefix"), _rendered(F.slice("c", 1, F.col("n"))).alias("prompt"),
        _rendered(rest("c")).alias("chosen"), _spans(rest("c")).alias("chosen_spans"), _rendered(rest("r")).alias("rejected"), _spans(rest("r")).alias("rejected_spans"),
    )


def parroted(turns: DataFrame, pair_col: str = "conv_id") -> DataFrame:
    """Worse versions of conversations: the last assistant turn only repeats the turn before it.

    A conversation without an assistant turn stays as it is; one that begins with its only
    assistant turn has that turn empty. Turns of equal number stand by role and text; turns with a null id are
    taken for one conversation; null texts are repeated as empty. All other columns stay.
    """
    nth, before, last = (free(n, turns) for n in ("nth", "before", "last"))
    w = Window.partitionBy(pair_col).orderBy("turn", "role", "text")
    placed = turns.withColumn(nth, F.row_number().over(w)).withColumn(before, F.lag("text").over(w))
    placed = placed.withColumn(last, F.max(F.when(F.col("role") == "assistant", F.col(nth))).over(Window.partitionBy(pair_col)))
    return placed.withColumn("text", F.when(F.col(nth) == F.col(last), F.coalesce(before, F.lit(""))).otherwise(F.col("text"))).drop(nth, before, last)
