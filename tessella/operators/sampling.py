"""Samples that depend on keys and a seed alone, so that they come out alike on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shuffle_key(key: Column, seed: int) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit("|"), F.lit(str(seed))))


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The first n rows in the order of hashed keys; ties by key. A top-n: no full sort."""
    return df.orderBy(shuffle_key(F.col(key), seed), key).limit(n)


def sample_by(df: DataFrame, by: list[str], key: str, n: int, seed: int = 42) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(shuffle_key(F.col(key), seed), key)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def bucket(key: Column, seed: int, n: int = 1000) -> Column:
    return F.conv(F.substring(shuffle_key(key, seed), 1, 8), 16, 10).cast("long") % n


def split(df: DataFrame, key: str, eval_share: float, seed: int = 42) -> DataFrame:
    """A column split: eval for about the share of keys, else train. No shuffle."""
    return df.withColumn("split", F.when(bucket(F.col(key), seed) < int(round(1000 * eval_share)), "eval").otherwise("train"))


def assigned(df: DataFrame, key: str, ratios: list[tuple[str, float]], rest: str, seed: int = 42) -> DataFrame:
    """A column trace_type: floor(n * ratio) rows of each type in hashed order, the others ``rest``.

    The rank is over hashed keys by range, not in one task.
    """
    from tessella.operators.graph import dense_ordinal

    ranked = dense_ordinal(df.withColumn("_key", shuffle_key(F.col(key), seed)), ["_key", key], "_at").drop("_key")
    total = df.agg(F.count("*").alias("_n"))
    out, low = F.lit(rest), F.lit(0)
    cases = None
    for name, ratio in ratios:
        high = low + F.floor(F.col("_n") * ratio)
        cond = (F.col("_at") >= low) & (F.col("_at") < high)
        cases = F.when(cond, name) if cases is None else cases.when(cond, name)
        low = high
    return ranked.crossJoin(F.broadcast(total)).withColumn("trace_type", cases.otherwise(out) if cases is not None else out).drop("_at", "_n")
