"""Length profiles and reports: numeric summaries, threshold shares, histograms, accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERCENTS = [1, 5, 10, 25, 50, 75, 90, 95, 99]
#: The lengths against which shares are told.
THRESHOLDS = [512, 1024, 2048, 4096, 8192]


def summary(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Count, mean, population deviation, extremes, percentiles, and ranges of a column."""
    p = F.percentile(value, F.array(*[F.lit(x / 100) for x in PERCENTS]))
    out = df.groupBy(*by).agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_pop(value), 6).alias("std"), F.min(value).cast("double").alias("min"), F.max(value).cast("double").alias("max"), p.alias("p"))
    out = out.withColumns({f"p{x}": F.round(F.col("p")[i], 6) for i, x in enumerate(PERCENTS)}).drop("p")
    return out.withColumn("iqr", F.round(F.col("p75") - F.col("p25"), 6)).withColumn("spread", F.round(F.col("p95") - F.col("p5"), 6))


def threshold_shares(df: DataFrame, value: str, by: list[str], thresholds: list[int] = THRESHOLDS) -> DataFrame:
    rows = df.select(*by, value, F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold"))
    return rows.groupBy(*by, "threshold").agg(F.round(F.avg((F.col(value) <= F.col("threshold")).cast("int")), 6).alias("share_at_most"), F.round(F.avg((F.col(value) > F.col("threshold")).cast("int")), 6).alias("share_over"))


def histogram(df: DataFrame, value: str, bins: int = 80) -> DataFrame:
    """Densities over equal widths between the extremes: bin, n, density. The last bin is closed."""
    ends = df.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(width == 0, 0).otherwise(F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(bins - 1))).cast("int")
    rows = df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(ends)).withColumn("bin", at)  # one row
    counts = rows.groupBy("bin").agg(F.count("*").alias("n"), F.first(width).alias("w"))
    return counts.withColumn("density", F.round(F.try_divide(F.col("n"), F.sum("n").over(Window.partitionBy()) * F.col("w")), 9)).drop("w")


def ecdf(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Each different value and the share of rows up to it; counts are aggregated before the running sum."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by).orderBy(value)
    return counts.withColumn("share", F.round(F.sum("n").over(w) / F.sum("n").over(Window.partitionBy(*by)), 9)).select(*by, value, "share")


def box(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Quartiles and the whiskers: the outermost values within 1.5 quartile ranges of the box."""
    q = df.groupBy(*by).agg(F.percentile(value, 0.25).alias("q1"), F.percentile(value, 0.5).alias("median"), F.percentile(value, 0.75).alias("q3"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = df.join(F.broadcast(q), by).where(F.col(value).between(F.col("q1") - reach, F.col("q3") + reach))
    return inside.groupBy(*by, "q1", "median", "q3").agg(F.min(value).cast("double").alias("low"), F.max(value).cast("double").alias("high"))


def accuracy(df: DataFrame, pred: Column, gold: Column, by: list[str]) -> DataFrame:
    """Rows, accuracy and the unparsed; a null prediction is wrong."""
    right = F.coalesce(pred == gold, F.lit(False))
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(right).alias("n_correct"), F.round(F.avg(right.cast("int")), 6).alias("accuracy"), F.count_if(pred.isNull()).alias("n_invalid"))


def readiness(with_tool: Column, without: Column, margin: float = 0.02) -> Column:
    gain = with_tool - without
    return F.when(gain > margin, "ready").when(gain > -margin, "marginal").otherwise("not ready")


def tool_report(df: DataFrame, right: Column, n_calls: Column, words: Column, by: list[str]) -> DataFrame:
    """Accuracy with and without calls, where a side without rows counts 0, and what can be said of it.

    A null ``right`` is wrong. Rows of one side only give "cannot assess"."""
    hit, called = F.coalesce(right, F.lit(False)).cast("int"), n_calls > 0
    share = lambda cond: F.coalesce(F.avg(F.when(cond, hit)), F.lit(0.0))
    out = df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(called).alias("n_with"), F.round(share(called), 6).alias("acc_with"), F.round(share(~called), 6).alias("acc_without"), F.round(F.avg(words), 6).alias("mean_words"))
    one_sided = (F.col("n_with") == 0) | (F.col("n_with") == F.col("n"))
    return out.withColumn("verdict", F.when(one_sided, "cannot assess").otherwise(readiness(F.col("acc_with"), F.col("acc_without"))))


def token_accuracy(predicted: Column, labels: Column) -> tuple[Column, Column]:
    """Hits and trained places of next-token predictions: place i predicts label i + 1."""
    shifted = F.slice(labels, 2, F.greatest(F.size(labels) - 1, F.lit(0)))
    pairs = F.filter(F.arrays_zip(F.slice(predicted, 1, F.size(shifted)).alias("p"), shifted.alias("l")), lambda z: z["l"] != -100)
    return F.size(F.filter(pairs, lambda z: z["p"] == z["l"])), F.size(pairs)


def cost(uncached: Column, cached: Column, output: Column, prices: tuple[float, float, float]) -> Column:
    """Of tokens, by prices a million."""
    return (uncached * prices[0] + cached * prices[1] + output * prices[2]) / 1e6
