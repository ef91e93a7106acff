"""Additions for streams: the trace gates as a stateless stream, resume by watermark, and event rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.operators.traces import gates

TRACE = "source string, question_id long, arrived timestamp, expected string, assistant_text string, n_calls long, n_responses long, calls_ok boolean, tool_text string"


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(TRACE).json(path)


def gated(stream: DataFrame) -> DataFrame:
    """Each trace with its reason. Nothing is kept between batches."""
    return gates(stream, F.col("expected"))


def new_traces(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Traces whose (source, question_id) has not come within the watermark; the state is bounded by it."""
    return stream.withWatermark("arrived", late).dropDuplicatesWithinWatermark(["source", "question_id"])


def event_counts(stream: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events of each type by tumbling window of ``ts``; late ones are dropped beyond the watermark."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def rate(events: DataFrame, seconds: int, by: list[str]) -> DataFrame:
    """For each event, how many of its key came in the ``seconds`` up to it, itself included."""
    at = F.col("ts").cast("timestamp").cast("long")
    w = Window.partitionBy(*by).orderBy(at).rangeBetween(-seconds, 0)
    return events.withColumn("n_recent", F.count("*").over(w))
