from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import graph


def test_rows_are_made_once_before_they_are_numbered(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    rows = spark.range(3000, numPartitions=4).select(F.md5(F.col("id").cast("string")).alias("a")).mapInArrow(count, "a string")
    got = graph.dense_ordinal(rows, ["a"])
    assert got.count() == 3000 and made.value == 3000


def test_configuration_needs_no_python_worker(spark):
    conf = graph._config(spark.range(1), [(0, "it's", ["a", 'b"'], 3), (1, "{x}", ["c"], 4)], "i long, name string, t array<string>, n int")
    assert [tuple(r) for r in conf.orderBy("i").collect()] == [(0, "it's", ["a", 'b"'], 3), (1, "{x}", ["c"], 4)]
    assert conf.dtypes == [("i", "bigint"), ("name", "string"), ("t", "array<string>"), ("n", "int")]
    assert "ExistingRDD" not in conf._jdf.queryExecution().executedPlan().toString()
