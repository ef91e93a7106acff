from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import functions as F

from tessella.functions import digests
from tessella.operators import graph


def test_digests_of_all_pairs():
    heads = [f"disease:{i}|gene/protein:{i % 25}|".encode() for i in (1, 55, 777, 1234, 99999, 1200000)] + [b"", b"x" * 50, b"y" * 70, "äö|".encode()]
    tails = [f"drug:{i}".encode() for i in (1, 22, 333, 4444, 55555, 10, 12)] + [b""]
    bounds = np.array([2**31, 2**32, 0, 2**30, 2**31] * 2)
    got = sorted((i, j) for a, b in digests.low_pairs(heads, bounds, tails) for i, j in zip(a.tolist(), b.tolist(), strict=True))
    assert got == [(i, j) for i, h in enumerate(heads) for j, t in enumerate(tails) if int(hashlib.md5(h + t).hexdigest()[:8], 16) < bounds[i]]


def test_paths_of_a_hot_middle_are_not_made_as_rows(spark, monkeypatch):
    monkeypatch.setattr(graph, "HEADS", 40)
    monkeypatch.setattr(graph, "TAILS", 30)
    monkeypatch.setattr(graph, "LISTED", 1)
    name = lambda x, n: F.when(F.col(x) % n == 0, F.lit(None)).when(F.col(x) % 7 == 0, F.lit("long" * 20)).otherwise(F.concat(F.lit("é"), F.col(x).cast("string")))
    edge = lambda n, r, x, y: spark.range(n).select(F.lit(r).alias("relation"), x.cast("long").alias("x_index"), F.lit("t").alias("x_type"), y.cast("long").alias("y_index"), F.lit("t").alias("y_type"))
    i = F.col("id")
    edges = edge(200, "r1", i, 1000 + i % 3).unionByName(edge(150, "r2", 1000 + i % 2, 2000 + i)).unionByName(edge(5, "r1", i, F.lit(None))).select("*", name("x_index", 11).alias("x_name"), name("y_index", 13).alias("y_name"))
    patterns = [("p", "t", "r1", "t", "r2", "t"), ("q", "t", "r1", "t", "r2", "t")]
    paths = graph.two_hop_paths(edges, patterns)
    pri = spark.createDataFrame([("é31",), (None,), ("é2100",)], "name string")
    order = ["pattern", "i0", "i1", "i2"]
    for limit, names in ((40, None), (40, pri), (900, pri), (10**5, pri), (10**5, None)):
        want = graph.cap_paths(paths, limit, names)
        got = graph.capped_paths(edges, limit, names, patterns, piece=100)
        assert got.columns == want.columns and got.count() > 0
        assert got.orderBy(*order).collect() == want.orderBy(*order).collect()


def test_hot_middles_are_never_joined(spark):
    edges = spark.range(4000).select(F.when(F.col("id") < 2000, "r1").otherwise("r2").alias("relation"), F.when(F.col("id") < 2000, F.col("id")).otherwise(F.lit(-1)).alias("x_index"), F.lit("t").alias("x_type"), F.lit("a").alias("x_name"), F.when(F.col("id") < 2000, F.lit(-1)).otherwise(F.col("id")).alias("y_index"), F.lit("t").alias("y_type"), F.col("id").cast("string").alias("y_name"))
    edges = edges.withColumn("x_name", F.col("x_index").cast("string"))
    patterns = [("p", "t", "r1", "t", "r2", "t")]
    first, second = graph._hops(edges, patterns)
    low = graph._low_paths(first, second, graph.path_middles(edges, patterns), {"p": 1e-5}, patterns, 1000)
    assert "MapInArrow" in low._jdf.queryExecution().toString()
    assert sorted(low.select("i0", "i2").collect()) == sorted(graph.two_hop_paths(edges, patterns).where(F.md5(F.concat_ws("|", "e0", "e1", "e2")) < f"{int(1e-5 * 2**32):08x}").select("i0", "i2").collect())
