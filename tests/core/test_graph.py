from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import graph
from tessella.plans import fixtures


def test_dense_ordinal_numbers_each_row_once(spark):
    """Many wide rows, so that range borders are drawn from a sample and not from all rows."""
    n = 50_000
    rows = spark.range(n, numPartitions=8).select(F.md5(F.col("id").cast("string")).alias("a"), (F.col("id") % 7).alias("b"), F.repeat(F.lit("wide "), 60).alias("text"))
    got = graph.dense_ordinal(rows, ["b", "a"])
    assert got.select("ordinal").distinct().count() == n and got.agg(F.min("ordinal"), F.max("ordinal")).first()[:] == (0, n - 1)
    want = sorted((r["b"], r["a"]) for r in rows.select("a", "b").collect())
    assert [(r["b"], r["a"]) for r in got.orderBy("ordinal").select("a", "b").collect()] == want
    assert graph.dense_ordinal(rows.limit(0), ["a"]).collect() == []


def test_priority_paths_fill_the_limit_first(spark):
    rows = [("p", f"a{i:02d}", f"b{i}", f"c{i}", i, i, i) for i in range(30)] + [("q", "x", "y", "z", 0, 0, 0)]
    paths = spark.createDataFrame(rows, "pattern string, e0 string, e1 string, e2 string, i0 long, i1 long, i2 long")
    names = spark.createDataFrame([(f"b{i}",) for i in (3, 3, 8, 21)], "name string")
    got = graph.cap_paths(paths, 5, names).collect()
    assert {"a03", "a08", "a21"} <= {r["e0"] for r in got} and len(got) == 6
    few = graph.cap_paths(paths, 2, names).collect()
    assert sorted(r["e0"] for r in few) == ["a03", "a08", "a21", "x"]
    assert len(graph.cap_paths(paths, 5).collect()) == 6


def test_paths_through_one_entity_are_dealt_to_several_tasks(spark):
    a = spark.range(300).selectExpr("'r1' as relation", "id as x_index", "'t' as x_type", "concat('a', id) as x_name", "7L as y_index", "'t' as y_type", "'hub' as y_name")
    b = spark.range(200).selectExpr("'r2' as relation", "7L as x_index", "'t' as x_type", "'hub' as x_name", "1000 + id as y_index", "'t' as y_type", "concat('c', id) as y_name")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        paths = graph.two_hop_paths(a.unionByName(b), [("p", "t", "r1", "t", "r2", "t")], piece=1000)
        assert paths.count() == 60_000 == paths.select("e0", "e2").distinct().count()
        assert paths.select(F.spark_partition_id().alias("task")).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = sorted((r["k"], r["i0"], r["i2"]) for r in paths.select(F.md5(F.concat_ws("|", "e0", "e1", "e2")).alias("k"), "i0", "i2").collect())[:50]
    got = graph.cap_paths(paths, 50).select("i0", "i2").collect()
    assert sorted((r["i0"], r["i2"]) for r in got) == sorted(w[1:] for w in want)


def test_pairs_share_a_target_of_few_or_many_sources(spark):
    edges = [("via", s, t) for s, t in [(1, 50), (2, 50), (3, 50), (4, 50), (5, 51), (6, 51), (7, 52)]]
    edges += [("pair", x, y) for x, y in [(1, 2), (2, 1), (4, 3), (5, 6), (6, 7), (1, 5), (7, 7), (8, 8)]]
    df = spark.createDataFrame(edges, "relation string, x_index long, y_index long")
    for light in (0, 2, 100):
        got = sorted(r[1:] for r in graph.shared_target_pairs(df, "pair", "via", light).collect())
        assert got == [(1, 2), (2, 1), (4, 3), (5, 6), (7, 7)]


def test_edges_of_one_relation_read_only_their_tables(spark):
    got = fixtures.kg_edges(spark, "/root/testdata/sf0.001", "indication")
    assert {f.rpartition("/")[2] for f in got.inputFiles()} == {"lineitem.parquet"}
    every = fixtures.kg_edges(spark, "/root/testdata/sf0.001").where("relation = 'indication'")
    assert sorted(got.collect()) == sorted(every.collect())


def test_capped_paths_are_counted_by_their_middles(spark):
    """All paths are counted before one is made, through one entity and several, with repeated edges."""
    a = spark.range(60).selectExpr("'r1' as relation", "id as x_index", "'t' as x_type", "concat('a', id) as x_name", "id % 3 as y_index", "'t' as y_type", "concat('m', id % 3) as y_name")
    b = spark.range(40).selectExpr("'r2' as relation", "id % 2 as x_index", "'t' as x_type", "concat('m', id % 2) as x_name", "1000 + id as y_index", "'t' as y_type", "concat('c', id) as y_name")
    edges, patterns = a.unionByName(a.limit(1)).unionByName(b), [("p", "t", "r1", "t", "r2", "t"), ("none", "t", "r2", "t", "r1", "t")]
    paths = graph.two_hop_paths(edges, patterns)
    sizes = {r["pattern"]: r["n"] for r in graph.path_middles(edges, patterns).groupBy("pattern").agg(F.sum(F.col("n1") * F.col("n2")).alias("n")).collect()}
    assert sizes == {"p": paths.count()} and sizes["p"] > 800
    for limit in (50, 5000):
        got = graph.capped_paths(edges, limit, patterns=patterns).select("i0", "i1", "i2").collect()
        assert sorted(got) == sorted(graph.cap_paths(paths, limit).select("i0", "i1", "i2").collect())
    pri = spark.createDataFrame([("c0",), ("a3",)], "name string")
    got = graph.capped_paths(edges, 30, pri, patterns).select("i0", "i1", "i2").collect()
    assert sorted(got) == sorted(graph.cap_paths(paths, 30, pri).select("i0", "i1", "i2").collect())
    # A number that is too high, as with all paths ahead of the rest, only raises the bound.
    assert graph.cap_paths(paths, 30, sizes={"p": 10**5, "none": 5}).count() == 30


def test_ranked_groups_take_one_shuffle(spark):
    edges = spark.range(1000).selectExpr("'drug' as x_type", "'indication' as relation", "concat('x', id % 90) as x_name", "id as y_index", "concat('y', id) as y_name", "'disease' as y_type")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = graph.neighbor_hyperedges(edges)
        assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
        assert got.count() == 90 and got.first()["neighbors"] is not None
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
