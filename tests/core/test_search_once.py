from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import retrieval as R
from tessella.serving import Searcher


def _tables(spark):
    v = F.array(*[((F.col("id") * m) % 7 - 3).cast("float") for m in (1, 2, 3)])
    hedges = spark.range(90).select(F.format_string("he_%03d", "id").alias("id"), F.concat(F.lit("e"), F.col("id") % 11).alias("anchor"), F.array(F.concat(F.lit("Entity "), F.col("id") % 13), F.lit("--")).alias("entities"), F.concat(F.lit("entity "), F.col("id") % 13, F.lit(" meets "), "id").alias("description"), F.lit("r").alias("relation"), F.lit("t").alias("type"), F.col("id").alias("n"))
    hv = hedges.select("id", F.array(*[((F.col("n") * m) % 7 - 3).cast("float") for m in (1, 2, 3)]).alias("vector"))
    index = hedges.select(F.col("anchor").alias("name"), "id", F.lit(0).alias("pos"))
    ev = spark.range(11).select(F.concat(F.lit("e"), "id").alias("id"), v.alias("vector"))
    queries = spark.range(12).select(F.concat(F.lit("q"), "id").alias("query_id"), F.concat(F.lit("entity "), "id").alias("text"), v.alias("vector"), F.when(F.col("id") % 2 == 0, 2).otherwise(5).alias("top_k"))
    return queries, hedges.drop("n"), hv, ev, index


def test_equal_vectors_and_several_top_k_are_one_search(spark):
    queries, *tables = _tables(spark)
    alone = {k: R.retrieve_fused(queries.where(F.col("top_k") == k).drop("top_k"), *tables, top_k=k).collect() for k in (2, 5)}
    want = sorted(tuple(r) for rows in alone.values() for r in rows)
    assert sorted(tuple(r) for r in R.retrieve_fused(queries, *tables).collect()) == want
    known = R.with_tokens(tables[0])
    got = R.retrieve_fused(queries, known, *tables[1:], hedge_classes=R.classes(tables[1]), entity_classes=R.classes(tables[2]))
    assert sorted(tuple(r) for r in got.collect()) == want
    members = R.classes(tables[1])
    assert members.count() == 90 and members.select("_class").distinct().count() == 7
    assert sorted(R.nearest_of_copies(queries, tables[1], 9, members=members).collect()) == sorted(R.nearest(queries, tables[1], 9).collect())


def test_a_search_of_like_top_k_is_planned_once(spark, monkeypatch):
    queries, *tables = _tables(spark)
    calls = []
    fused = R.retrieve_fused
    monkeypatch.setattr(R, "retrieve_fused", lambda *a, **k: calls.append(1) or fused(*a, **k))
    encode = lambda rows: rows.join(queries.select("text", "vector"), "text")
    s = Searcher(spark, lambda: dict(zip(("hedges", "hedge_vectors", "entity_vectors", "index"), tables, strict=True)), encode)
    asked = spark.createDataFrame([("a", ["entity 1", "entity 2"], 3), ("b", ["entity 3"], None), ("c", ["entity 1"], 8)], "request_id string, queries array<string>, top_k int")
    got = {(r["request_id"], r["pos"]): r["results"] for r in s.search(asked).collect()}
    assert len(calls) == 2  # up to 5, and up to 10
    assert {k: len(v) for k, v in got.items()} == {("a", 0): 3, ("a", 1): 3, ("b", 0): 5, ("c", 0): 8}
    assert got["c", 0][:3] == got["a", 0]
    s.reset()
