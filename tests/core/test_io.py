from __future__ import annotations

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessella.operators import graph as G
from tessella.sources import readers, sinks
from tessella.streaming import traces as S

SF = "/root/testdata/sf0.001"
EDGES = [("indication", 1, "disease", "d1", 10, "drug", "r1"), ("indication", 1, "disease", "d1", 11, "drug", "r2"), ("indication", 10, "drug", "r1", 1, "disease", "d1"), ("indication", 11, "drug", "r2", 1, "disease", "d1"), ("drug_drug", 10, "drug", "r1", 11, "drug", "r2"), ("drug_drug", 10, "drug", "r1", 12, "drug", "r3"), ("protein_protein", 5, "gene/protein", "p", 6, "gene/protein", "q"), ("disease_phenotype_positive", 1, "disease", "d1", 20, "effect/phenotype", "fever"), ("disease_phenotype_positive", 20, "effect/phenotype", "fever", 1, "disease", "d1")]


@pytest.fixture()
def edges(spark):
    return spark.createDataFrame(EDGES, readers.EDGES)


def test_graph_rules(spark, edges):
    kept = G.filter_graph(edges)
    assert {(r["x_name"], r["y_name"]) for r in kept.where("relation = 'drug_drug'").collect()} == {("r1", "r2")}
    assert kept.where("relation = 'protein_protein'").count() == 0
    n = {(r["anchor"], r["relation"]): r["neighbors"] for r in G.neighbor_hyperedges(kept).collect()}
    assert n == {("d1", "indication"): ["r1", "r2"]}
    c = G.verbalize_composites(G.composite_hyperedges(kept)).collect()
    assert [r["description"] for r in c] == ["d1, presenting with fever. Treatment includes r1 and r2."]
    p = {(r["pattern"], r["e0"], r["e1"], r["e2"]) for r in G.two_hop_paths(kept).collect()}
    assert ("symptom_disease_drug", "fever", "d1", "r1") in p
    assert G.cap_paths(G.two_hop_paths(kept), 1).groupBy("pattern").count().where("count > 1").count() == 0
    pri = spark.createDataFrame([("fever",)], "name string")
    assert G.cap_paths(G.two_hop_paths(kept), 0, pri).count() == G.two_hop_paths(kept).where("'fever' in (e0, e1, e2)").count()


def test_dense_ordinal(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    assert [(r["v"], r["ordinal"]) for r in G.dense_ordinal(df, ["v"]).orderBy("v").collect()] == [(i, i) for i in range(1000)]


def test_hypergraph_files(spark, edges, tmp_path):
    h = G.hypergraph(G.filter_graph(edges))
    index = G.entity_hedges(h)
    sinks.hypergraph_json(h, index, G.entities(index), f"{tmp_path}/doc")
    e, hedges, inverted = readers.hypergraph_lines(spark, f"{tmp_path}/doc")
    assert sorted(map(tuple, hedges.collect())) == sorted(map(tuple, h.select(*hedges.columns).collect()))
    assert sorted((r["name"], r["id"]) for r in inverted.collect()) == sorted((r["name"], r["id"]) for r in index.collect())
    assert sorted((r["name"], r["type"]) for r in e.collect()) == sorted((r["name"], r["type"]) for r in G.entities(index).collect())
    # The files end to end are the document, in order.
    doc = json.loads("".join(p.read_text() for p in sorted(Path(f"{tmp_path}/doc").glob("part-*"))))
    assert [x["id"] for x in doc["hyperedges"]] == [r["id"] for r in h.orderBy("hedge_ord").collect()] and list(doc["entities"]) == sorted(doc["entities"]) and set(doc["entity_to_hedges"]) == set(doc["entities"])
    (tmp_path / "whole.json").write_text(json.dumps(doc))
    assert readers.hypergraph_json(spark, f"{tmp_path}/whole.json")[2].count() == index.count()
    sinks.hypergraph(h, index, G.entities(index), f"{tmp_path}/tables")
    assert readers.table(spark, f"{tmp_path}/tables/hyperedges").count() == h.count()


def test_hypergraph_documents_with_odd_names_and_without_rows(spark, tmp_path):
    rows = [("he_1", 1, 'a "quoted" \\ {x}:[1]\nline', ['n"1":{', "n2"], "t", None, "n2"), ("he_0", 0, ",comma", ['n"1":{', 'x":['], "t", "r", "a")]
    h = spark.createDataFrame(rows, "id string, hedge_ord long, description string, entities array<string>, type string, relation string, anchor string")
    index = h.select("id", "hedge_ord", F.posexplode("entities").alias("pos", "name"))
    e = index.select("name").distinct().withColumn("type", F.lit("k"))
    for n, part in enumerate((h, h.limit(0))):
        own = index if n == 0 else index.limit(0)
        sinks.hypergraph_json(part, own, e if n == 0 else e.limit(0), f"{tmp_path}/{n}")
        doc = json.loads("".join(p.read_text() for p in sorted(Path(f"{tmp_path}/{n}").glob("part-*"))))
        got = readers.hypergraph_lines(spark, f"{tmp_path}/{n}")
        assert [f.count() for f in got] == ([3, 2, 4] if n == 0 else [0, 0, 0]) and len(doc["hyperedges"]) == got[1].count()
        assert sorted(map(str, got[1].collect())) == sorted(map(str, part.select(*got[1].columns).collect()))
    assert doc == {"entities": {}, "hyperedges": [], "entity_to_hedges": {}}


def test_csv_and_tables(spark, edges, tmp_path):
    sinks.csv(edges, f"{tmp_path}/e.csv")
    assert sorted(readers.edges_csv(spark, f"{tmp_path}/e.csv").collect()) == sorted(edges.collect())
    sinks.parquet(edges, f"{tmp_path}/p", ("relation",))
    assert spark.read.parquet(f"{tmp_path}/p").where("relation = 'indication'").count() == 4
    sinks.jsonl(edges, f"{tmp_path}/l.jsonl")
    sinks.jsonl(edges, f"{tmp_path}/l.jsonl", append=True)
    assert readers.table(spark, f"{tmp_path}/l.jsonl").count() == 18
    sinks.vectors(spark.createDataFrame([(1, [1.0])], "id long, vector array<double>"), f"{tmp_path}/v")
    assert dict(readers.table(spark, f"{tmp_path}/v").dtypes)["vector"] == "array<float>"
    sinks.report(spark.range(1).withColumn("a", F.lit("x")), f"{tmp_path}/r")
    assert json.loads(spark.read.text(f"{tmp_path}/r").first()[0]) == {"id": 0, "a": "x"}
    assert "| id |" in sinks.markdown(spark.range(1), "T")


def test_jsonl_modes(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\nbad\n{"b": 2}\n')
    path = f"{tmp_path}/x.jsonl"
    with pytest.raises(Exception):  # noqa: B017
        readers.jsonl(spark, path, "a long").collect()
    report = readers.jsonl(spark, path, "a long", "report").cache()
    assert report.where("_corrupt_record is not null").count() == 1
    assert [r["a"] for r in readers.jsonl(spark, path, "a long", "drop", ("a",)).collect()] == [1]


def test_splits_and_settings(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "test")], "id long, split string")
    assert [r["id"] for r in readers.split_of(df).collect()] == [2]
    assert [r["id"] for r in readers.split_of(df, "train").collect()] == [1]
    assert [r["id"] for r in readers.split_of(df.where("id = 1")).collect()] == [1]
    with pytest.raises(KeyError):
        readers.split_of(df, "dev")
    (tmp_path / ".env").write_text("# no\n\nA=1=2\nB = x \njunk\nA=9\n")
    present = spark.createDataFrame([("B", "kept")], "key string, value string")
    assert {(r["key"], r["value"]) for r in readers.settings(spark, f"{tmp_path}/.env", present).collect()} == {("A", "1=2"), ("B", "kept")}
    for name in ("a1", "a2"):
        (tmp_path / name).mkdir()
    assert readers.newest(spark, f"{tmp_path}/a*").endswith("a2")


def drain(stream, name, spark, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
        return [r.asDict() for r in spark.table(name).collect()]
    finally:
        q.stop()


def test_trace_stream(spark, tmp_path):
    rows = [{"source": "s", "question_id": i % 3, "arrived": "2024-01-01T00:00:0%d" % i, "expected": "A", "assistant_text": "<think>x</think><answer>A</answer>", "n_calls": 0, "n_responses": 0, "tool_text": ""} for i in range(5)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(map(json.dumps, rows)))
    got = drain(S.gated(S.new_traces(S.read_traces(spark, f"{tmp_path}/in"))), "gated", spark)
    assert sorted(r["question_id"] for r in got) == [0, 1, 2] and {r["reason"] for r in got} == {"ok"}


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the synthetic tables")
def test_event_stream(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").write.parquet(f"{tmp_path}/ev")
    batch = spark.read.parquet(f"{tmp_path}/ev")
    stream = spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/ev")
    got = drain(S.event_counts(stream), "counts", spark, "complete")
    assert sum(r["n"] for r in got) == batch.count()
