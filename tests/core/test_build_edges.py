from __future__ import annotations

from tessella.plans import fixtures, service_queries


def test_build_never_makes_pairs_without_a_shared_target(spark, monkeypatch):
    made = []

    def build(edges, out, encode, texts, paired=None):
        made.extend([edges, paired])
        return edges.limit(0).selectExpr("relation as step", "x_index as n")

    monkeypatch.setattr(service_queries.build, "build", build)
    monkeypatch.setattr(service_queries, "hashed_vectors", lambda *_: None)
    service_queries.g15_build(spark, "/root/testdata/sf0.01")
    edges, paired = made
    assert edges.where("relation = 'drug_drug'").count() == 0
    assert 0 < paired.where("relation = 'drug_drug'").count() < fixtures.kg_edges(spark, "/root/testdata/sf0.01", "drug_drug").count()
