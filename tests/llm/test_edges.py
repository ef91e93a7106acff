"""Columns whose names clash with helpers', empty tables, and broken images, for operators and stages."""

from __future__ import annotations

import random
import struct

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import lines, pii, tiff, toxicity

HELPERS = ["_gone", "_id", "_hash", "_spans", "_kept", "_toxic", "gone", "gone_id", "gone_hash", "kept", "span_id", "span_hash", "span_list", "label_id", "label_toxic", "id", "h", "g", "t", "doc", "a.b", "n_lines", "n_removed"]
STAGES = corpus_pipeline.STAGES


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(1)
    prose = lambda n: " ".join("".join(r.choices("abcdefghij", k=r.randint(2, 9))) for _ in range(n))
    rows = [(i, prose(40) + (" vile awful rot" if i % 4 == 0 else " kind words here") + "\nsame line\nmail a@b.cc now", "en", f"s{i % 12}", 1) for i in range(60)]
    rows += [(60, None, None, None, None), (61, "", "en", "s1", 0), (None, "no id", "en", "s1", 5), (3, rows[3][1], "en", "s3", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    sf = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(0, 60)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    return docs.repartition(3), str(sf)


@pytest.mark.parametrize("name, stage", STAGES)
def test_stages_keep_columns_with_helpers_names(spark, tables, name, stage):
    docs, sf = tables
    more = docs.select("*", *[F.lit(f"own {c}").alias(c) for c in HELPERS])
    got, plain = stage(spark, more, sf), stage(spark, docs, sf)
    if name == STAGES[-1][0]:
        assert got.columns == plain.columns and got.count() == plain.count()
        return
    assert got.columns == more.columns and got.dtypes == more.dtypes
    rows = got.collect()
    assert all(r[c] == f"own {c}" for r in rows for c in HELPERS)
    key = lambda r: tuple(str(r[c]) for c in docs.columns)
    assert sorted(map(key, rows)) == sorted(map(key, plain.collect()))


@pytest.mark.parametrize("name, stage", STAGES)
def test_stages_on_empty_tables(spark, tables, name, stage):
    docs, sf = tables
    assert stage(spark, docs.limit(0), sf).collect() == []


def test_operators_with_clashing_names(spark, tables):
    docs, sf = tables
    more = docs.withColumns({c: F.lit(1) for c in HELPERS if "." not in c})
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    assert toxicity.toxicity(more, labels).where("toxic").count() == toxicity.toxicity(docs, labels).where("toxic").count() > 0
    assert lines.line_dedup(more).agg(F.sum("n_removed")).first()[0] == lines.line_dedup(docs).agg(F.sum("n_removed")).first()[0] > 0
    assert pii.redact(more, pii.find(more)).columns == more.columns
    assert toxicity.toxicity(docs.limit(0), labels).collect() == [] and lines.line_dedup(docs.limit(0)).collect() == []
    assert toxicity.toxicity(docs, labels.limit(0)).where("toxic").collect() == []


def test_broken_directories_are_error_rows(spark):
    head = b"II*\0" + struct.pack("<I", 8)
    no_value = head + struct.pack("<H", 1) + struct.pack("<HHII", tiff.WIDTH, 4, 0, 0) + struct.pack("<I", 0)
    files = [(1, b"II*\0" + struct.pack("<I", 0)), (2, no_value), (3, None), (4, b""), (5, b"II*\0")]
    got = {r["id"]: r for r in tiff.tiff_pages(spark.createDataFrame(files, "id long, data binary"), "id", "data").collect()}
    assert sorted(got) == [1, 2, 3, 4, 5] and all(r["error"] and r["page"] is None for r in got.values())
