"""Queries against their SQL on the smallest tables, and what the entry module promises."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from tessella.plans import QUERIES, SQL

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: One of each kind; the driver compares all of them.
CHECKED = ["g1_filter_graph", "a1_neighbor_hyperedges", "a3_composite_hyperedges", "t5_priority_paths", "g6_verbalize_neighbors", "j13_nearest", "a19_hit_report", "n3_parse_header", "n9_n10_tag_letters", "c1_gates", "a14b_tool_report", "c4_prefix_splits", "y1_y4_rewards", "a10_length_summary", "a16_histogram", "t10_assigned_types", "w9_event_rate", "s1_k5_csv_edges", "s6_jsonl_keys", "x14_call_arguments", "c1_raw_gates", "c3_raw_messages", "c16_tool_loop", "y7_trace_queries", "y3_answer_branches", "p12_predictions", "n11_run_summary", "v6_three_scores", "k10_search", "j14_answer_in_text", "r9_over_models", "s8_saved_folder"]

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the synthetic tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def shown(v):
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", CHECKED)
def test_query_is_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cursor = duck.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    got = sorted(tuple(shown(r[c]) for c in names) for r in df.collect())
    assert got == sorted(tuple(map(shown, r)) for r in cursor.fetchall())


def test_entry(spark):
    rows = __spark_entry__.entry(spark)
    assert rows.columns == ["anchor", "anchor_type", "relation", "neighbors", "description"] and rows.count() == 429


def test_names():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(SQL) <= set(QUERIES)


def test_the_rest_works_without_the_training_data_operators(tmp_path):
    for name in ("tessella", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", str(ROOT / name), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "tessella/llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
