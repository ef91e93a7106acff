from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import parsing, rewards


def test_unwrapped_first(spark):
    rows = [(1, "<think>x\n## Final Response\nThe answer is B</think>"), (2, "## Final Response\nIt must be beta"), (3, "no idea"), (4, "<think>a</think>\n## Final Response\nI pick (C) surely")]
    options = F.create_map(*[F.lit(x) for x in ("A", "alpha", "B", "beta", "C", "gamma", "D", "delta")])
    got = {r["i"]: tuple(r["p"]) for r in spark.createDataFrame(rows, "i int, s string").select("i", parsing.mcq_unwrapped(F.col("s"), options).alias("p")).collect()}
    assert got == {1: ("B", "final_section:explicit"), 2: ("B", "final_section:option_text"), 3: (None, "unparsed"), 4: ("C", "final_section:single_letter")}


def test_answers_and_their_fallback(spark):
    rows = [("<answer>beta</answer>", "x", 1.0), ("<answer> </answer>", "beta", 0.0), ("no tag", "B) it is", 1.0), ("no tag", "So therefore B", 0.8), ("no tag", "it must be beta here", 0.5), ("no tag", "alpha", 0.0), ("no tag", None, 0.0)]
    df = spark.createDataFrame(rows, "a string, l string, want double").select("want", rewards.answer(rewards.prediction(F.col("a"), F.col("l")), F.lit("beta"), F.lit("B")).alias("got"))
    assert [r["got"] for r in df.collect()] == [r[2] for r in rows]


def test_grounding_has_stop_words_of_its_own(spark):
    """These words are none of the evaluation's stop words, and don't count."""
    rows = [("patients associated including often through heart", "patients associated including often through lungs", False), ("heart valve repair", "the heart valve repair works", True)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    assert [r["got"] for r in df.select(rewards.grounded(F.col("a"), F.col("b")).alias("got")).collect()] == [r[2] for r in rows]


def test_items_of_one_file_are_dealt_to_all_tasks(spark):
    from tessella.plans import adapter_queries

    for kind in adapter_queries.ADAPTERS:
        rows = adapter_queries.rows_of(spark, "/root/testdata/sf0.001", kind)
        assert rows.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
