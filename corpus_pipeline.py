"""A training corpus from the documents: toxicity, line dedup, near-dedup, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import lines, minhash, packing, pii, toxicity
from tessella.llm.common import free, read
from tessella.llm.queries import vocabulary_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that are rejected as toxic go.

    Null and empty texts stay, and so do all rows if the labels don't hold both verdicts. Equal
    rows stay or go together. Other columns stay as they are; an empty table stays empty.
    """
    return toxicity.without_toxic(docs, read(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: boilerplate lines go from the texts, all documents stay.

    A null text stays null; a text all of whose lines go is empty. n_chars is counted anew.
    Columns named n_lines or n_removed are not the operator's then but taken as they were.
    """
    names = {c: f"{c}_before" for c in docs.columns if c.lower() in ("n_lines", "n_removed")}
    kept = {c: free(n, docs) for c, n in names.items()}
    done = lines.line_dedup(docs.withColumnsRenamed(kept))
    return _counted(done.select(*[F.col(f"`{kept.get(c, c)}`").alias(c) for c in docs.columns]))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts of five-word similarity 0.8 the document with the smallest id stays.

    Operator 10's groups are confirmed by that similarity. Its four bits of a fingerprint find only nearly
    equal texts, so MinHash keys bring the others together.
    Rows that repeat an id are one document; those without one stay if no other is in their group.
    Texts without words, null ones too, are copies of each other. An empty table stays empty.
    """
    kept = free("kept", docs)
    found = minhash.near_copies(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(kept)).distinct()
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col(kept)), "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: personal data are masked in the texts, all documents stay.

    A null text stays null. n_chars is counted anew; other columns stay as they are.
    """
    return _counted(pii.redact(docs, pii.find(docs)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: the texts' tokens as sequences, a row for each piece of a text.

    A null or empty text is one piece of the end id. Repeated rows give repeated pieces. Other
    columns don't come along; an empty table gives no rows.
    """
    return packing.pack_documents(docs, vocabulary_path("word_bpe_49k.json"), keep_ids=True)


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars again after a change to the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("simhash", dedup_near), ("pii", mask_pii), ("packing", pack)]

#: A model, sketches, graph components and a tokenizer are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
