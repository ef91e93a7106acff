"""Top-k retrieval by vectors, with lexical and entity signals fused, and its evaluation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import tokens
from tessella.functions.vectors import dot, max_sim, sparse_dot
from tessella.sources.workdir import written

#: Vectors of the corpus and of the queries that one matrix product takes.
CORPUS_BLOCK, QUERY_BLOCK = 4096, 512
#: Queries of a block whose products are held at once: 4 MB a slice of the largest blocks.
SLICE = 128
#: Bytes of query vectors that are broadcast together; more queries pass over the corpus in turn.
QUERY_BYTES = 64 << 20
#: Pairs that are handed on together where all are wanted.
PAIRS = 1 << 16


def scores(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """query_id, id and sim of each query against all of the corpus: a row a pair, where all of them are wanted.

    ``queries``: query_id, vector. ``corpus``: id, vector. As in ``nearest`` a pair of blocks is one matrix
    product; its rows are handed on in batches of ``PAIRS`` at most. Query blocks are broadcast in
    passes of ``QUERY_BYTES`` at most; the corpus is dealt to all tasks once, as a table of one file would be
    one task. Rows without a vector have no pairs; all vectors must have one length.
    """
    tasks = int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = _packed(corpus.select("id", "vector").repartition(tasks, "id"), "id", CORPUS_BLOCK)
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {corpus.schema['id'].dataType.simpleString()}, sim double"
    out = None
    for mine in _passes(queries):
        held = _packed(mine, "query_id", QUERY_BLOCK).withColumnsRenamed({"ids": "q_ids", "matrix": "q_matrix"})
        found = blocks.crossJoin(F.broadcast(held)).mapInArrow(_pairs, kinds)
        out = found if out is None else out.unionByName(found)
    return out


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each pair of blocks all products, some queries at a time."""
    for batch in batches:
        for i in range(len(batch)):
            q_ids, ids = batch["q_ids"][i].values, batch["ids"][i].values
            q, c = (np.frombuffer(batch[m][i].as_buffer(), np.float64).reshape(len(n), -1) for m, n in (("q_matrix", q_ids), ("matrix", ids)))
            step = max(1, PAIRS // len(ids))
            for lo in range(0, len(q), step):
                sims = q[lo : lo + step] @ c.T
                row, col = np.indices(sims.shape, np.int32)
                yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(row.ravel() + lo)), ids.take(pa.array(col.ravel())), pa.array(sims.ravel())], names=["query_id", "id", "sim"])


def _passes(queries: DataFrame) -> list[DataFrame]:
    """The queries in parts of at most ``QUERY_BYTES`` or so."""
    size = queries.agg(F.coalesce(F.sum(F.size("vector")), F.lit(0)) * 8).first()[0]
    n = max(1, -(-size // QUERY_BYTES))
    return [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i) if n > 1 else queries for i in range(n)]


def _packed(rows: DataFrame, id_col: str, size: int) -> DataFrame:
    """ids and matrix, the doubles of the vectors of at most ``size`` rows, ids in order; rows without a vector are left out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch["vector"]))
            batch = batch.take(pc.array_sort_indices(batch[id_col]))
            for lo in range(0, len(batch), size):
                part = batch.slice(lo, size)
                matrix = part["vector"].flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                ids = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part[id_col])
                yield pa.RecordBatch.from_arrays([ids, pa.array([matrix.tobytes()], pa.binary())], names=["ids", "matrix"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(id_col, "vector").mapInArrow(work, f"ids array<{kind}>, matrix binary")


def _best(k: int, places: int):
    """Of each pair of blocks the ``k`` best of every query: a matrix product, and a threshold a query."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                q_ids, ids = batch["q_ids"][i].values, batch["ids"][i].values
                q, c = (np.frombuffer(batch[m][i].as_buffer(), np.float64).reshape(len(n), -1) for m, n in (("q_matrix", q_ids), ("matrix", ids)))
                for lo in range(0, len(q), SLICE):
                    sims = np.round(q[lo : lo + SLICE] @ c.T, places)
                    few = min(k, len(ids))
                    least = np.partition(sims, len(ids) - few, axis=1)[:, len(ids) - few]
                    row, col = np.nonzero(sims >= least[:, None])
                    value = sims[row, col]
                    # Ties at the threshold go to the smaller id; ids are in order.
                    order = np.lexsort((col, -value, row))
                    row, col, value = row[order], col[order], value[order]
                    nth = np.arange(len(row)) - np.searchsorted(row, row)
                    row, col, value = (x[nth < few] for x in (row, col, value))
                    yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(row + lo)), ids.take(pa.array(col)), pa.array(value)], names=["query_id", "id", "sim"])

    return work


def nearest(queries: DataFrame, corpus: DataFrame, k: int, places: int = 6) -> DataFrame:
    """The k most similar ids of each query: query_id, id, sim, rank from 0; ties by id.

    Similarities are rounded before they are compared. Vectors go in blocks, and a pair of blocks is one
    matrix product of which k rows a query are left, so no pair of vectors is ever a row. Query
    blocks are broadcast, in passes of ``QUERY_BYTES`` at most; the corpus is never shuffled. Rows
    without a vector match nothing; all vectors must have one length.
    """
    blocks = _packed(corpus, "id", CORPUS_BLOCK)
    out = None
    for mine in _passes(queries):
        held = _packed(mine, "query_id", QUERY_BLOCK).withColumnsRenamed({"ids": "q_ids", "matrix": "q_matrix"})
        kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {corpus.schema['id'].dataType.simpleString()}, sim double"
        found = blocks.crossJoin(F.broadcast(held)).mapInArrow(_best(k, places), kinds)
        out = found if out is None else out.unionByName(found)
    w = Window.partitionBy("query_id").orderBy(F.col("sim").desc(), "id")
    ranked = out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.withColumn("rank", F.col("rank") - 1)


def classes(corpus: DataFrame, k: int | None = None) -> DataFrame:
    """Equal vectors as classes: id, vector, _nth, its place in the class by id from 1, and _class, the class's first id.

    Of each class the ``k`` first ids, if it is given. No class is in one group whole. The job runs at the call.
    """
    first = Window.partitionBy("_h", "vector").orderBy("id")
    has = corpus.select("id", "vector").where("vector is not null").withColumn("_h", F.xxhash64("vector")).withColumn("_nth", F.row_number().over(first))
    if k is not None:
        has = has.where(F.col("_nth") <= k)
    return written(has.withColumn("_class", F.first("id").over(first)).select("id", "vector", "_nth", "_class"), "members")


def nearest_of_copies(queries: DataFrame, corpus: DataFrame, k: int, places: int = 6, members: DataFrame | None = None) -> DataFrame:
    """``nearest`` where many vectors are equal on both sides, with its rows: query_id, id, sim, rank from 0; ties by id.

    Equal vectors are one class and are compared once, so the work grows with the square of the different
    vectors. The k first ids of a class stand for it, as no more can be among the k of a query; no class
    is in one group whole. ``members`` are the corpus's ``classes``, if they are at hand. The jobs that write the classes run at the call.
    """
    members = (classes(corpus, k) if members is None else members).where(F.col("_nth") <= k)
    asked = queries.select("query_id", "vector").where("vector is not null")
    heads = written(asked.groupBy("vector").agg(F.min("query_id").alias("_asked")), "asked")
    near = nearest(heads.select(F.col("_asked").alias("query_id"), "vector"), members.where("_nth = 1").select("id", "vector"), k, places)
    found = near.select(F.col("query_id").alias("_asked"), F.col("id").alias("_class"), "sim").join(members.select("_class", "id"), "_class")
    w = Window.partitionBy("_asked").orderBy(F.col("sim").desc(), "id")
    best = found.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k).select("_asked", "id", "sim", "rank")
    return asked.join(heads, "vector").select("query_id", "_asked").join(best, "_asked").select("query_id", "id", "sim", "rank")


def mixed(queries: DataFrame, corpus: DataFrame, k: int = 20, expand: int = 4, weights: tuple[float, float, float] = (1.0, 1.0, 1.0), places: int = 6) -> DataFrame:
    """The k best of each query by a mix of three scores: query_id, id, score, rank from 0; ties by id.

    Both sides have an id (query_id, id), vector, sparse (a map of weights) and many (an array of vectors, as
    many as a text has parts). The k * expand nearest by vector are the candidates; of those alone the
    sparse product and the late interaction are worked out. A side without sparse weights or parts
    scores 0 there.
    """
    near = nearest(queries, corpus, k * expand, places)
    q = queries.select("query_id", F.col("sparse").alias("q_sparse"), F.col("many").alias("q_many"))
    both = near.join(F.broadcast(q), "query_id").join(corpus.select("id", "sparse", "many"), "id") if queries.count() <= 10_000 else near.join(q, "query_id").join(corpus.select("id", "sparse", "many"), "id")
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    sparse = F.coalesce(sparse_dot(F.col("q_sparse"), F.col("sparse")), F.lit(0.0))
    late = F.when(some("q_many") & some("many"), max_sim(F.col("q_many"), F.col("many"))).otherwise(0.0)
    dense, thin, many = weights
    score = F.round((dense * F.col("sim") + thin * sparse + many * late) / sum(weights), places)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    ranked = both.select("query_id", "id", score.alias("score")).withColumn("rank", F.row_number().over(w) - 1)
    return ranked.where(F.col("rank") < k)


def random_draws(queries: DataFrame, corpus: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """``k`` different rows of the corpus for each query, all of them equally likely: the query's columns and the row's.

    ``queries``: query_id and more, a stated set; ``corpus``: id and more. The corpus is put in an order by
    hash of which no more than the queries need is kept, and each query takes the next ``k`` rows,
    from the first again once all are used. Of fewer than ``k`` rows each query gets all.
    """
    n = queries.count()
    order = F.md5(F.concat_ws("|", F.col("id").cast("string"), F.lit(seed)))
    few = corpus.orderBy(order, "id").limit(n * k)
    drawn = few.withColumn("nth", F.row_number().over(Window.orderBy(order, "id")) - 1)
    m = F.lit(few.count())
    asked = queries.withColumn("i", F.row_number().over(Window.orderBy("query_id")) - 1).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).where(F.col("j") < m)
    return asked.withColumn("nth", (F.col("i").cast("long") * k + F.col("j")) % m).join(drawn, "nth").drop("nth", "i", "j")


def rrf(rank: Column, k: int = 10) -> Column:
    return F.coalesce(1 / (rank + F.lit(float(k + 1))), F.lit(0.0))


def lexical(query_tokens: Column, doc_tokens: Column) -> Column:
    n = F.size(F.array_intersect(query_tokens, doc_tokens))
    return F.when((F.size(query_tokens) == 0) | (F.size(doc_tokens) == 0), 0.0).otherwise(n / F.greatest(F.lit(1), F.least(F.size(query_tokens), F.lit(6))))


def entity_match(query_tokens: Column, name_tokens: Column) -> Column:
    """The best share of a name's tokens that the query has; ``name_tokens`` has an array a name, none of them empty."""
    each = F.transform(name_tokens, lambda t: F.size(F.array_intersect(query_tokens, t)) / F.size(t))
    return F.coalesce(F.array_max(each), F.lit(0.0))


def hedge_tokens(hedges: DataFrame) -> Column:
    return tokens(F.concat_ws(" ", "description", "relation", "type", "anchor", "entities"))


def with_tokens(hedges: DataFrame) -> DataFrame:
    """Hyperedges with what a search compares: ht, the tokens of all of one, and nt, those of each of its names that has any."""
    names = F.array_distinct(F.concat(F.array("anchor"), "entities"))
    return hedges.withColumns({"ht": hedge_tokens(hedges), "nt": F.filter(F.transform(names, lambda n: tokens(n)), lambda t: F.size(t) > 0)})


def retrieve_fused(queries: DataFrame, hedges: DataFrame, hedge_vectors: DataFrame, entity_vectors: DataFrame, index: DataFrame, top_k: int = 5, per_entity: int = 8, hedge_classes: DataFrame | None = None, entity_classes: DataFrame | None = None) -> DataFrame:
    """Hyperedges by their own similarity and through similar entities, by one score a candidate.

    ``queries``: query_id, text, vector, and top_k if each has its own; vectors have id and vector; ``index``: name, id. Candidates
    are some hundred rows a query. Ties: hedge rank, entity rank, expansion rank, id. ``hedges`` may have the columns of
    ``with_tokens`` already. With the ``classes`` of both tables of vectors equal vectors are compared once.
    """
    each = "top_k" in queries.columns
    most = queries.agg(F.max("top_k")).first()[0] or top_k if each else top_k
    q = queries.select("query_id", (F.col("top_k") if each else F.lit(top_k)).alias("top_k"), tokens(F.col("text")).alias("qt"))

    def near(corpus: DataFrame, least: int, times: int, members: DataFrame | None) -> DataFrame:
        k = max(least, times * most)
        rows = nearest(queries, corpus, k) if members is None else nearest_of_copies(queries, corpus, k, members=members)
        # The first ranks among more are the ranks among few.
        return rows.join(queries.select("query_id", "top_k"), "query_id").where(F.col("rank") < F.greatest(F.lit(least), times * F.col("top_k"))) if each else rows

    he = near(hedge_vectors, 40, 8, hedge_classes).select("query_id", "id", F.col("sim").alias("he_sim"), F.col("rank").alias("he_rank"))
    ent = near(entity_vectors, 12, 4, entity_classes).select("query_id", F.col("id").alias("name"), F.col("sim").alias("ent_sim"), F.col("rank").alias("ent_rank"))
    known = (hedges if "nt" in hedges.columns else with_tokens(hedges)).select("id", "anchor", "description", "ht", "nt")
    hits = ent.join(index.select("name", "id", "pos"), "name").join(known.drop("description"), "id").join(q, "query_id")
    hits = hits.withColumn("exp_score", 0.60 * F.col("ent_sim") + 0.20 * lexical(F.col("qt"), F.col("ht")) + 0.10 * entity_match(F.col("qt"), F.col("nt")) + 0.10 * F.when(F.col("anchor") == F.col("name"), 1.0).otherwise(0.35))
    w = Window.partitionBy("query_id", "name").orderBy(F.round("exp_score", 9).desc(), "id", "pos")
    exp = hits.withColumn("exp_rank", F.row_number().over(w) - 1).where(F.col("exp_rank") < per_entity)
    none = lambda t: F.lit(None).cast(t)
    both = he.select("query_id", "id", "he_sim", "he_rank", none("double").alias("ent_sim"), none("int").alias("ent_rank"), none("double").alias("exp_score"), none("int").alias("exp_rank"))
    both = both.unionByName(exp.select("query_id", "id", none("double").alias("he_sim"), none("int").alias("he_rank"), "ent_sim", "ent_rank", "exp_score", "exp_rank"))
    c = both.groupBy("query_id", "id").agg(*[f(n).alias(n) for f, n in ((F.max, "he_sim"), (F.min, "he_rank"), (F.max, "ent_sim"), (F.min, "ent_rank"), (F.max, "exp_score"), (F.min, "exp_rank"))])
    c = c.join(known, "id").join(q, "query_id")
    zero = lambda n: F.coalesce(n, F.lit(0.0))
    score = (
        0.41 * zero("he_sim") + 0.14 * zero("ent_sim") + 0.14 * rrf(F.col("he_rank")) + 0.10 * rrf(F.col("ent_rank")) + 0.08 * rrf(F.col("exp_rank"))
        + 0.08 * F.least(F.lit(1.0), zero("exp_score")) + 0.10 * lexical(F.col("qt"), F.col("ht")) + 0.05 * entity_match(F.col("qt"), F.col("nt"))
    )
    order = [F.col("score").desc(), F.col("he_rank").asc_nulls_last(), F.col("ent_rank").asc_nulls_last(), F.col("exp_rank").asc_nulls_last(), F.col("id")]
    ranked = c.withColumn("score", F.round(score, 6)).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= F.col("top_k")).select("query_id", "rank", "id", "score", "description")


def retrieve_plain(queries: DataFrame, hedge_vectors: DataFrame, entity_vectors: DataFrame, index: DataFrame, top_k: int = 5) -> DataFrame:
    """The nearest hyperedges, then two of each of the three nearest entities, to ``top_k`` in all."""
    he = nearest(queries, hedge_vectors, top_k).select("query_id", "id", F.lit(0).alias("stage"), F.col("rank").alias("a"), F.lit(0).alias("b"))
    ent = nearest(queries, entity_vectors, 3).select("query_id", F.col("id").alias("name"), F.col("rank").alias("a"))
    two = index.withColumn("b", F.row_number().over(Window.partitionBy("name").orderBy("hedge_ord", "pos"))).where("b <= 2")
    more = ent.join(two, "name").select("query_id", "id", F.lit(1).alias("stage"), "a", "b")
    first = he.unionByName(more).groupBy("query_id", "id").agg(F.min(F.struct("stage", "a", "b")).alias("o"))
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("o", "id")))
    return ranked.where(F.col("rank") <= top_k).select("query_id", "rank", "id")


def as_text(facts: Column) -> Column:
    """Facts as lines; a fixed sentence without any."""
    return F.when(F.coalesce(F.size(facts), F.lit(0)) == 0, "No relevant knowledge found.").otherwise(F.array_join(F.transform(facts, lambda f: F.concat(F.lit("- "), f)), "\n"))


def first_hits(ranked: DataFrame, matches: Column) -> DataFrame:
    """The rank of each query's first match, null without one."""
    return ranked.groupBy("query_id").agg(F.min(F.when(matches, F.col("rank"))).alias("first_rank"))


def hit_report(first: DataFrame) -> DataFrame:
    """hit@5, hit@10, hit@20 and MRR@20 over queries."""
    hit = lambda k: F.round(F.avg(F.coalesce((F.col("first_rank") < k).cast("int"), F.lit(0))), 4).alias(f"hit_{k}")
    return first.agg(F.count("*").alias("n"), hit(5), hit(10), hit(20), F.round(F.avg(F.when(F.col("first_rank") < 20, 1 / (F.col("first_rank") + 1)).otherwise(0.0)), 4).alias("mrr_20"))
