"""Queries on vectors and retrieval. The vectors are synthetic: they test the engine, not quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import vectors as V
from tessella.operators import graph as G
from tessella.operators import matching
from tessella.operators import retrieval as R

from .fixtures import table
from .graph_queries import HYPER, hedges
from .registry import query


def embeddings(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def parts(spark, sf_dir):
    """The queries, every vector whose id is divisible by 100, and the corpus, all others."""
    e = embeddings(spark, sf_dir)
    return e.where("id % 100 = 0").withColumnRenamed("id", "query_id"), e.where("id % 100 <> 0")


DOT = "list_inner_product(a.embedding::double[], b.embedding::double[])"
NEAREST = f"""
nn as (select a.vec_id as query_id, b.vec_id as id, round({DOT}, 6) as sim, a.label as q_label, b.label as label from embeddings a, embeddings b where a.vec_id % 100 = 0 and b.vec_id % 100 <> 0),
nr as (select *, row_number() over (partition by query_id order by sim desc, id) - 1 as rank from nn)"""


@query(f"select a.vec_id as a, b.vec_id as b, round({DOT}, 6) as sim from embeddings a, embeddings b where a.vec_id % 100 = 0")
def v1_inner_product(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    return R.scores(e.where("id % 100 = 0").withColumnRenamed("id", "query_id"), e).select(F.col("query_id").alias("a"), F.col("id").alias("b"), F.round("sim", 6).alias("sim"))


@query("select vec_id as id, round(list_sum(list_transform(embedding, lambda x: x::double * 3 / greatest(sqrt(list_inner_product(embedding::double[], embedding::double[])) * 3, 1e-8))), 6) as total from embeddings")
def v2_normalized(spark, sf_dir):
    tripled = F.transform("vector", lambda x: x.cast("double") * 3)
    return embeddings(spark, sf_dir).select("id", F.round(F.aggregate(V.normalized(tripled), F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query(f"select a.label, round(avg({DOT}), 6) as mean_sim, count(*) as n from embeddings a join embeddings b on a.label = b.label and a.vec_id < b.vec_id group by 1")
def v3_pairwise_mean(spark, sf_dir):
    """All pairs' mean without the pairs: the square of the sum is the sum of all products."""
    e = embeddings(spark, sf_dir)
    own = e.groupBy("label").agg(F.count("*").alias("n"), F.sum(V.dot(F.col("vector"), F.col("vector"))).alias("own"))
    total = e.select("label", F.posexplode("vector").alias("at", "x")).groupBy("label", "at").agg(F.sum(F.col("x").cast("double")).alias("s")).groupBy("label").agg(F.sum(F.col("s") * F.col("s")).alias("all"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return own.join(total, "label").where("n > 1").select("label", F.round((F.col("all") - F.col("own")) / 2 / pairs, 6).alias("mean_sim"), pairs.cast("long").alias("n"))


@query("select vec_id as id, round((embedding[2]::double * embedding[3]::double) + (embedding[3]::double * embedding[4]::double), 6) as score from embeddings")
def v4_sparse_dot(spark, sf_dir):
    at = lambda i: F.col("vector")[i]
    a = F.create_map(F.lit("p"), at(0), F.lit("q"), at(1), F.lit("r"), at(2))
    b = F.create_map(F.lit("q"), at(2), F.lit("r"), at(3), F.lit("s"), at(4))
    return embeddings(spark, sf_dir).select("id", F.round(V.sparse_dot(a, b), 6).alias("score"))


@query("""with m as (select vec_id as id, embedding[1:8]::double[] q1, embedding[9:16]::double[] q2, embedding[17:24]::double[] d1, embedding[25:32]::double[] d2 from embeddings)
select id, round((greatest(list_inner_product(q1, d1), list_inner_product(q1, d2)) + greatest(list_inner_product(q2, d1), list_inner_product(q2, d2))) / 2, 6) as score from m""")
def v5_max_sim(spark, sf_dir):
    cut = lambda i: F.slice("vector", i, 8)
    return embeddings(spark, sf_dir).select("id", F.round(V.max_sim(F.array(cut(1), cut(9)), F.array(cut(17), cut(25))), 6).alias("score"))


@query(f"""with {NEAREST},
c as (select nr.query_id, nr.id, sim, list_inner_product(q.embedding[1:8]::double[], d.embedding[1:8]::double[]) as s2 from nr join embeddings q on q.vec_id = query_id join embeddings d on d.vec_id = id where rank < 20),
s as (select query_id, id, round((0.4 * sim + 0.6 * s2) / 1.0, 6) as score from c)
select query_id, id, score, rank from (select *, row_number() over (partition by query_id order by score desc, id) - 1 as rank from s) where rank < 5""")
def v6_two_stage(spark, sf_dir):
    """The 20 nearest, scored again on part of the dimensions, five kept."""
    from pyspark.sql import Window

    q, c = parts(spark, sf_dir)
    first = R.nearest(q, c, 20).join(q.select("query_id", F.slice("vector", 1, 8).alias("x")), "query_id").join(c.select("id", F.slice("vector", 1, 8).alias("y")), "id")
    scored = first.select("query_id", "id", F.round(0.4 * F.col("sim") + 0.6 * V.dot(F.col("x"), F.col("y")), 6).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")) - 1).where("rank < 5")


@query(f"with {NEAREST} select query_id, max(sim) as best from nn group by 1")
def v7_best_similarity(spark, sf_dir):
    q, c = parts(spark, sf_dir)
    return R.nearest(q, c, 1).select("query_id", F.col("sim").alias("best"))


@query(f"with {NEAREST} select query_id, id, sim, rank from nr where rank < 10")
def j13_nearest(spark, sf_dir):
    q, c = parts(spark, sf_dir)
    return R.nearest(q, c, 10)


HITS = NEAREST + """,
fh as (select query_id, min(rank) filter (where q_label = label) as first_rank from nr where rank < 20 group by 1)"""


def hits(spark, sf_dir):
    q, c = parts(spark, sf_dir)
    near = R.nearest(q, c, 20).join(q.select("query_id", F.col("label").alias("want")), "query_id").join(c.select("id", "label"), "id")
    return R.first_hits(near, F.col("want") == F.col("label"))


@query(f"with {HITS} select * from fh")
def w3_first_hit(spark, sf_dir):
    return hits(spark, sf_dir)


@query(f"""with {HITS} select count(*) as n, round(avg(case when first_rank < 5 then 1 else 0 end), 4) as hit_5, round(avg(case when first_rank < 10 then 1 else 0 end), 4) as hit_10,
round(avg(case when first_rank < 20 then 1 else 0 end), 4) as hit_20, round(avg(case when first_rank < 20 then 1.0 / (first_rank + 1) else 0 end), 4) as mrr_20 from fh""")
def a19_hit_report(spark, sf_dir):
    return R.hit_report(hits(spark, sf_dir))


@query(f"with {NEAREST}, t as (select sim from nr where rank = 0) select round(avg(sim), 4) as mean, max(sim) as most, round(avg(case when sim > 0.7 then 1 else 0 end), 6) as share_over, round(quantile_cont(sim, 0.25), 6) as p25, round(quantile_cont(sim, 0.5), 6) as median, round(quantile_cont(sim, 0.75), 6) as p75 from t")
def a22_top_similarity(spark, sf_dir):
    q, c = parts(spark, sf_dir)
    p = lambda x: F.round(F.percentile("sim", x), 6)
    return R.nearest(q, c, 1).agg(F.round(F.avg("sim"), 4).alias("mean"), F.max("sim").alias("most"), F.round(F.avg((F.col("sim") > 0.7).cast("int")), 6).alias("share_over"), p(0.25).alias("p25"), p(0.5).alias("median"), p(0.75).alias("p75"))


@query(f"""with {NEAREST}, t as (select query_id, id, rank, q_label = label as good from nr where rank < 10),
g as (select query_id, bool_or(good) as found from t group by 1), i as (select avg({DOT}) as v from t x join t y on x.query_id = y.query_id and x.rank < y.rank join embeddings a on a.vec_id = x.id join embeddings b on b.vec_id = y.id where x.rank < 5 and y.rank < 5)
select round(avg(case when found then 1 else 0 end), 6) as recall_10, (select round(v, 6) from i) as intra_top5 from g""")
def a23_benchmark_report(spark, sf_dir):
    q, c = parts(spark, sf_dir)
    top = R.nearest(q, c, 10).join(q.select("query_id", F.col("label").alias("want")), "query_id").join(c.select("id", "label", "vector"), "id")
    recall = top.groupBy("query_id").agg(F.max((F.col("want") == F.col("label")).cast("int")).alias("found")).agg(F.round(F.avg("found"), 6).alias("recall_10"))
    five = top.where("rank < 5")
    a, b = five.alias("a"), five.alias("b")
    intra = a.join(b, (F.col("a.query_id") == F.col("b.query_id")) & (F.col("a.rank") < F.col("b.rank"))).agg(F.round(F.avg(V.dot(F.col("a.vector"), F.col("b.vector"))), 6).alias("intra_top5"))
    return recall.crossJoin(intra)  # one row each


@query("""with q as (select vec_id as query_id, label as want, row_number() over (order by vec_id) - 1 as i from embeddings where vec_id % 100 = 0),
c as (select vec_id, label, row_number() over (order by md5(vec_id || '|42'), vec_id) - 1 as nth from embeddings where vec_id % 100 <> 0), s as (select * from c where nth < 10 * (select count(*) from q)), m as (select count(*) as m from s)
select round(avg(hit), 6) as recall_10 from (select query_id, max(case when want = label then 1 else 0 end) as hit from q, m, (select unnest(range(10)) as j) join s on nth = (i * 10 + j) % m where j < m group by 1)""")
def a24_random_baseline(spark, sf_dir):
    """The share of queries of which one of ten vectors drawn from the whole corpus has the label.

    The corpus is shuffled by the hash of its ids, and each query draws the next ten.
    """
    q, c = parts(spark, sf_dir)
    drawn = R.random_draws(q.select("query_id", F.col("label").alias("want")), c.select("id", "label"), 10)
    return drawn.groupBy("query_id").agg(F.max((F.col("want") == F.col("label")).cast("int")).alias("hit")).agg(F.round(F.avg("hit"), 6).alias("recall_10"))


STOPS = "[" + ", ".join(f"'{w}'" for w in ["a", "an", "and", "are", "as", "at", "be", "by", "does", "for", "from", "how", "in", "is", "of", "on", "or", "the", "to", "what", "which", "with"]) + "]"


def toks(x: str) -> str:
    return f"list_filter(list_distinct(regexp_extract_all(lower({x}), '[a-z0-9]+')), lambda w: not list_contains({STOPS}, w))"


@query(f"""with b as (select item_id, text as answer, {toks("text")} as bt from benchmark),
d as (select doc_id, text, {toks("text")} as dt from documents),
j as (select item_id, doc_id, case when contains(lower(text), lower(answer)) then 1.0 when len(bt) >= 2 and len(list_intersect(bt, dt)) / len(bt) >= 0.6 then len(list_intersect(bt, dt)) / len(bt) else 0.0 end as score from b, d)
select item_id, doc_id, round(score, 6) as score from j where score > 0""")
def j14_answer_in_text(spark, sf_dir):
    """All items against all texts."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("answer"))
    return matching.answers_in_texts(b, table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("score", F.round("score", 6))


def sources(spark, sf_dir):
    """Queries with text and vector, the hypergraph, and vectors of its hyperedges and entities."""
    h = hedges(spark, sf_dir)
    e = embeddings(spark, sf_dir)
    v = e.select(F.col("id").alias("vec"), "vector")
    n = F.lit(e.count())
    index = G.entity_hedges(h)
    names = G.entities(index).select(F.col("name").alias("id"), (F.conv(F.substring(F.md5("name"), 1, 8), 16, 10).cast("long") % n).alias("vec"))
    hv = h.select("id", (F.col("hedge_ord") % n).alias("vec")).join(v, "vec").select("id", "vector")
    ev = names.join(v, "vec").select("id", "vector")
    asked = e.where("id % 100 = 0").select(F.col("id").alias("query_id"), "vector", (F.col("id") * 40 % F.lit(h.count())).alias("hedge_ord"))
    q = asked.join(h.select("hedge_ord", F.col("description").alias("text")), "hedge_ord").select("query_id", "vector", "text")
    return q, h, hv, ev, index


RETRIEVE = HYPER + f""",
ent as (select name, cast(concat('0x', substring(md5(name), 1, 8)) as bigint) % (select count(*) from embeddings) as vec from (select distinct name from ix)),
qs as (select e.vec_id as query_id, e.embedding as qv, hg.description as text, {toks("hg.description")} as qt from embeddings e join hg on hg.hedge_ord = e.vec_id * 40 % (select count(*) from hg) where e.vec_id % 100 = 0),
hs as (select query_id, hg.id, round(list_inner_product(qv::double[], v.embedding::double[]), 6) as sim from hg join embeddings v on v.vec_id = hg.hedge_ord % (select count(*) from embeddings), qs),
hn as (select query_id, id, sim as he_sim, row_number() over (partition by query_id order by sim desc, id) - 1 as he_rank from hs),
es as (select query_id, name, round(list_inner_product(qv::double[], v.embedding::double[]), 6) as sim from ent join embeddings v on v.vec_id = ent.vec, qs),
en as (select query_id, name, sim as ent_sim, row_number() over (partition by query_id order by sim desc, name) - 1 as ent_rank from es)"""


@query("with " + RETRIEVE + """,
two as (select *, row_number() over (partition by name order by hedge_ord, pos) b from ix),
al as (select query_id, id, 0 as stage, he_rank as a, 0 as b from hn where he_rank < 5 union all select query_id, id, 1, ent_rank, b from en join two using (name) where ent_rank < 3 and b <= 2),
fi as (select query_id, id, min((stage, a, b)) as o from al group by all)
select query_id, rank, id from (select *, row_number() over (partition by query_id order by o, id) as rank from fi) where rank <= 5""")
def r1_retrieve_plain(spark, sf_dir):
    q, _, hv, ev, index = sources(spark, sf_dir)
    return R.retrieve_plain(q, hv, ev, index)


MATCH = "coalesce(list_max(list_transform(list_filter(list_transform(names, lambda n: {}), lambda t: len(t) > 0), lambda t: len(list_intersect(qt, t)) / len(t))), 0.0)".format(toks("n"))
LEX = "case when len(qt) = 0 or len(ht) = 0 then 0.0 else len(list_intersect(qt, ht)) / greatest(1, least(len(qt), 6)) end"
FUSED = RETRIEVE + f""",
kn as (select id, anchor, description, {toks("concat_ws(' ', description, relation, type, anchor, array_to_string(entities, ' '))")} as ht, list_prepend(anchor, entities) as names from hg),
xs as (select en.query_id, en.name, en.ent_sim, en.ent_rank, ix.id, ix.pos, 0.60 * ent_sim + 0.20 * ({LEX}) + 0.10 * ({MATCH}) + 0.10 * (case when kn.anchor = en.name then 1.0 else 0.35 end) as exp_score
       from en join ix using (name) join kn on kn.id = ix.id join qs on qs.query_id = en.query_id where ent_rank < 20),
xr as (select *, row_number() over (partition by query_id, name order by round(exp_score, 9) desc, id, pos) - 1 as exp_rank from xs),
ca as (select query_id, id, max(he_sim) he_sim, min(he_rank) he_rank, max(ent_sim) ent_sim, min(ent_rank) ent_rank, max(exp_score) exp_score, min(exp_rank) exp_rank from (
   select query_id, id, he_sim, he_rank, null as ent_sim, null as ent_rank, null as exp_score, null as exp_rank from hn where he_rank < 40
   union all select query_id, id, null, null, ent_sim, ent_rank, exp_score, exp_rank from xr where exp_rank < 8) group by all),
sc as (select ca.query_id, ca.id, description, he_rank, ent_rank, exp_rank, round(0.41 * coalesce(he_sim, 0) + 0.14 * coalesce(ent_sim, 0) + 0.14 * coalesce(1 / (he_rank + 11.0), 0) + 0.10 * coalesce(1 / (ent_rank + 11.0), 0)
   + 0.08 * coalesce(1 / (exp_rank + 11.0), 0) + 0.08 * least(1.0, coalesce(exp_score, 0)) + 0.10 * ({LEX}) + 0.05 * ({MATCH}), 6) as score
   from ca join kn using (id) join qs using (query_id)),
fused as (select * from (select *, row_number() over (partition by query_id order by score desc, he_rank asc nulls last, ent_rank asc nulls last, exp_rank asc nulls last, id) as rank from sc) where rank <= 5)"""


@query(f"with {FUSED} select query_id, rank, id, score, description from fused")
def r2_retrieve_fused(spark, sf_dir):
    return R.retrieve_fused(*sources(spark, sf_dir))


@query(f"with {FUSED} select query_id, string_agg('- ' || description, chr(10) order by rank) as facts from fused group by 1")
def r7_facts_text(spark, sf_dir):
    rows = R.retrieve_fused(*sources(spark, sf_dir)).groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "description"))), lambda x: x["description"]).alias("f"))
    return rows.select("query_id", R.as_text(F.col("f")).alias("facts"))


@query(f"with {RETRIEVE} select (select count(*) from hg) as n_hyperedges, (select count(*) from ent) as n_entities")
def k10_health(spark, sf_dir):
    h = hedges(spark, sf_dir)
    return h.agg(F.count("*").alias("n_hyperedges")).crossJoin(G.entities(G.entity_hedges(h)).agg(F.count("*").alias("n_entities")))


@query(f"with {RETRIEVE}, top as (select en.query_id, name, ent_rank from en where ent_rank < 5) select query_id, count(distinct ix.id) as n_hedges from top join ix using (name) group by 1")
def j4_entity_expansion(spark, sf_dir):
    q, _, _, ev, index = sources(spark, sf_dir)
    near = R.nearest(q, ev, 5).select("query_id", F.col("id").alias("name"))
    return near.join(index, "name").groupBy("query_id").agg(F.countDistinct("id").alias("n_hedges"))


@query(f"""with {RETRIEVE},
vs as (select a.vec_id as x, b.vec_id as y, round({DOT}, 6) as sim from embeddings a, embeddings b),
er as (select x as vec, h.id, row_number() over (partition by x order by sim desc, h.id) as rank from vs join hg h on h.hedge_ord % (select count(*) from embeddings) = vs.y),
ek as (select name, id from er join ent using (vec) where rank <= 5)
select round(avg(hit), 6) as self_recall_5 from (select name, max(case when exists (select 1 from ix where ix.name = ek.name and ix.id = ek.id) then 1 else 0 end) as hit from ek group by 1)""")
def a20_self_recall(spark, sf_dir):
    """The share of all entities of which one of the five nearest hyperedges is their own."""
    _, _, hv, ev, index = sources(spark, sf_dir)
    q = ev.withColumnRenamed("id", "query_id")
    own = index.select(F.col("name").alias("query_id"), "id", F.lit(1).alias("own")).distinct()
    near = R.nearest_of_copies(q, hv, 5).join(own, ["query_id", "id"], "left")
    return near.groupBy("query_id").agg(F.max(F.coalesce("own", F.lit(0))).alias("hit")).agg(F.round(F.avg("hit"), 6).alias("self_recall_5"))


@query(f"""with {RETRIEVE}, c as (select round(list_inner_product(x.embedding::double[], y.embedding::double[]), 6) as sim from hg join ent on ent.name = hg.anchor join embeddings x on x.vec_id = ent.vec join embeddings y on y.vec_id = hg.hedge_ord % (select count(*) from embeddings))
select count(*) as n, round(avg(sim), 6) as mean, round(quantile_cont(sim, 0.1), 6) as p10, min(sim) as least from c""")
def a21_anchor_similarity(spark, sf_dir):
    _, h, hv, ev, _ = sources(spark, sf_dir)
    rows = h.select("id", "anchor").join(hv, "id").join(ev.select(F.col("id").alias("anchor"), F.col("vector").alias("v")), "anchor").select(F.round(V.dot(F.col("vector"), F.col("v")), 6).alias("sim"))
    return rows.agg(F.count("*").alias("n"), F.round(F.avg("sim"), 6).alias("mean"), F.round(F.percentile("sim", 0.1), 6).alias("p10"), F.min("sim").alias("least"))
