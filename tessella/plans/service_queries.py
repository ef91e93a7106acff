"""Queries of larger flows: evaluation over models and sets, the search service, loaders, token columns, training sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import build, evaluation, matching, token_counts, traces
from tessella.operators import graph as G
from tessella.operators import retrieval as R
from tessella.operators.sampling import sample
from tessella.serving import Searcher
from tessella.sources import readers, sinks
from tessella.sources.workdir import work_path, written

from .fixtures import ITEMS, TRACES, items, kg_edges, table, trace_messages
from .graph_queries import HYPER, hedges, shared_only
from .registry import QUERIES, SQL, query
from .tool_queries import SIGNALS, hashed_vectors, signals
from .vector_queries import FUSED, NEAREST, RETRIEVE, embeddings, parts, sources, toks


@query(rf"""with {ITEMS}, t as (select item_id, question as q, output as r, opd as a from items),
u as (select *, '## Thinking' || chr(10) || chr(10) || r || chr(10) || chr(10) || '## Final Response' || chr(10) || chr(10) || a as c, '<|im_start|>user' || chr(10) || chr(10) || q || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || chr(10) as p from t),
n as (select *, p || c || '<|im_end|>' || chr(10) as f from u)
select 'parts' as dataset, 'medreason' as dataset_label, item_id as row_idx, cast(item_id as varchar) as source_id, """ + ", ".join(f"cast(len(regexp_extract_all({x}, '[A-Za-z0-9]+|[^A-Za-z0-9\\s]')) as int) as {p}_tokens" for x, p in zip("qracpf", token_counts.PARTS, strict=True)) + " from n")  # fmt: skip
def c15_six_token_columns(spark, sf_dir):
    rows = items(spark, sf_dir).select(F.col("item_id").alias("row_idx"), F.col("item_id").alias("id"), "question", F.col("output").alias("Reasoning"), F.col("opd").alias("answer"))
    return token_counts.token_columns(rows, "parts")


HALVES = {"first": (1, 32), "second": (33, 32), "whole": (1, 64)}


@query("with " + ", ".join(f"""{name}_n as (select a.vec_id as query_id, a.label = b.label as good, row_number() over (partition by a.vec_id order by round(list_inner_product(a.embedding[{lo}:{lo + n - 1}]::double[], b.embedding[{lo}:{lo + n - 1}]::double[]), 6) desc, b.vec_id) - 1 as rank from embeddings a, embeddings b where a.vec_id % 100 = 0 and b.vec_id % 100 <> 0),
{name} as (select query_id, min(rank) filter (where good) as first_rank from {name}_n where rank < 20 group by 1)""" for name, (lo, n) in HALVES.items())
+ " union all ".join(f""" select '{name}' as model, count(*) as n, round(avg(case when first_rank < 5 then 1.0 else 0 end), 4) as hit_5, round(avg(case when first_rank < 10 then 1.0 else 0 end), 4) as hit_10, round(avg(case when first_rank < 20 then 1.0 else 0 end), 4) as hit_20, round(avg(case when first_rank < 20 then 1.0 / (first_rank + 1) else 0 end), 4) as mrr_20, false as failed from {name}""" for name in HALVES)
+ " union all select 'broken', null, null, null, null, null, true union all select 'unplanned', null, null, null, null, null, true")
def r9_over_models(spark, sf_dir):
    """Three models of parts of the dimensions, one that fails in its tasks, and one that has no plan."""
    q, c = parts(spark, sf_dir)
    labels = c.select("id", "label")
    cut = lambda key, lo, n: lambda texts: texts.select(key, F.slice("vector", lo, n).alias("vector"))
    models = {name: (cut("id", lo, n), cut("query_id", lo, n)) for name, (lo, n) in HALVES.items()}
    broken = lambda texts: texts.select("id", F.when(F.col("id") >= 0, F.raise_error(F.lit("this model is broken"))).otherwise(F.col("vector")).alias("vector"))
    models |= {"broken": (broken, cut("query_id", 1, 64)), "unplanned": (lambda texts: texts.select("absent"), cut("query_id", 1, 64))}
    want = q.select("query_id", F.col("label").alias("want"))
    judge = lambda found: found.join(want, "query_id").join(labels, "id").withColumn("match", F.col("want") == F.col("label"))
    rows = evaluation.over_models(models, c, q, judge)
    return rows.select("model", "n", "hit_5", "hit_10", "hit_20", "mrr_20", F.col("error").isNotNull().alias("failed"))


def asked(spark, sf_dir) -> DataFrame:
    """Every hundredth part as a question of each set: its answers speak of entities in various ways."""
    k = F.col("item_id")
    options = {"A": F.concat(F.lit("disease:"), k), "B": F.concat(F.lit("with drug:"), k % 50, F.lit(" and rest")), "C": F.lit("nothing known"), "D": F.concat(F.lit("DRUG:"), k % 40)}
    i = items(spark, sf_dir).where("item_id % 100 = 0").select("item_id", F.element_at(F.array(*[F.lit(x) for x in "ABCD"]), (F.floor(k / 100) % 4 + 1).cast("int")).alias("answer_idx"))
    e = embeddings(spark, sf_dir).select(F.col("id").alias("vec"), "vector")
    i = i.withColumn("vec", k % F.lit(e.count())).join(e, "vec").withColumn("options", F.create_map(*[x for o, t in options.items() for x in (F.lit(o), t)]))
    literal = F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries("options"), lambda x: F.concat(F.lit("'"), x["key"], F.lit("': '"), x["value"], F.lit("'"))), ", "), F.lit("}"))
    return i.select(k.alias("query_id"), "vector", F.element_at("options", F.col("answer_idx")).alias("answer"), "options", "answer_idx", F.when(k % 300 != 0, literal).otherwise("{broken").alias("options_literal"), F.col("answer_idx").alias("label"), F.element_at(F.array(F.lit("yes"), F.lit("no"), F.lit("maybe")), (F.floor(k / 100) % 3 + 1).cast("int")).alias("final_decision"))


@query("with " + RETRIEVE + f""",
bq as (select item_id as query_id, embedding as qv, cast(floor(item_id / 100.0) as bigint) as j from (select p_partkey as item_id from part where p_partkey % 100 = 0) join embeddings on vec_id = item_id % (select count(*) from embeddings)),
opt as (select *, ['disease:' || query_id, 'with drug:' || (query_id % 50) || ' and rest', 'nothing known', 'DRUG:' || (query_id % 40)][cast(j % 4 + 1 as int)] as said from bq),
ask as (select 'MedQA' as benchmark, 0.70 as target, query_id, qv, lower(trim(said)) as said from opt union all select 'MedMCQA', 0.60, query_id, qv, lower(trim(said)) from opt
  union all select 'MedXpertQA', 0.50, query_id, qv, case when query_id % 300 = 0 then '' else lower(trim(said)) end from opt union all select 'PubMedQA', 0.50, query_id, qv, ['yes', 'no', 'maybe'][cast(j % 3 + 1 as int)] from bq),
hv as (select hg.id, v.embedding, hg.entities from hg join embeddings v on v.vec_id = hg.hedge_ord % (select count(*) from embeddings)),
nb as (select query_id, hv.id, round(list_inner_product(qv::double[], hv.embedding::double[]), 6) as sim, hv.embedding, hv.entities from bq, hv),
nk as (select * from (select *, row_number() over (partition by query_id order by sim desc, id) - 1 as rank from nb) where rank < 10),
kw as (select a.benchmark, a.query_id, a.said, exists (select 1 from ent where contains(lower(ent.name), a.said) or (length(ent.name) >= 6 and contains(a.said, lower(ent.name)))) and a.said <> '' as known from ask a),
hi as (select kw.benchmark, kw.query_id, max(case when len(list_filter(nk.entities, lambda e: contains(lower(e), kw.said) or contains(kw.said, lower(e)))) > 0 then 1 else 0 end) as hit from kw join nk using (query_id) where known group by all),
rc as (select a.benchmark, count(h.query_id) as answerable, round(coalesce(avg(hit), 0.0), 6) as recall from (select distinct benchmark, query_id from ask) a left join hi h using (benchmark, query_id) group by 1),
ip as (select x.query_id, avg(list_inner_product(x.embedding::double[], y.embedding::double[])) as s from nk x join nk y on x.query_id = y.query_id and x.rank < y.rank and y.rank < 5 group by 1)
select benchmark, count(*) as n_samples, round(avg(case when sim > 0.7 then 1 else 0 end), 6) as semantic_relevance, round(avg(sim), 6) as top1_mean, round(quantile_cont(sim, 0.5), 6) as top1_median, round(quantile_cont(sim, 0.25), 6) as top1_p25, round(quantile_cont(sim, 0.75), 6) as top1_p75,
  cast(any_value(target) as double) as target, any_value(answerable) as answerable, any_value(recall) as entity_recall_10, (select round(avg(s), 6) from ip) as intra_top5
from ask join nk using (query_id) join rc using (benchmark) where rank = 0 group by 1""")
def g13_extrinsic(spark, sf_dir):
    """The four question sets against the graph."""
    _, h, hv, ev, _ = sources(spark, sf_dir)
    q, names = asked(spark, sf_dir), ev.select(F.col("id").alias("name"))
    # The sets ask the same questions.
    near = written(R.nearest_of_copies(q, hv, 10), "near")
    return reduce(DataFrame.unionByName, [evaluation.extrinsic(q, h, hv, names, b, near).select(F.lit(name).alias("benchmark"), "*") for name, b in evaluation.BENCHMARKS.items()])


def searcher(spark, sf_dir) -> Searcher:
    def load() -> dict[str, DataFrame]:
        _, h, hv, ev, index = sources(spark, sf_dir)
        return {"hedges": h, "hedge_vectors": hv, "entity_vectors": ev, "index": index}

    encode = hashed_vectors(spark, sf_dir)
    # Equal texts have one vector, whoever asks.
    vectors = lambda rows: rows.join(encode(rows.select("text").distinct()), "text")
    return Searcher(spark, load, vectors)


def requests(spark, sf_dir) -> DataFrame:
    """The text of every hundredth hyperedge, ten to a request, of 3 or by default 5 results."""
    h = hedges(spark, sf_dir).where("hedge_ord % 100 = 0").select("hedge_ord", "description")
    one = h.groupBy(F.floor(F.col("hedge_ord") / 1000).cast("long").alias("n")).agg(F.transform(F.array_sort(F.collect_list(F.struct("hedge_ord", "description"))), lambda x: x["description"]).alias("queries"))
    return one.select(F.concat(F.lit("r"), "n").alias("request_id"), "queries", F.when(F.col("n") % 2 == 1, 3).alias("top_k"))


_QS = FUSED[FUSED.index("qs as ("):FUSED.index("hs as (")]


@query("with " + FUSED.replace(_QS, f"qs as (select hg.hedge_ord as query_id, e.embedding as qv, hg.description as text, {toks('hg.description')} as qt from hg join embeddings e on e.vec_id = cast(concat('0x', substring(md5(hg.description), 1, 8)) as bigint) % (select count(*) from embeddings) where hg.hedge_ord % 100 = 0),\n").replace("where rank <= 5)", "where rank <= case when cast(floor(query_id / 1000.0) as bigint) % 2 = 1 then 3 else 5 end)").replace("ent_rank < 20)", "ent_rank < case when cast(floor(en.query_id / 1000.0) as bigint) % 2 = 1 then 12 else 20 end)").replace("he_rank < 40", "he_rank < case when cast(floor(query_id / 1000.0) as bigint) % 2 = 1 then 40 else 40 end").replace("where ent_rank < 20", "where ent_rank < case when cast(floor(en.query_id / 1000.0) as bigint) % 2 = 1 then 12 else 20 end")
+ """ select 'r' || cast(floor(query_id / 1000.0) as bigint) as request_id, cast(query_id % 1000 / 100 as int) as pos, string_agg(description, chr(10) order by rank) as results from fused group by query_id""")
def k10_search(spark, sf_dir):
    """Batches of searches through the handle."""
    s = searcher(spark, sf_dir)
    return s.search(requests(spark, sf_dir)).select("request_id", "pos", F.array_join("results", "\n").alias("results"))


@query(f"""with {NEAREST},
c as (select query_id, id, sim, q.embedding as qe, d.embedding as de from nr join embeddings q on q.vec_id = query_id join embeddings d on d.vec_id = id where rank < 20),
s as (select query_id, id, sim, list_sum(list_transform(range(1, 33), lambda i: case when qe[i] > 0.05 and de[i] > 0.05 then qe[i]::double * de[i]::double else 0.0 end)) as thin,
  list_transform(range(0, query_id % 3 + 2), lambda p: qe[p * 8 + 1:p * 8 + 8]::double[]) as qm, list_transform(range(0, id % 3 + 2), lambda p: de[p * 8 + 1:p * 8 + 8]::double[]) as dm from c),
l as (select *, list_sum(list_transform(qm, lambda x: list_max(list_transform(dm, lambda y: list_inner_product(x, y))))) / len(qm) as late from s),
m as (select query_id, id, round((1.0 * sim + 0.3 * thin + 1.0 * late) / 2.3, 6) as score from l)
select query_id, id, score, rank from (select *, row_number() over (partition by query_id order by score desc, id) - 1 as rank from m) where rank < 5""")
def v6_three_scores(spark, sf_dir):
    """Dense candidates, scored by dense, sparse and late-interaction products together."""
    q, c = parts(spark, sf_dir)

    def full(df: DataFrame, key: str) -> DataFrame:
        thin = F.map_from_entries(F.filter(F.transform(F.slice("vector", 1, 32), lambda x, i: F.struct(i.alias("k"), x.alias("v"))), lambda e: e["v"] > F.lit(0.05).cast("float")))
        many = F.transform(F.sequence(F.lit(0), (F.col(key) % 3 + 1).cast("int")), lambda p: F.slice("vector", p * 8 + 1, F.lit(8)))
        return df.select(key, "vector", thin.alias("sparse"), many.alias("many"))

    return R.mixed(full(q, "query_id"), full(c, "id"), 5, 4, (1.0, 0.3, 1.0))


@query()
def g5_priority_flow(spark, sf_dir):
    """Phrases of the benchmark's texts, and the phrases of the documents that they mean."""
    from tessella.functions.text import title_phrases

    names = table(spark, sf_dir, "documents").select(F.explode(title_phrases(F.col("text"))).alias("name")).distinct()
    return matching.priority_entities(table(spark, sf_dir, "benchmark").select("text"), names.select("name", F.col("name").alias("ordinal")))


@query("select s_suppkey, s_name, case when s_suppkey % 3 = 0 then 'test' else 'train' end as split from supplier")
def s8_saved_folder(spark, sf_dir):
    """A saved folder of a configuration with a table for each split; of two folders the newer is found."""
    path = work_path(spark, "saved")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    for name, rows in (("test", s.where("s_suppkey % 3 = 0")), ("train", s.where("s_suppkey % 3 <> 0"))):
        sinks.parquet(rows, f"{path}/data-2/en/{name}")
    sinks.parquet(s.limit(0), f"{path}/data-1/en/test")
    return readers.loaded(spark, readers.newest(spark, f"{path}/nothing*", f"{path}/data-*"), "en")


@query("select p_partkey, p_name from part where p_partkey % 2 = 0")
def s8_lines_file(spark, sf_dir):
    """A JSON lines source, by its ending."""
    path = work_path(spark, "lines") + ".jsonl"
    sinks.jsonl(table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select("p_partkey", "p_name"), path)
    return readers.table(spark, path, "p_partkey long, p_name string")


@query(f"""with {TRACES}, su as (select conv_id, count(tool_query) as n_calls from traces group by 1), no as (select conv_id, row_number() over (order by md5(conv_id || '|42'), conv_id) rn from su where n_calls = 0)
select conv_id, 'original' as augment_type from su where n_calls >= 1 union all select distinct conv_id, augment_type from ({SQL["c4_prefix_splits"]})
union all select conv_id, 'verbose_answer' from ({SQL["c5_verbose_answers"]}) join su using (conv_id) where n_calls >= 1 union all select conv_id, 'no_tool' from no where rn <= 600""")
def c6_training_union(spark, sf_dir):
    """All traces with calls, their shorter and their verbose versions, and up to 600 without calls."""
    m = trace_messages(spark, sf_dir)
    s = traces.summarized(m).select("conv_id", "n_calls")
    with_calls = s.where("n_calls >= 1").select("conv_id")
    answers = table(spark, sf_dir, "conversations").where("conv_id % 2 = 0").select("conv_id").distinct().withColumn("answer_text", F.concat(F.lit("text "), F.col("conv_id").cast("string")))
    verbose = traces.verbose_answers(m, answers).join(with_calls, "conv_id", "left_semi").select("conv_id", F.lit("verbose_answer").alias("augment_type"))
    splits = traces.prefix_splits(m).select("conv_id", "augment_type").distinct()
    none = sample(s.where("n_calls = 0"), "conv_id", 600).select("conv_id", F.lit("no_tool").alias("augment_type"))
    return with_calls.withColumn("augment_type", F.lit("original")).unionByName(splits).unionByName(verbose).unionByName(none)


@query(f"with {HYPER}" + """, n as (select (select count(*) from filtered) as filtered, (select count(*) from hg) as hyperedges, (select count(*) from ix) as entity_hedges, (select count(distinct name) from ix) as entities)
select 'filtered' as step, filtered as n from n union all select 'priority', 0 from n union all select 'hyperedges', hyperedges from n union all select 'entity_hedges', entity_hedges from n union all select 'entities', entities from n
union all select 'hedge_vectors', hyperedges from n union all select 'entity_vectors', entities from n""")
def g15_build(spark, sf_dir):
    """All steps with their files and vectors; the benchmark's phrases name no entity of this graph."""
    edges = kg_edges(spark, sf_dir, *G.KEEP_RELATIONS)
    steps = build.build(edges, work_path(spark, "graph"), hashed_vectors(spark, sf_dir), table(spark, sf_dir, "benchmark").select("text"), paired=shared_only(spark, sf_dir))
    return steps.select("step", "n")


@query(f"""with rep as ({SQL["g11_intrinsic_report"]}), em as (select (select mean from ({SQL["a21_anchor_similarity"]})) as anchor_mean, (select self_recall_5 from ({SQL["a20_self_recall"]})) as self_recall_5, (select most from ({SQL["a22_top_similarity"]})) as negative_max),
ck as (select 'no orphan entities' as "check", true as passed union all select 'no placeholder leaks', placeholder_leaks = 0 from rep union all select 'no empty descriptions', empty_descriptions = 0 from rep union all select 'few duplicates', duplicate_share < 0.001 from rep
  union all select 'anchors near descriptions', anchor_mean >= 0.75 from em union all select 'entities find themselves', self_recall_5 >= 0.75 from em union all select 'others far', negative_max < 0.72 from em
  union all select benchmark || ' relevance', semantic_relevance >= target from ({SQL["g13_extrinsic"]}))
select *, (select count(*) from ck) as total, (select count(*) from ck where passed) as n_passed, (select count(*) from ck where not passed) as n_failed from ck""")
def g14_summary(spark, sf_dir):
    """Every check of the graph, its embedding and the question sets, with totals."""
    h = hedges(spark, sf_dir)
    index = G.entity_hedges(h)
    orphans = G.entities(index).join(index.select("name").distinct(), "name", "left_anti").agg(F.count("*").alias("orphans"))
    one = lambda name, column, to: QUERIES[name](spark, sf_dir).select(F.col(column).alias(to))
    embedding = one("a21_anchor_similarity", "mean", "anchor_mean").crossJoin(one("a20_self_recall", "self_recall_5", "self_recall_5")).crossJoin(one("a22_top_similarity", "most", "negative_max"))
    return build.summary(G.intrinsic_report(h), orphans, embedding, g13_extrinsic(spark, sf_dir))


@query(f"""with {HYPER}, d as (select name, count(distinct id) as n from ix group by 1)
select count(*) as n_entities, round(avg(n), 6) as mean, cast(min(n) as bigint) as least, round(quantile_cont(n, 0.05), 6) as p5, round(quantile_cont(n, 0.5), 6) as median, round(quantile_cont(n, 0.95), 6) as p95, cast(max(n) as bigint) as most from d""")
def a9_hedges_per_entity(spark, sf_dir):
    d = G.entity_hedges(hedges(spark, sf_dir)).select("name", "id").distinct().groupBy("name").agg(F.count("*").alias("n"))
    p = lambda x: F.round(F.percentile("n", x), 6)
    return d.agg(F.count("*").alias("n_entities"), F.round(F.avg("n"), 6).alias("mean"), F.min("n").alias("least"), p(0.05).alias("p5"), p(0.5).alias("median"), p(0.95).alias("p95"), F.max("n").alias("most"))


@query(f"with {SIGNALS} select conv_id % 3 as part, count(retrieval_sim) as n, round(quantile_cont(retrieval_sim, 0.25), 6) as p25, round(quantile_cont(retrieval_sim, 0.5), 6) as p50, round(quantile_cont(retrieval_sim, 0.75), 6) as p75 from sg group by 1")
def a14b_retrieval_quartiles(spark, sf_dir):
    p = lambda x: F.round(F.percentile("retrieval_sim", x), 6)
    return signals(spark, sf_dir).groupBy((F.col("conv_id") % 3).alias("part")).agg(F.count("retrieval_sim").alias("n"), p(0.25).alias("p25"), p(0.5).alias("p50"), p(0.75).alias("p75"))


@query("select 'NATION_' || n_nationkey as key, n_name as value from nation")
def s13_settings(spark, sf_dir):
    """A settings file: comments, quotes, and names that come again don't count."""
    path = work_path(spark, "settings")
    n = table(spark, sf_dir, "nation")
    name = F.concat(F.lit("NATION_"), "n_nationkey")
    lines = n.select(F.explode(F.array(F.lit("# comment"), F.concat(name, F.lit(' = "'), "n_name", F.lit('"')), F.concat(name, F.lit("=again")), F.lit(""))).alias("value"))
    lines.coalesce(1).write.text(path)  # a settings file is one file
    return readers.settings(spark, readers.newest(spark, f"{path}/part-*"))


@query(f"with {HYPER} select 'hyperedges' as kept, count(*) as n from hg union all select 'entity_hedges', count(*) from ix union all select 'entities', count(distinct name) from ix")
def k6_graph_tables(spark, sf_dir):
    """The graph as tables, written and read back."""
    h, path = hedges(spark, sf_dir), work_path(spark, "tables")
    index = G.entity_hedges(h)
    sinks.hypergraph(h, index, G.entities(index), path)
    return reduce(DataFrame.unionByName, [readers.table(spark, f"{path}/{name}").agg(F.count("*").alias("n")).select(F.lit(name).alias("kept"), "n") for name in ("hyperedges", "entity_hedges", "entities")])
