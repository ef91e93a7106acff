"""Queries that write a table in a format and read it back, and those on splits, sets and order."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import graph as G
from tessella.operators import matching, parsing, sampling
from tessella.operators import retrieval as R
from tessella.operators.adapters import ADAPTERS
from tessella.sources import readers, sinks
from tessella.sources.workdir import work_path

from .adapter_queries import again, said
from .fixtures import ITEMS, KG, TRACES, items, kg_edges, table, trace_messages
from .graph_queries import FILTERED, HYPER, filtered, hedges, shared_only
from .qa_queries import OPTIONS, PARSED, explicit, with_options
from .registry import query
from .vector_queries import embeddings


@query(f"with {KG} select relation, x_index, x_type, x_name, y_index, y_type, y_name from edges where relation = 'indication'")
def s1_k5_csv_edges(spark, sf_dir):
    path = work_path(spark, "edges")
    sinks.csv(kg_edges(spark, sf_dir, "indication").where("relation = 'indication'").select("relation", "x_index", "x_type", "x_name", "y_index", "y_type", "y_name"), path)
    return readers.edges_csv(spark, path)


@query("select n_nationkey, n_name, n_regionkey from nation")
def s2_k1_parquet(spark, sf_dir):
    path = work_path(spark, "nation")
    sinks.parquet(table(spark, sf_dir, "nation"), path)
    return readers.table(spark, path).select("n_nationkey", "n_name", "n_regionkey")


@query(f"with {HYPER} select name, id from ix")
def s3_k2_hypergraph_document(spark, sf_dir):
    h, path = hedges(spark, sf_dir), work_path(spark, "hypergraph")
    index = G.entity_hedges(h)
    sinks.hypergraph_json(h, index, G.entities(index), path)
    return readers.hypergraph_lines(spark, path)[2].select("name", "id")


@query(f"with {ITEMS} select item_id, output from items")
def s4_k3_jsonl(spark, sf_dir):
    path = work_path(spark, "items.jsonl")
    rows = items(spark, sf_dir).select("item_id", "output")
    sinks.jsonl(rows.where("item_id % 2 = 0"), path)
    sinks.jsonl(rows.where("item_id % 2 = 1"), path, append=True)
    return readers.jsonl(spark, path, "item_id long, output string")


@query("select count(*) filter (where p_partkey % 5 <> 0) as n_good, count(*) filter (where p_partkey % 5 = 0) as n_bad from part")
def s5_jsonl_with_report(spark, sf_dir):
    path = work_path(spark, "some.jsonl")
    line = F.when(F.col("p_partkey") % 5 == 0, "{not json").otherwise(F.to_json(F.struct("p_partkey")))
    table(spark, sf_dir, "part").select(line.alias("value")).write.text(path)
    rows = readers.jsonl(spark, path, "p_partkey long", "report").select("_corrupt_record", "p_partkey")
    return rows.agg(F.count("p_partkey").alias("n_good"), F.count_if(F.col("p_partkey").isNull() & F.col("_corrupt_record").isNotNull()).alias("n_bad"))


@query("select p_partkey from part where p_partkey % 5 <> 0")
def s6_jsonl_keys(spark, sf_dir):
    path = work_path(spark, "keys.jsonl")
    line = F.when(F.col("p_partkey") % 10 == 0, "{not json").when(F.col("p_partkey") % 5 == 0, '{"other": 1}').otherwise(F.to_json(F.struct("p_partkey")))
    table(spark, sf_dir, "part").select(line.alias("value")).write.text(path)
    return readers.jsonl(spark, path, "p_partkey long", "drop", ("p_partkey",))


@query("select o_orderkey as id, 'test' as split from orders where o_orderkey % 3 = 1")
def s9_split_selection(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.element_at(F.array(F.lit("train"), F.lit("test"), F.lit("dev")), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("split"))
    return readers.split_of(rows)


@query("select vec_id as id, len(embedding) as n, round(embedding[1]::double, 6) as first from embeddings")
def s11_k8_vectors(spark, sf_dir):
    path = work_path(spark, "vectors")
    sinks.vectors(embeddings(spark, sf_dir), path)
    return readers.table(spark, path).select("id", F.size("vector").cast("long").alias("n"), F.round(F.col("vector")[0].cast("double"), 6).alias("first"))


@query("select '{\"n_nations\":' || count(*) || '}' as value from nation")
def k4_k12_json_report(spark, sf_dir):
    path = work_path(spark, "report")
    sinks.report(table(spark, sf_dir, "nation").agg(F.count("*").alias("n_nations")), path)
    return spark.read.text(path)


@query("select s_suppkey as id, coalesce(n_name, '') as name from supplier left join nation on n_nationkey = s_nationkey")
def j5_metadata_lookup(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return table(spark, sf_dir, "supplier").join(n, F.col("n_nationkey") == F.col("s_nationkey"), "left").select(F.col("s_suppkey").alias("id"), F.coalesce("n_name", F.lit("")).alias("name"))


@query(f"with {TRACES}, a as (select conv_id, 'text ' || conv_id as answer_text from conversations where conv_id % 2 = 0 group by 1) select distinct t.conv_id, a.answer_text from traces t join a using (conv_id)")
def j11_answer_lookup(spark, sf_dir):
    a = table(spark, sf_dir, "conversations").where("conv_id % 2 = 0").select("conv_id").distinct().withColumn("answer_text", F.concat(F.lit("text "), F.col("conv_id").cast("string")))
    return trace_messages(spark, sf_dir).select("conv_id").distinct().join(a, "conv_id")


@query(f"with {ITEMS} select item_id, opa as key, gold as value from items where cop = 0 union all select item_id, opb, gold from items where cop = 1")
def j12_zipped(spark, sf_dir):
    z = F.arrays_zip(F.array("opa", "opb").alias("k"), F.array("gold", "gold").alias("v"))
    return items(spark, sf_dir).where("cop < 2").select("item_id", F.element_at(z, F.col("cop") + 1).alias("z")).select("item_id", F.col("z.k").alias("key"), F.col("z.v").alias("value"))


@query(f"with {FILTERED} select p.e, count(*) as n from (select x_name e from filtered where relation = 'indication' union all select y_name from filtered where relation = 'indication') p where not exists (select 1 from filtered f where f.relation = 'contraindication' and f.x_name = p.e) group by 1")
def j10_u5_rest(spark, sf_dir):
    e = filtered(spark, sf_dir)
    i = e.where("relation = 'indication'")
    p = i.select(F.col("x_name").alias("e")).unionByName(i.select(F.col("y_name").alias("e")))
    return p.join(e.where("relation = 'contraindication'").select(F.col("x_name").alias("e")).distinct(), "e", "left_anti").groupBy("e").agg(F.count("*").alias("n"))


@query(f"with {ITEMS} select item_id, row_number() over (order by item_id) - 1 + 100 as row_idx from items")
def w11_row_index(spark, sf_dir):
    return G.dense_ordinal(items(spark, sf_dir).select("item_id"), ["item_id"], "row_idx").withColumn("row_idx", F.col("row_idx") + 100)


@query(f"with {TRACES}, m as (select *, lead(role) over (partition by conv_id order by seq) as next_role from traces) select conv_id, seq, coalesce(next_role = 'tool', false) as answered from m where tool_query is not null")
def w8_answered_calls(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("seq")
    return trace_messages(spark, sf_dir).withColumn("next_role", F.lead("role").over(w)).where("tool_query is not null").select("conv_id", "seq", F.coalesce(F.col("next_role") == "tool", F.lit(False)).alias("answered"))


@query(f"with {KG}, r as (select x_name, y_name, row_number() over (partition by x_name order by y_index, y_name) rn from edges where relation = 'indication') select x_name, y_name, cast(rn as int) as rn from r where rn <= 8")
def w2_t1_first_n(spark, sf_dir):
    w = Window.partitionBy("x_name").orderBy("y_index", "y_name")
    return kg_edges(spark, sf_dir, "indication").where("relation = 'indication'").withColumn("rn", F.row_number().over(w)).where("rn <= 8").select("x_name", "y_name", "rn")


@query(f"with {ITEMS} select item_id from items order by item_id limit 25")
def t2_t11_head(spark, sf_dir):
    return items(spark, sf_dir).select("item_id").orderBy("item_id").limit(25)


@query("select p_brand, count(*) as n from part group by 1 order by n desc, p_brand limit 10")
def t3_t4_top_counts(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "p_brand").limit(10)


@query("select p_partkey as id, cast(concat('0x', substring(md5(p_name), 1, 8)) as bigint) % 7 as pick from part")
def t8_stable_pick(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), T.stable_pick(F.col("p_name"), F.lit(7)).alias("pick"))


@query("select p_brand, arg_max(p_type, (n, p_type)) as p_type from (select p_brand, p_type, count(*) as n from part group by 1, 2) group by 1")
def t12_most_frequent(spark, sf_dir):
    counts = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    return counts.groupBy("p_brand").agg(F.max_by("p_type", F.struct("n", "p_type")).alias("p_type"))


@query("select item_id, len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), ['the', 'and', 'zebra'])) as n from benchmark")
def u3_set_intersection(spark, sf_dir):
    found = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(F.array_intersect(found, F.array(F.lit("the"), F.lit("and"), F.lit("zebra")))).cast("long").alias("n"))


@query(f"with {KG} select x_name, arg_min(y_name, (y_index, y_name)) as first_name, count(*) as n from edges group by 1")
def u6_first_insertion(spark, sf_dir):
    return kg_edges(spark, sf_dir).groupBy("x_name").agg(F.min_by("y_name", F.struct("y_index", "y_name")).alias("first_name"), F.count("*").alias("n"))


@query(f"with {FILTERED}, k as (select relation from kept union all select relation from ddi) select relation, count(*) as n from k group by 1")
def u1_union_all(spark, sf_dir):
    return G.keep_relations(kg_edges(spark, sf_dir, *G.KEEP_RELATIONS)).select("relation").unionByName(G.shared_target_pairs(shared_only(spark, sf_dir)).select("relation")).groupBy("relation").agg(F.count("*").alias("n"))


@query(r"select doc_id, cast(len(list_filter(string_split_regex(text, '\s+'), lambda w: length(w) > 5 and regexp_matches(w, '^\p{L}+$'))) as int) as n_long from documents")
def f9_x22_long_words(spark, sf_dir):
    long_words = F.filter(F.split("text", r"\s+"), lambda w: (F.length(w) > 5) & F.regexp_like(w, F.lit(r"^\p{L}+$")))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(long_words).alias("n_long"))


@query("select vec_id as id from embeddings where len(list_filter(embedding[1:4], lambda x: x > 0)) > 0")
def f7_x18_any_left(spark, sf_dir):
    return embeddings(spark, sf_dir).where(F.exists(F.slice("vector", 1, 4), lambda x: x > 0)).select("id")


@query(f"with {KG}, p as (select x_name, count(distinct relation) as n from edges where relation in ('indication', 'contraindication', 'disease_disease', 'exposure_disease') group by 1) select x_name, n from p where n >= 2")
def f5_parts_at_least_two(spark, sf_dir):
    return kg_edges(spark, sf_dir, "indication", "contraindication", "disease_disease", "exposure_disease").groupBy("x_name").agg(F.countDistinct("relation").alias("n")).where("n >= 2")


@query(f"with {ITEMS} select item_id, '{{\"opa\":\"' || opa || '\",\"cop\":' || cop || '}}' as extras from items")
def p8_extras(spark, sf_dir):
    return items(spark, sf_dir).select("item_id", F.to_json(F.struct("opa", "cop")).alias("extras"))


@query(f"with {ITEMS} select item_id, {said(ADAPTERS['four'].zero_shot_head)} || concat('Question:', chr(10), question, chr(10), chr(10), 'Options:', chr(10), {OPTIONS}, chr(10), chr(10), 'Answer:') as prompt from items")
def q3_zero_shot(spark, sf_dir):
    return with_options(spark, sf_dir).select("item_id", ADAPTERS["four"].zero_shot().alias("prompt"))


@query(f"with {ITEMS} select item_id, {again(ADAPTERS['four'])} || concat('Question:', chr(10), question, chr(10), chr(10), 'Options:', chr(10), {OPTIONS}, chr(10), chr(10), 'Draft response:', chr(10), output) as prompt from items where item_id % 8 = 5")
def q5_fallback_prompt(spark, sf_dir):
    return with_options(spark, sf_dir).where("item_id % 8 = 5").select("item_id", ADAPTERS["four"].fallback(F.col("output")).alias("prompt"))


@query(f"with {ITEMS} select item_id, 'user' as role, question as content from items union all select item_id, 'assistant', output from items")
def q8_prompt_completion(spark, sf_dir):
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    return items(spark, sf_dir).select("item_id", F.explode(F.array(turn("user", "question"), turn("assistant", "output"))).alias("m")).select("item_id", "m.*")


@query(f"with {ITEMS} select item_id, {explicit('output', '[A-J]')} as pred from items")
def n4_n7_explicit_ten(spark, sf_dir):
    """Forms are tried in their order, wherever they stand."""
    return items(spark, sf_dir).select("item_id", F.upper(parsing.explicit(F.col("output"), "[A-J]")).alias("pred"))


@query(f"with {ITEMS}, y as (select item_id, case item_id % 4 when 0 then 'The answer is maybe.' when 1 then 'Yes' when 2 then 'it could be no' else '' end as s from items) select item_id, lower({explicit('s', 'yes|no|maybe')}) as pred from y")
def n5_yes_no_maybe(spark, sf_dir):
    s = F.element_at(F.array(F.lit("The answer is maybe."), F.lit("Yes"), F.lit("it could be no"), F.lit("")), (F.col("item_id") % 4 + 1).cast("int"))
    return items(spark, sf_dir).select("item_id", parsing.yes_no_maybe(s)["pred"].alias("pred"))


@query(f"with {PARSED} select item_id, pred, replace(parse_source, 'answer_section', 'final_section') as parse_source from parsed")
def n6_unwrapped(spark, sf_dir):
    """The first form of the parser: thoughts are unwrapped before the final section is looked for."""
    rows = items(spark, sf_dir).withColumn("options", F.create_map(*[x for k in "abcd" for x in (F.lit(k.upper()), F.col(f"op{k}"))]))
    return rows.select("item_id", parsing.mcq_unwrapped(F.concat(F.lit("<think>"), F.col("output"), F.lit("</think>")), F.col("options")).alias("p")).select("item_id", "p.*")


@query("select vec_id as id, cast(nth as int) as rank, round(1.0::double / (nth + 11), 9) as score from (select vec_id, row_number() over (partition by label order by vec_id) - 1 as nth from embeddings)")
def r3_rrf(spark, sf_dir):
    """Reciprocal ranks of the vectors in their labels."""
    nth = F.row_number().over(Window.partitionBy("label").orderBy("id")) - 1
    return embeddings(spark, sf_dir).select("id", nth.alias("rank")).withColumn("score", F.round(R.rrf(F.col("rank")), 9))


@query("select item_id as idx, text as question from benchmark order by md5(concat(item_id, '|42')), item_id limit 10")
def r10_eval_set(spark, sf_dir):
    return sampling.sample(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("idx"), F.col("text").alias("question")), "idx", 10)


@query(f"with {HYPER}, t as (select distinct p_brand as term from part union all select 'DISEASE:' || p_partkey from part) select term, arg_max(name, name) as name from t join (select distinct name from ix) on lower(name) = lower(term) group by 1")
def g5_priority_entities(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    terms = p.select(F.col("p_brand").alias("term")).union(p.select(F.concat(F.lit("DISEASE:"), F.col("p_partkey").cast("string"))))
    names = G.entities(G.entity_hedges(hedges(spark, sf_dir))).select("name", F.col("name").alias("ordinal"))
    return matching.exact(terms, names)


@query("select model, round(avg(sim), 6) as mean_sim from (select 'a' as model, embedding[1]::double * embedding[2]::double as sim from embeddings union all select 'b', embedding[2]::double * embedding[3]::double from embeddings) group by 1")
def r9_v9_model_cache(spark, sf_dir):
    """Encoded corpora of two stand-in models, kept as tables and read back."""
    out = None
    for i, model in enumerate("ab"):
        path = work_path(spark, f"model-{model}")
        e = embeddings(spark, sf_dir)
        sinks.vectors(e.select("id", F.slice("vector", i + 1, 2).alias("vector")), path)
        rows = readers.table(spark, path).select(F.lit(model).alias("model"), (F.col("vector")[0].cast("double") * F.col("vector")[1].cast("double")).alias("sim"))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("model").agg(F.round(F.avg("sim"), 6).alias("mean_sim"))
