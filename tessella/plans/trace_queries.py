"""Queries on traces, rewards, token masks, length profiles and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import profile, rewards, traces

from .fixtures import EXPECTED, ITEMS, TRACES, expected_letter, items, table, trace_messages
from .registry import query

WC = r"len(list_filter(string_split_regex({}, '\s+'), lambda w: w <> ''))"

SUMMED = TRACES + f""",
su as (select conv_id, coalesce(string_agg(case when role = 'assistant' then coalesce(content, '') end, ' ' order by seq), '') as assistant_text, count(tool_query) as n_calls, count(*) filter (where role = 'tool') as n_responses,
   bool_and({WC.format('tool_query')} between 2 and 25) filter (where tool_query is not null) as calls_ok,
   coalesce(string_agg(case when role = 'tool' then coalesce(content, '') end, ' ' order by seq), '') as tool_text, count(*) as n_messages, cast(sum(length(coalesce(content, ''))) as bigint) as n_chars
   from traces group by conv_id),
gp as (select *, nullif(upper(regexp_extract(assistant_text, '(?i)<answer>\\s*([A-E])\\b', 1)), '') as predicted, {EXPECTED} as expected, regexp_extract_all(assistant_text, '(?s)<think>(.*?)</think>', 1) as thoughts,
   list_filter(string_split_regex(lower(tool_text), '\\s+'), lambda w: length(w) > 5 and regexp_matches(w, '^\\p{{L}}+$'))[1:20] as long_words from su),
ga as (select *, case when len(thoughts) = 0 then 'missing_think' when predicted is null then 'missing_answer' when predicted <> expected then 'wrong_answer:' || predicted || '≠' || expected
   when not coalesce(calls_ok, true) then 'invalid_tool_call_json' when n_calls <> n_responses then 'call_response_mismatch:' || n_calls || 'calls/' || n_responses || 'resps'
   when n_calls > 0 and len(thoughts) >= 2 and n_responses > 0 and len(long_words) > 0 and len(list_filter(long_words, lambda w: contains(lower(thoughts[len(thoughts)]), w))) = 0 then 'no_retrieval_integration' else 'ok' end as reason from gp)""".replace("\\\\", "\\")


def gated(spark, sf_dir, **kw):
    return traces.gates(traces.summarized(trace_messages(spark, sf_dir)), expected_letter(), **kw)


@query(f"with {SUMMED} select conv_id, predicted, reason from ga")
def c1_gates(spark, sf_dir):
    return gated(spark, sf_dir).select("conv_id", "predicted", "reason")


@query(f"with {SUMMED} select conv_id, case when reason like 'call_response_mismatch%' then 'call_response_mismatch:' || n_calls || '/' || n_responses else reason end as reason from ga")
def c2_gates_again(spark, sf_dir):
    return gated(spark, sf_dir, skip_empty=True, mismatch="ratio").select("conv_id", "reason")


@query(f"with {SUMMED} select split_part(reason, ':', 1) as reason, count(*) as n from ga group by 1")
def a6_gate_failures(spark, sf_dir):
    return gated(spark, sf_dir).groupBy(F.split_part("reason", F.lit(":"), F.lit(1)).alias("reason")).agg(F.count("*").alias("n"))


@query(f"with {SUMMED} select round(avg(cast(len(thoughts) > 0 as int)), 6) as think_rate, round(avg(cast(predicted is not null as int)), 6) as answer_rate, round(avg(cast(n_calls = n_responses as int)), 6) as matched_rate, round(avg(n_messages), 6) as mean_turns, round(avg(n_chars), 6) as mean_chars from ga")
def a27_format_checks(spark, sf_dir):
    rate = lambda c: F.round(F.avg(c.cast("int")), 6)
    return gated(spark, sf_dir).agg(rate(F.size(T.tags(F.col("assistant_text"), "think")) > 0).alias("think_rate"), rate(F.col("predicted").isNotNull()).alias("answer_rate"), rate(F.col("n_calls") == F.col("n_responses")).alias("matched_rate"), F.round(F.avg("n_messages"), 6).alias("mean_turns"), F.round(F.avg("n_chars"), 6).alias("mean_chars"))


@query(f"""with {SUMMED} select round(avg(case when n_calls > 0 then cast(predicted = expected as int) end), 4) as acc_tool, round(avg(case when n_calls = 0 then cast(predicted = expected as int) end), 4) as acc_none,
round(avg(cast(n_calls > 0 as int)), 4) as tool_rate, round(avg(n_calls), 3) as mean_calls, round(avg(cast(n_calls >= 2 as int)), 4) as multi_rate from (select * replace (coalesce(predicted, '') as predicted) from ga)""")
def a14_conditional_accuracy(spark, sf_dir):
    right = (F.coalesce("predicted", F.lit("")) == expected_letter()).cast("int")
    n = F.col("n_calls")
    return gated(spark, sf_dir).agg(F.round(F.avg(F.when(n > 0, right)), 4).alias("acc_tool"), F.round(F.avg(F.when(n == 0, right)), 4).alias("acc_none"), F.round(F.avg((n > 0).cast("int")), 4).alias("tool_rate"), F.round(F.avg("n_calls"), 3).alias("mean_calls"), F.round(F.avg((n >= 2).cast("int")), 4).alias("multi_rate"))


@query(f"""with {SUMMED}, h as (select conv_id % 3 as part, n_calls, cast(coalesce(predicted, '') = expected as int) as hit, {WC.format('assistant_text')} as words from ga),
r as (select part, count(*) as n, count(*) filter (where n_calls > 0) as n_with, round(coalesce(avg(hit) filter (where n_calls > 0), 0.0), 6) as acc_with, round(coalesce(avg(hit) filter (where n_calls = 0), 0.0), 6) as acc_without, round(avg(words), 6) as mean_words from h group by 1)
select *, case when n_with = 0 or n_with = n then 'cannot assess' when acc_with - acc_without > 0.02 then 'ready' when acc_with - acc_without > -0.02 then 'marginal' else 'not ready' end as verdict from r""")
def a14b_tool_report(spark, sf_dir):
    g = gated(spark, sf_dir).withColumn("part", F.col("conv_id") % 3)
    return profile.tool_report(g, F.col("predicted") == expected_letter(), F.col("n_calls"), T.word_count(F.col("assistant_text")), ["part"])


@query(f"""with {TRACES} select conv_id, seq, role, case when role = 'assistant' and tool_query is not null and trim(coalesce(content, '')) = '' then concat('<think>', chr(10), 'I need to look up information about ', tool_query, '.', chr(10), '</think>') else coalesce(content, '') end as content,
 case when tool_query is not null then '{{"id":"call_0","type":"function","function":{{"name":"search","arguments":"{{\\"query\\":\\"' || tool_query || '\\"}}"}}}}' end as tool_call from traces""".replace("\\\\", "\\"))
def c3_cleaned_messages(spark, sf_dir):
    return traces.cleaned(trace_messages(spark, sf_dir)).select("conv_id", "seq", "role", "content", "tool_call")


@query(f"""with {TRACES}, m as (select *, sum(case when tool_query is not null then 1 else 0 end) over (partition by conv_id order by seq) k, lead(role) over (partition by conv_id order by seq) nr, row_number() over (partition by conv_id order by seq) nth from traces),
n as (select *, max(k) over (partition by conv_id) nc, max(nth) over (partition by conv_id) n from m), l as (select *, max(case when nth = n then role end) over (partition by conv_id) lr from n),
c as (select conv_id, k as split, nc, nth + 1 as upto from l where nc >= 2 and lr = 'assistant' and tool_query is not null and nr = 'tool' and k < nc)
select l.conv_id, cast(c.split as bigint) as split, 'split_' || cast(c.split as bigint) || 'of' || cast(c.nc as bigint) as augment_type, l.seq, l.role, l.content, l.tool_query from l join c using (conv_id) where l.nth <= c.upto or l.nth = l.n""")
def c4_prefix_splits(spark, sf_dir):
    return traces.prefix_splits(trace_messages(spark, sf_dir))


@query(f"""with {TRACES}, t as (select conv_id, arg_max(content, seq) as content, max(seq) as seq from traces where role = 'assistant' and regexp_matches(content, '(?s)<answer>.*?</answer>') group by 1),
i as (select *, regexp_extract(content, '(?s)<answer>(.*?)</answer>', 1) as a from t)
select conv_id, seq, replace(content, '<answer>' || a || '</answer>', '<answer>' || trim(a) || '. text ' || conv_id || '</answer>') as content from i where conv_id % 2 = 0""")
def c5_verbose_answers(spark, sf_dir):
    answers = table(spark, sf_dir, "conversations").where("conv_id % 2 = 0").select("conv_id").distinct().withColumn("answer_text", F.concat(F.lit("text "), F.col("conv_id").cast("string")))
    return traces.verbose_answers(trace_messages(spark, sf_dir), answers)


@query(f"""with {SUMMED}, no as (select conv_id, row_number() over (order by md5(conv_id || '|42'), conv_id) rn from su where n_calls = 0)
select conv_id, 'original' as augment_type from su where n_calls >= 1 union all select conv_id, 'no_tool' from no where rn <= 20""")
def c6_training_set(spark, sf_dir):
    from tessella.operators.sampling import sample

    s = traces.summarized(trace_messages(spark, sf_dir)).select("conv_id", "n_calls")
    with_calls = s.where("n_calls >= 1").select("conv_id", F.lit("original").alias("augment_type"))
    return with_calls.unionByName(sample(s.where("n_calls = 0"), "conv_id", 20).select("conv_id", F.lit("no_tool").alias("augment_type")))


@query(f"with {SUMMED} select conv_id, n_calls from su where n_calls >= 1")
def f6_tool_traces(spark, sf_dir):
    return traces.summarized(trace_messages(spark, sf_dir)).where("n_calls >= 1").select("conv_id", "n_calls")


@query(f"with {TRACES} select conv_id, seq, coalesce(max(cast(role = 'tool' as int)) over (partition by conv_id order by seq rows between unbounded preceding and 1 preceding), 0) as after_tool, cast(sum(cast(tool_query is not null as int)) over (partition by conv_id order by seq) as bigint) as call_no from traces")
def w5_w7_tool_flags(spark, sf_dir):
    return traces.tool_flags(trace_messages(spark, sf_dir)).select("conv_id", "seq", "after_tool", "call_no")


@query(f"with {TRACES} select conv_id, arg_max(content, seq) as content from traces where role = 'assistant' and coalesce(content, '') <> '' group by 1")
def w6_last_assistant(spark, sf_dir):
    return trace_messages(spark, sf_dir).where("role = 'assistant' and coalesce(content, '') <> ''").groupBy("conv_id").agg(F.max_by("content", "seq").alias("content"))


def answer_sql(p: str, gold: str, letter: str) -> str:
    """The answer reward as SQL."""
    words = lambda x: f"list_filter(string_split_regex(lower({x}), '\\s+'), lambda w: w <> '')"
    x, y = words(p), words(gold)
    common = f"coalesce(list_sum(list_transform(list_distinct({x}), lambda t: least(len(list_filter({x}, lambda w: w = t)), len(list_filter({y}, lambda w: w = t))))), 0)"
    return f"""case when coalesce({p}, '') = '' then 0.0 when lower({p}) = lower({gold}) then 1.0 when coalesce({letter}, '') <> '' and (upper(regexp_extract({p}, '^\\s*([A-Ea-e])[.\\):\\s]', 1)) = {letter} or upper({p}) = {letter}) then 1.0
 when coalesce({letter}, '') <> '' and upper(regexp_extract({p}, '{rewards.FINAL_LETTER}', 1)) = {letter} then 0.8 when contains(lower({p}), lower({gold})) then 0.5 else 2.0 * {common} / (len({x}) + len({y})) end"""


STRIP = "' ' || chr(10) || chr(9) || chr(13)"

REWARD = SUMMED + rf""",
la as (select conv_id, trim(arg_max(content, seq), {STRIP}) as last from traces where role = 'assistant' and coalesce(content, '') <> '' group by 1),
tt as (select ga.*, case when regexp_matches(assistant_text, '(?s)<answer>(.*?)</answer>') then trim(regexp_extract(assistant_text, '(?s)<answer>(.*?)</answer>', 1), {STRIP}) end as ans, last from ga left join la using (conv_id)),
pd as (select *, coalesce(ans, last) as said, 'option ' || expected as gold from tt),
rr as (select *, (case when len(thoughts) > 0 then 0.25 else 0 end) + (case when ans is null then 0 when len(list_filter(string_split_regex(ans, '\s+'), lambda w: w <> '')) <= 10 then 0.75 else 0.5 end) as structure,
  case when n_calls > 0 and n_responses > 0 then 0.25 else 0 end as tool_part, case when n_calls = 0 then -0.3 when n_calls <= 2 then 0.4 else 0.0 end as frequency,
  {answer_sql("said", "gold", "expected")} as correct from pd)"""


def rewarded(spark, sf_dir):
    said = trace_messages(spark, sf_dir).where("role = 'assistant' and content <> ''").groupBy("conv_id").agg(F.trim(F.max_by("content", "seq"), F.lit(" \n\t\r")).alias("last"))
    g = gated(spark, sf_dir).join(said, "conv_id", "left").withColumn("expected", expected_letter())
    ans = rewards.prediction(F.col("assistant_text"), F.col("last"))
    return g.withColumns({"structure": rewards.structure(F.col("assistant_text")), "form": rewards.form(F.col("assistant_text"), F.col("n_calls"), F.col("n_responses")), "frequency": rewards.tool_frequency(F.col("n_calls")), "correct": rewards.answer(ans, F.concat(F.lit("option "), "expected"), F.col("expected"))})


@query(f"with {REWARD} select conv_id, cast(structure as double) as structure, cast(structure + tool_part as double) as form, cast(frequency as double) as frequency, cast(correct as double) as correct from rr")
def y1_y4_rewards(spark, sf_dir):
    return rewarded(spark, sf_dir).select("conv_id", "structure", "form", "frequency", "correct")


@query(rf"""with {ITEMS}, a as (select *, case when regexp_matches(output, '(?s)<answer>(.*?)</answer>') then trim(regexp_extract(output, '(?s)<answer>(.*?)</answer>', 1), {STRIP}) else trim(output, {STRIP}) end as told,
  case gold when 'A' then opa when 'B' then opb when 'C' then opc else opd end as answer from items) select item_id, round(cast({answer_sql("told", "answer", "gold")} as double), 6) as reward from a""")
def y3_answer_branches(spark, sf_dir):
    """Answers of all forms: in a tag or not, as a letter, in a sentence, as the option's text, near it."""
    i = items(spark, sf_dir)
    gold = F.element_at(F.array("opa", "opb", "opc", "opd"), (F.col("item_id") % 4 + 1).cast("int"))
    said = rewards.prediction(F.col("output"), F.trim("output", F.lit(" \n\t\r")))
    return i.select("item_id", F.round(rewards.answer(said, gold, F.col("gold")), 6).alias("reward"))


@query(f"with {REWARD} " + " union all ".join(f"select conv_id, '{name}' as way, round(cast({a} * (structure + tool_part) + {b} * correct + {c} * frequency as double), 6) as total from rr" for name, (a, b, c) in rewards.WEIGHTS.items()))
def y8_weightings(spark, sf_dir):
    """Each trace's total under each weighting."""
    parts = [F.col(c) for c in ("form", "correct", "frequency")]
    totals = F.array(*[F.struct(F.lit(name).alias("way"), F.round(rewards.weighted(parts, w), 6).alias("total")) for name, w in rewards.WEIGHTS.items()])
    return rewarded(spark, sf_dir).select("conv_id", F.explode(totals).alias("t")).select("conv_id", "t.*")


@query(f"""with {REWARD}, w as (select conv_id, conv_id % 10 as prompt, cast(0.25 * (structure + tool_part) + 0.5 * correct + 0.25 * frequency as double) as total from rr)
select conv_id, round(total, 6) as total, round(coalesce((total - avg(total) over (partition by prompt)) / nullif(round(stddev_samp(total) over (partition by prompt), 9), 0), 0), 6) as advantage from w""")
def a32_weighted_and_normalized(spark, sf_dir):
    from pyspark.sql import Window

    r = rewarded(spark, sf_dir).withColumn("total", rewards.weighted([F.col("form"), F.col("correct"), F.col("frequency")], [0.25, 0.50, 0.25]))
    w = Window.partitionBy(F.col("conv_id") % 10)
    sd = F.nullif(F.round(F.stddev_samp("total").over(w), 9), F.lit(0.0))
    return r.select("conv_id", F.round("total", 6).alias("total"), F.round(F.coalesce((F.col("total") - F.avg("total").over(w)) / sd, F.lit(0.0)), 6).alias("advantage"))


@query("""with s as (select vec_id as id, vec_id % 5 as n_calls, (embedding[1]::double + 1) / 2 + 0.3 as q, (embedding[2]::double + 1) / 2 + 0.2 as r, vec_id % 2 = 0 as g from embeddings),
d as (select *, case when q > 0.8 then 0.8 + (q - 0.8) * 0.3 else q end as qd from s)
select id, round(case when n_calls = 0 then -0.3 else (case when n_calls <= 2 then 0.1 else 0.05 end) + least(0.1, greatest(0.0, (qd - 0.5) * 0.2)) + least(0.15, greatest(0.0, (r - 0.55) * 0.33)) + (case when g then 0.05 else 0 end) end, 6) as reward,
round(case when n_calls = 0 then -0.4 else (case when n_calls <= 2 then 0.1 else 0.05 end) + least(0.1, greatest(0.0, (qd - 0.5) * 0.2)) + least(0.15, greatest(0.0, (r - 0.55) * 0.33)) + (case when g then 0.05 else 0 end) end, 6) as strict from d""")
def y5_y6_tool_quality(spark, sf_dir):
    half = lambda i: (F.col("embedding")[i].cast("double") + 1) / 2
    e = table(spark, sf_dir, "embeddings")
    n, q, r, g = F.col("vec_id") % 5, half(0) + 0.3, half(1) + 0.2, F.col("vec_id") % 2 == 0
    return e.select(F.col("vec_id").alias("id"), F.round(rewards.tool_quality(n, q, r, g), 6).alias("reward"), F.round(rewards.tool_quality(n, q, r, g, -0.40), 6).alias("strict"))


@query(f"""with {ITEMS} select item_id, regexp_replace(question, '["\\\\]', '', 'g') as query from items""")
def y7_tool_queries(spark, sf_dir):
    """Queries of raw tool_call tags, each once, in the order of first places; bad JSON is left out."""
    said = F.concat(F.lit('<tool_call>{"name":"search","arguments":{"query":"'), F.regexp_replace("question", '["\\\\]', ""), F.lit('"}}</tool_call><tool_call>{bad}</tool_call>'))
    calls = F.regexp_extract_all(said, F.lit(r"(?s)<tool_call>\s*(\{.*?\})\s*</tool_call>"), F.lit(1))
    read = F.transform(calls, lambda c: F.get_json_object(c, "$.arguments.query"))
    return items(spark, sf_dir).select("item_id", F.explode(F.array_distinct(F.filter(read, lambda q: q.isNotNull()))).alias("query"))


LENGTHS = r"len as (select lang, doc_id, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) as n, len(regexp_extract_all(lower(text), '[a-z0-9]+')) as t from documents)"


def lengths(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("lang", "doc_id", T.word_count(F.col("text")).cast("long").alias("n"), F.size(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).cast("long").alias("t"))


@query(f"with {LENGTHS} select lang, doc_id, n, t from len")
def c15_token_counts(spark, sf_dir):
    return lengths(spark, sf_dir)


PCT = ", ".join(f"round(quantile_cont(t, {p / 100}), 6) as p{p}" for p in profile.PERCENTS)


@query(f"with {LENGTHS}, s as (select lang, count(t) as n, round(avg(t), 6) as mean, round(stddev_pop(t), 6) as std, cast(min(t) as double) as min, cast(max(t) as double) as max, {PCT} from len group by 1) select *, round(p75 - p25, 6) as iqr, round(p95 - p5, 6) as spread from s")
def a10_length_summary(spark, sf_dir):
    return profile.summary(lengths(spark, sf_dir), "t", ["lang"])


@query(f"with {LENGTHS} select lang, threshold, round(avg(cast(t <= threshold as int)), 6) as share_at_most, round(avg(cast(t > threshold as int)), 6) as share_over from len, (select unnest([512, 1024, 2048, 4096, 8192]) as threshold) group by 1, 2")
def a11_threshold_shares(spark, sf_dir):
    return profile.threshold_shares(lengths(spark, sf_dir), "t", ["lang"])


@query(f"with {LENGTHS}, u as (select lang, 'n' as metric, n as v from len union all select lang, 't', t from len), m as (select metric, avg(v) filter (where lang = 'en') as en, avg(v) filter (where lang = 'de') as de, count(*) filter (where lang = 'en') as n_en, count(*) filter (where lang = 'de') as n_de from u group by 1) select metric, round(en - de, 6) as delta, round(n_en / n_de, 6) as ratio from m")
def a12_two_sets(spark, sf_dir):
    u = lengths(spark, sf_dir).unpivot(["lang", "doc_id"], ["n", "t"], "metric", "v")
    m = u.groupBy("metric").pivot("lang", ["en", "de"]).agg(F.avg("v").alias("mean"), F.count("v").alias("n"))
    return m.select("metric", F.round(F.col("en_mean") - F.col("de_mean"), 6).alias("delta"), F.round(F.col("en_n") / F.col("de_n"), 6).alias("ratio"))


@query(f"with {LENGTHS}, c as (select lang, t, count(*) as n from len group by 1, 2) select lang, t, round(sum(n) over (partition by lang order by t) / sum(n) over (partition by lang), 9) as share from c")
def a15_ecdf(spark, sf_dir):
    return profile.ecdf(lengths(spark, sf_dir), "t", ["lang"])


@query(f"with {LENGTHS}, e as (select min(t)::double lo, max(t)::double hi from len), b as (select cast(least(floor((t - lo) / ((hi - lo) / 80)), 79) as int) as bin, any_value((hi - lo) / 80) as w, count(*) as n from len, e group by 1) select bin, n, round(n / (sum(n) over () * w), 9) as density from b")
def a16_histogram(spark, sf_dir):
    return profile.histogram(lengths(spark, sf_dir), "t")


@query(f"with {LENGTHS}, q as (select lang, quantile_cont(t, 0.25) q1, quantile_cont(t, 0.5) median, quantile_cont(t, 0.75) q3 from len group by 1) select lang, q1, median, q3, cast(min(t) as double) as low, cast(max(t) as double) as high from len join q using (lang) where t between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) group by all")
def a17_box(spark, sf_dir):
    return profile.box(lengths(spark, sf_dir), "t", ["lang"])


@query(f"with {LENGTHS} select lang, round((sum(t) * 0.15 + sum(n) * 0.075 + count(*) * 0.6) / 1000000.0, 9) as cost from len group by 1")
def a30_cost(spark, sf_dir):
    return lengths(spark, sf_dir).groupBy("lang").agg(F.round(profile.cost(F.sum("t"), F.sum("n"), F.count("*"), (0.15, 0.075, 0.60)), 9).alias("cost"))


def token_rows(spark, sf_dir):
    """Small id sequences: 1 opens an assistant turn, 2 closes it."""
    ids = F.transform(F.sequence(F.lit(0), (F.col("doc_id") % 30 + 5).cast("int")), lambda i: ((F.col("doc_id") * 7 + i * 11) % 9).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", ids.alias("ids"))


IDS = "ti as (select doc_id, list_transform(range(0, cast(doc_id % 30 + 6 as bigint)), lambda i: cast((doc_id * 7 + i * 11) % 9 as int)) as ids from documents)"


@query(f"""with {IDS}, o as (select doc_id, ids, unnest(range(1, len(ids) + 1)) as pos from ti), s as (select doc_id, pos, coalesce(list_min(list_filter(range(pos + 1, len(ids) + 1), lambda j: ids[j] = 2)), len(ids)) as stop from o where ids[pos] = 1)
select doc_id, coalesce(string_agg(pos || ':' || stop, ',' order by pos), '') as spans from ti left join s using (doc_id) group by 1""")
def c12_assistant_spans(spark, sf_dir):
    s = token_rows(spark, sf_dir).withColumn("s", traces.assistant_spans(F.col("ids"), [1], 2))
    return s.select("doc_id", F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["start"], x["end"])), ",").alias("spans"))




@query(f"with {IDS}, l as (select doc_id, list_transform(ids, lambda x, i: case when i - 1 >= 3 and i - 1 < 9 then x else -100 end)[greatest(len(ids) - 19, 1):] as labels, ids from ti) select doc_id, array_to_string(labels, ',') as labels, cast(len(list_filter(labels, lambda x: x <> -100)) as int) as n_trained, array_to_string(list_concat(labels, list_transform(range(greatest(24 - len(labels), 0)), lambda i: -100)), ',') as padded from l")
def c13_c14_masked_labels(spark, sf_dir):
    span = F.array(F.struct(F.lit(3).alias("start"), F.lit(9).alias("end")))
    r = token_rows(spark, sf_dir).withColumn("l", traces.masked_labels(F.col("ids"), span, 20))
    return r.select("doc_id", F.array_join("l", ",").alias("labels"), traces.trainable(F.col("l")).alias("n_trained"), F.array_join(traces.padded(F.col("l"), F.lit(24), -100), ",").alias("padded"))


@query(f"with {IDS}, l as (select doc_id, list_transform(ids, lambda x, i: case when i - 1 >= 3 and i - 1 < 9 then x else -100 end)[greatest(len(ids) - 19, 1):] as labels from ti) select doc_id, cast(len(labels) as int) as n, cast(len(list_filter(labels, lambda x: x <> -100)) as int) as n_trained from l where len(list_filter(labels, lambda x: x <> -100)) > 0")
def f7_trainable_rows(spark, sf_dir):
    """Rows that have a label left after the mask; of long ones the span is cut away, and they go."""
    span = F.array(F.struct(F.lit(3).alias("start"), F.lit(9).alias("end")))
    r = token_rows(spark, sf_dir).withColumn("l", traces.masked_labels(F.col("ids"), span, 20))
    return r.where(traces.trainable(F.col("l")) > 0).select("doc_id", F.size("l").alias("n"), traces.trainable(F.col("l")).alias("n_trained"))


@query(f"with {IDS}, l as (select ids, list_transform(ids, lambda x: case when x < 4 then -100 else x end) as labels from ti), t as (select cast(sum(len(ids)) as bigint) as tokens, cast(sum(len(list_filter(labels, lambda x: x <> -100))) as bigint) as trained from l) select tokens, trained, round(trained / tokens, 6) as share from t")
def a28_token_totals(spark, sf_dir):
    r = token_rows(spark, sf_dir).withColumn("l", F.transform("ids", lambda x: F.when(x < 4, -100).otherwise(x)))
    return r.agg(F.sum(F.size("ids")).alias("tokens"), F.sum(traces.trainable(F.col("l"))).alias("trained")).withColumn("share", F.round(F.col("trained") / F.col("tokens"), 6))


@query(f"with {IDS}, p as (select unnest(ids[2:]) as l, unnest(list_transform(ids[1:len(ids)-1], lambda x: (x * 2) % 9)) as p from ti) select round(sum(case when p = l then 1 else 0 end) / count(*), 6) as accuracy from p where l >= 4")
def a29_token_accuracy(spark, sf_dir):
    r = token_rows(spark, sf_dir)
    hits, n = profile.token_accuracy(F.transform("ids", lambda x: (x * 2) % 9), F.transform("ids", lambda x: F.when(x < 4, -100).otherwise(x)))
    return r.agg(F.round(F.sum(hits) / F.sum(n), 6).alias("accuracy"))


@query("select p_partkey as id, case when p_size % 4 + 1 = 1 then p_brand when p_size % 4 + 1 = 2 then p_brand || ' and ' || p_type else array_to_string(list_transform(range(p_size % 4), lambda i: p_brand), ', ') || ', and ' || p_type end as said from part")
def x4_english_list(spark, sf_dir):
    names = F.when(F.col("p_size") % 4 == 0, F.array("p_brand")).otherwise(F.concat(F.array_repeat(F.col("p_brand"), (F.col("p_size") % 4).cast("int")), F.array("p_type")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), T.english_list(names).alias("said"))


@query(r"select doc_id, array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(text, '\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b'), regexp_extract_all(text, '\b[A-Z]{2,}\b')))), '|') as phrases from documents where regexp_matches(text, '^[\x00-\x7F]*$')")
def x7_title_phrases(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.regexp_like("text", F.lit(r"^[\x00-\x7F]*$"))).select("doc_id", F.array_join(F.array_sort(T.title_phrases(F.col("text"))), "|").alias("phrases"))


@query("select p_partkey as id, case when strpos(reverse(p_name), 'e') > 0 then length(p_name) - strpos(reverse(p_name), 'e') + 1 else 0 end as at, printf('%06d', p_partkey) as label, greatest(least(p_retailprice, 1500.0), 1000.0) as clipped from part")
def x15_x16_x19_scalars(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), T.last_position(F.col("p_name"), F.lit("e")).alias("at"), F.format_string("%06d", "p_partkey").alias("label"), F.greatest(F.least("p_retailprice", F.lit(1500.0)), F.lit(1000.0)).alias("clipped"))


STOP2 = "[" + ", ".join(f"'{w}'" for w in T.STOP_EVALUATION) + "]"


def toks(x: str) -> str:
    return f"list_filter(list_distinct(regexp_extract_all(lower({x}), '[a-z0-9]+')), lambda w: not list_contains({STOP2}, w))"


@query(f"select p_partkey as id, case when len({toks('p_name')}) = 0 then 0.0 else round(len(list_intersect({toks('p_name')}, {toks('p_type || p_name')})) / len({toks('p_name')}), 6) end as share from part")
def x20_copied_share(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.round(T.copied_share(F.col("p_name"), F.concat("p_type", "p_name")), 6).alias("share"))


@query(r"""with w as (select p_partkey as id, list_filter(string_split_regex(lower(p_name), '\s+'), lambda x: x <> '') as a, list_filter(string_split_regex(lower(p_type || ' ' || p_name), '\s+'), lambda x: x <> '') as b from part),
c as (select *, coalesce(list_sum(list_transform(list_distinct(a), lambda t: least(len(list_filter(a, lambda x: x = t)), len(list_filter(b, lambda x: x = t))))), 0) as common from w)
select id, round(case when common = 0 then 0.0 else 2.0 * common / (len(a) + len(b)) end, 6) as f1 from c""")
def x21_token_f1(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.round(T.token_f1(F.col("p_name"), F.concat("p_type", F.lit(" "), "p_name")), 6).alias("f1"))
