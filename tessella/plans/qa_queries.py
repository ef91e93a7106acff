"""Queries on question sets: normalised rows, prompts, parsed answers, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import fuzzy, matching, parsing, profile, prompts, sampling

from .fixtures import ITEMS, items, table
from .registry import query

WS = r"' ' || chr(10) || chr(9) || chr(13)"


def with_options(spark, sf_dir):
    return prompts.four_options(items(spark, sf_dir).drop("gold"))


OPTIONS = "concat('A. ', opa, chr(10), 'B. ', opb, chr(10), 'C. ', opc, chr(10), 'D. ', opd)"


@query(f"with {ITEMS} select item_id, question, gold, {OPTIONS} as options from items")
def p1_four_options(spark, sf_dir):
    return with_options(spark, sf_dir).select("item_id", "question", "gold", prompts.option_lines(F.col("options")).alias("options"))


@query(f"with {ITEMS} select item_id, upper(trim(' ' || lower(gold) || ' ')) as gold, 'task' || (item_id % 3) as medical_task from items")
def p2_ten_options(spark, sf_dir):
    rows = items(spark, sf_dir).select("item_id", F.concat(F.lit(" "), F.lower("gold"), F.lit(" ")).alias("label"), F.concat(F.lit("task"), F.col("item_id") % 3).alias("medical_task"))
    return prompts.ten_options(rows).select("item_id", "gold", "medical_task")


@query(f"with {ITEMS} select item_id, concat_ws(chr(10) || chr(10), nullif(trim(opa), ''), nullif(trim(opb), '')) as context_text, case item_id % 3 when 0 then 'yes' when 1 then 'no' else 'maybe' end as gold from items")
def p3_context_questions(spark, sf_dir):
    rows = items(spark, sf_dir).select("item_id", F.array(F.concat(F.lit(" "), "opa"), F.lit("  "), F.concat("opb", F.lit(" "))).alias("contexts"), F.element_at(F.array(F.lit("YES "), F.lit(" No"), F.lit("Maybe")), (F.col("item_id") % 3 + 1).cast("int")).alias("final_decision"))
    return prompts.context_question(rows).select("item_id", "context_text", "gold")


@query(f"with {ITEMS} select item_id, case gold when 'A' then opa when 'B' then opb when 'C' then opc else opd end as answer from items")
def p4_answer_text(spark, sf_dir):
    return with_options(spark, sf_dir).select("item_id", prompts.answer_text(F.col("options"), F.col("gold")).alias("answer"))


@query(f"with {ITEMS} select item_id, coalesce(nullif(opb, 'Brand#11'), opc) as value from items")
def p5_first_of(spark, sf_dir):
    rows = items(spark, sf_dir).withColumn("first", F.nullif("opb", F.lit("Brand#11")))
    return rows.select("item_id", prompts.first_of(rows, ["absent", "first", "opc"]).alias("value"))


@query(f"with {ITEMS} select item_id, 3 as n, opb as b from items")
def p6_options_literal(spark, sf_dir):
    lit = F.concat(F.lit("{'A': '"), "opa", F.lit("', 'B': '"), "opb", F.lit("', 'C': '"), "opc", F.lit("'}"))
    return items(spark, sf_dir).select("item_id", parsing.options_from_literal(lit).alias("o")).select("item_id", F.size("o").alias("n"), F.col("o")["B"].alias("b"))


@query(f"with {ITEMS} select item_id, gold from items")
def p7_pruned(spark, sf_dir):
    return items(spark, sf_dir).select("item_id", "gold")


@query(f"with {ITEMS} select item_id, gold, 'original' as augment_type, 'parts' as dataset_label from items")
def p9_literal_columns(spark, sf_dir):
    return items(spark, sf_dir).select("item_id", "gold", F.lit("original").alias("augment_type"), F.lit("parts").alias("dataset_label"))


@query(f"with {ITEMS} select item_id, concat(question, chr(10), chr(10), 'Options:', chr(10), {OPTIONS}) as prompt from items")
def q1_question_prompt(spark, sf_dir):
    return with_options(spark, sf_dir).select("item_id", prompts.question_with_options(F.col("question"), F.col("options")).alias("prompt"))


CHATML = "concat('<|im_start|>system', chr(10), 'Answer.', '<|im_end|>', chr(10), '<|im_start|>user', chr(10), question, '<|im_end|>', chr(10), '<|im_start|>assistant', chr(10))"


@query(f"with {ITEMS} select item_id, {CHATML} as chat, concat('### User:', chr(10), question, chr(10), chr(10), '### Assistant:', chr(10)) as plain from items")
def q2_q7_chat_text(spark, sf_dir):
    return items(spark, sf_dir).select("item_id", prompts.chatml(prompts.messages("Answer.", F.col("question"))).alias("chat"), prompts.user_assistant(F.col("question")).alias("plain"))


HEAD = "concat('You are answering a medical multiple-choice question.', chr(10), 'Respond in exactly this format:', chr(10), {}, 'Question:', chr(10), question, chr(10), chr(10), 'Options:', chr(10), " + OPTIONS + ", chr(10))"
HEADER = "'## Thinking', chr(10), '<step-by-step reasoning>', chr(10), chr(10), '## Final Response', chr(10), 'The answer is <A/B/C/D>. <brief justification>', chr(10), chr(10)"
TAG = "'<think>', chr(10), '<step-by-step reasoning>', chr(10), '</think>', chr(10), '<answer>', chr(10), 'The answer is <A/B/C/D>. <brief justification>', chr(10), '</answer>', chr(10), chr(10)"


@query(f"with {ITEMS} select item_id, {HEAD.format(HEADER)} as header, {HEAD.format(TAG)} as tag from items")
def q4_answer_prompts(spark, sf_dir):
    return with_options(spark, sf_dir).select("item_id", *[prompts.answer_prompt(F.col("question"), F.col("options"), f).alias(f) for f in ("header", "tag")])


@query(f"with {ITEMS} select item_id, concat('## Thinking', chr(10), opa, chr(10), chr(10), '## Final Response', chr(10), opb) as header, concat('<think>', chr(10), opa, chr(10), '</think>', chr(10), '<answer>', chr(10), opb, chr(10), '</answer>') as tag from items")
def q6_completions(spark, sf_dir):
    return items(spark, sf_dir).select("item_id", *[prompts.completion(F.col("opa"), F.col("opb"), f).alias(f) for f in ("header", "tag")])


@query(rf"with {ITEMS} select item_id, coalesce(case when regexp_matches(upper(trim(output, {WS})), '^[A-D]$') then upper(trim(output, {WS})) end, nullif(regexp_extract(upper(trim(output, {WS})), '\b([A-D])\b', 1), '')) as pred from items")
def n1_first_letter(spark, sf_dir):
    return items(spark, sf_dir).select("item_id", parsing.letter(F.col("output")).alias("pred"))


@query(rf"with {ITEMS} select item_id, nullif(regexp_extract(lower(output), '\b(yes|no|maybe)\b', 1), '') as pred from items")
def n2_yes_no(spark, sf_dir):
    return items(spark, sf_dir).select("item_id", parsing.yes_no(F.col("output")).alias("pred"))


def explicit(x: str, cls: str = "[A-D]") -> str:
    forms = ", ".join(f"nullif(regexp_extract({x}, '(?i){p.format(cls)}', 1), '')" for p in parsing.EXPLICIT)
    return f"upper(coalesce(case when regexp_matches(trim({x}, {WS}), '(?i)^({cls})$') then trim({x}, {WS}) end, {forms}))"


def option_text(x: str) -> str:
    body = rf"trim(regexp_replace(lower({x}), '\s+', ' ', 'g'))"
    at = lambda o: f"case when {body} is not null and trim(lower({o})) <> '' and strpos(reverse({body}), reverse(trim(lower({o})))) > 0 then length({body}) - strpos(reverse({body}), reverse(trim(lower({o})))) - length(trim(lower({o}))) + 2 else 0 end"
    a, b, c, d = (at(o) for o in ("opa", "opb", "opc", "opd"))
    top = f"greatest({a}, {b}, {c}, {d})"
    return f"case when {top} = 0 then null when {a} = {top} then 'A' when {b} = {top} then 'B' when {c} = {top} then 'C' else 'D' end"


PARSED = ITEMS + rf""",
pz as (select *, case when regexp_matches(output, '(?is)##\s*Final Response\s*(.*)$') then trim(regexp_extract(output, '(?is)##\s*Final Response\s*(.*)$', 1), {WS}) end as final,
         trim(replace(replace(output, '<think>', ' '), '</think>', ' '), {WS}) as cleaned from items),
py as (select *, {explicit("final")} as r1, {explicit("cleaned")} as r2, {option_text("nullif(final, '')")} as r3, {option_text("cleaned")} as r4,
         case when len(regexp_extract_all(upper(nullif(final, '')), '\b([A-D])\b', 1)) = 1 then regexp_extract(upper(final), '\b([A-D])\b', 1) end as r5 from pz),
parsed as (select item_id, gold, coalesce(r1, r2, r3, r4, r5) as pred,
  case when r1 is not null then 'answer_section:explicit' when r2 is not null then 'full_text:explicit' when r3 is not null then 'answer_section:option_text'
       when r4 is not null then 'full_text:option_text' when r5 is not null then 'answer_section:single_letter' else 'unparsed' end as parse_source from py)"""


def parsed(spark, sf_dir, form="header", bodies=None):
    rows = with_options(spark, sf_dir)
    if bodies:
        final, cleaned = parsing.scopes(F.col("output"), form)
        rows = rows.withColumns({"_final": bodies(final), "_all": bodies(cleaned)})
    return rows.withColumn("_p", parsing.mcq(F.col("output"), F.col("options"), form, bodies=(F.col("_final"), F.col("_all")) if bodies else None)).select("item_id", "gold", "_p.*")


@query(f"with {PARSED} select item_id, gold, pred, parse_source from parsed")
def n3_parse_header(spark, sf_dir):
    return parsed(spark, sf_dir)


@query()
def n8_parse_tag_nfkc(spark, sf_dir):
    """The tag form, with compatibility composition before option texts are compared."""
    return parsed(spark, sf_dir, "tag", T.nfkc)


@query(rf"""with {ITEMS},
f as (select item_id, output, case when regexp_matches(output, '(?s)<answer>(.*?)</answer>') then trim(regexp_extract(output, '(?s)<answer>(.*?)</answer>', 1), {WS}) end as a from items)
select item_id, nullif(upper(regexp_extract(output, '(?i)<answer>\s*([A-E])\b', 1)), '') as trace, upper(coalesce(nullif(regexp_extract(a, '^\s*([A-Ea-e])[.\):\s]', 1), ''), case when regexp_matches(a, '^[A-Ea-e]$') then a end, nullif(regexp_extract(a, '([A-Ea-e])', 1), ''))) as tag from f""")
def n9_n10_tag_letters(spark, sf_dir):
    return items(spark, sf_dir).select("item_id", parsing.trace_letter(F.col("output")).alias("trace"), parsing.tag_letter(F.col("output")).alias("tag"))


@query(f"""with {PARSED} select p.item_id, coalesce(p.pred, r.pred) as pred, case when p.pred is null and r.pred is not null then 'fallback_extract' else p.parse_source end as parse_source
from parsed p left join (select item_id, gold as pred from items where item_id % 2 = 1) r using (item_id)""")
def n11_fallback_merge(spark, sf_dir):
    again = items(spark, sf_dir).where("item_id % 2 = 1").select("item_id", F.col("gold").alias("again"))
    rows = parsed(spark, sf_dir).join(again, "item_id", "left")
    source = F.when(F.col("pred").isNull() & F.col("again").isNotNull(), "fallback_extract").otherwise(F.col("parse_source"))
    return rows.select("item_id", F.coalesce("pred", "again").alias("pred"), source.alias("parse_source"))


@query(f"with {PARSED} select parse_source, count(*) as n, count(*) filter (where pred = gold) as n_correct, round(avg(case when pred = gold then 1 else 0 end), 6) as accuracy, count(*) filter (where pred is null) as n_invalid from parsed group by 1")
def a13_accuracy(spark, sf_dir):
    return profile.accuracy(parsed(spark, sf_dir), F.col("pred"), F.col("gold"), ["parse_source"])


@query(f"with {PARSED} select case when round(avg(case when pred = gold then 1.0 else 0 end), 6) - 0.25 > 0.02 then 'ready' when round(avg(case when pred = gold then 1.0 else 0 end), 6) - 0.25 > -0.02 then 'marginal' else 'not ready' end as readiness from parsed")
def a26_readiness(spark, sf_dir):
    acc = parsed(spark, sf_dir).agg(F.round(F.avg(F.coalesce((F.col("pred") == F.col("gold")).cast("int"), F.lit(0))), 6).alias("a"))
    return acc.select(profile.readiness(F.col("a"), F.lit(0.25)).alias("readiness"))


@query(f"with {ITEMS} select cast(sum(len(string_split(question, ' '))) as bigint) as words, cast(floor(sum(len(string_split(question, ' '))) * 1.3) as bigint) as tokens, count(distinct lower(opb)) as answers from items")
def a31_corpus_estimate(spark, sf_dir):
    n = F.sum(F.size(F.split("question", " "))).cast("long")
    return items(spark, sf_dir).agg(n.alias("words"), F.floor(n * 1.3).cast("long").alias("tokens"), F.countDistinct(F.lower("opb")).alias("answers"))


@query(f"with {ITEMS} select item_id, gold from items order by md5(concat(item_id, '|42')), item_id limit 50")
def t6_seeded_sample(spark, sf_dir):
    return sampling.sample(items(spark, sf_dir).select("item_id", "gold"), "item_id", 50)


@query(f"with {ITEMS}, r as (select item_id, gold, row_number() over (partition by gold order by md5(concat(item_id, '|42')), item_id) rn from items) select item_id, gold from r where rn <= 20")
def t7_sample_by_group(spark, sf_dir):
    return sampling.sample_by(items(spark, sf_dir).select("item_id", "gold"), ["gold"], "item_id", 20)


BUCKET = "cast(concat('0x', substring(md5(concat(item_id, '|42')), 1, 8)) as bigint) % 1000"


@query(f"with {ITEMS} select item_id, case when {BUCKET} < 100 then 'eval' else 'train' end as split from items")
def t9_train_eval_split(spark, sf_dir):
    return sampling.split(items(spark, sf_dir).select("item_id"), "item_id", 0.1)


@query(f"""with {ITEMS}, r as (select item_id, row_number() over (order by md5(concat(item_id, '|42')), item_id) - 1 as nth, count(*) over () as n from items)
select item_id, case when nth < floor(n * 0.15) then 'no_call' when nth < floor(n * 0.15) + floor(n * 0.35) then 'multihop' else 'auto' end as trace_type from r""")
def t10_assigned_types(spark, sf_dir):
    return sampling.assigned(items(spark, sf_dir).select("item_id"), "item_id", [("no_call", 0.15), ("multihop", 0.35)], "auto")


@query(f"with {ITEMS} select item_id, gold from items where item_id >= 100")
def f8_index_range(spark, sf_dir):
    return items(spark, sf_dir).where("item_id >= 100").select("item_id", "gold")


@query(f"with {ITEMS} select i.item_id from items i where not exists (select 1 from items d where d.item_id = i.item_id and d.item_id % 3 = 0)")
def j9_resume(spark, sf_dir):
    from tessella.operators.traces import resumed

    rows = items(spark, sf_dir).select("item_id")
    return resumed(rows, rows.where("item_id % 3 = 0"), ["item_id"])


@query("select p_partkey as item_id, arg_max(s_name, s_suppkey) as name from part join supplier on lower('SUPPLIER#' || lpad(cast(p_partkey as varchar), 9, '0')) = lower(s_name) group by all")
def j6_exact_terms(spark, sf_dir):
    terms = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.concat(F.lit("SUPPLIER#"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("term"))
    names = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("ordinal"))
    return terms.join(matching.exact(terms, names), "term").select("item_id", "name")


@query()
def j7_fuzzy_terms(spark, sf_dir):
    """Misspelt supplier names against supplier names by the weighted ratio from 85."""
    terms = table(spark, sf_dir, "supplier").select(F.concat(F.substring("s_name", 1, 4), F.lit("x"), F.expr("substring(s_name, 6)")).alias("term"))
    return fuzzy.best_matches(terms, table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name")))


@query("select b.item_id as id, p.p_brand || ' ' || p.p_size as name from (select item_id, 'the brand#2' || item_id % 5 || ' 1' as answer from benchmark) b join part p on contains(lower(p.p_brand || ' ' || p.p_size), lower(b.answer)) or (length(p.p_brand || ' ' || p.p_size) >= 6 and contains(lower(b.answer), lower(p.p_brand || ' ' || p.p_size)))")
def j8_two_way_substring(spark, sf_dir):
    answers = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.concat(F.lit("the brand#2"), F.col("item_id") % 5, F.lit(" 1")).alias("answer"))
    return matching.contained(answers, table(spark, sf_dir, "part").select(F.concat("p_brand", F.lit(" "), "p_size").alias("name")))


@query(r"select event_id, user_id, count(*) over (partition by user_id order by epoch(date_trunc('second', ts)) range between 3600 preceding and current row) as n_recent from events")
def w9_event_rate(spark, sf_dir):
    from tessella.streaming.traces import rate

    return rate(table(spark, sf_dir, "events"), 3600, ["user_id"]).select("event_id", "user_id", "n_recent")
