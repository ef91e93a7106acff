"""Queries over the kinds of question sets: their prompts, parsers and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators.adapters import ADAPTERS, STYLES, predictions, run_summary

from .fixtures import ITEMS, items
from .qa_queries import WS, explicit
from .registry import query

LETTERS = "ABCDEFGHIJ"


def rows_of(spark, sf_dir, kind: str) -> DataFrame:
    """Rows of a kind from the parts, with a first output of each form and a second one."""
    # Parsing is slow for the bytes it reads: a small file, or one with few row groups, would be few tasks.
    i = items(spark, sf_dir).drop("gold").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "item_id")
    k = F.col("item_id")
    said = F.substring(F.lit(LETTERS), (k * 7 % 10 + 1).cast("int"), F.lit(1))
    pick = lambda *forms: F.element_at(F.array(*forms), (k % len(forms) + 1).cast("int"))
    if kind == "ten":
        texts = {"A": "opa", "B": "opb", "C": "opc", "D": "opd"} | {x: F.lit(f"choice {x.lower()} here") for x in "EFGHIJ"}
        options = F.create_map(*[y for x, t in texts.items() for y in (F.lit(x), F.col(t) if isinstance(t, str) else t)])
        body = F.concat(F.lit("It must be choice "), F.lower(said), F.lit(" here and not choice a"))
        output = pick(F.concat(F.lit("<think>a</think>\n## Final Response\nThe answer is "), said, F.lit(". so")), F.concat(F.lit("## Final Response\n"), body), F.concat(F.lit("## Final Response\npick ("), said, F.lit(") now")), F.concat(body, F.lit("\n## Final Response\n")), F.lit("I am not sure"), F.concat(F.lit("Option "), F.lower(said)))
        return i.select(k, "question", options.alias("options"), F.concat(F.lit(" "), F.lower(F.substring(F.lit(LETTERS), (k % 10 + 1).cast("int"), F.lit(1)))).alias("label"), output.alias("output"), F.when(k % 3 == 0, F.concat(F.lit("Final Answer: "), said)).otherwise("none").alias("second"))
    if kind == "abstract":
        word = F.element_at(F.array(F.lit("yes"), F.lit("no"), F.lit("maybe")), (k % 3 + 1).cast("int"))
        output = pick(F.concat(F.lit("## Final Response\nThe answer is "), word, F.lit(".")), F.lit("## Final Response\nprobably no"), F.lit("## Final Response\nyes or no"), F.lit("Answer: maybe"), F.lit("nothing said"))
        contexts = F.array(F.concat(F.lit(" "), "opa"), F.lit("  "), F.concat("opb", F.lit(" ")))
        return i.select(k, "question", contexts.alias("contexts"), F.initcap(F.element_at(F.array(F.lit("yes"), F.lit("no"), F.lit("maybe")), (k % 4 % 3 + 1).cast("int"))).alias("final_decision"), output.alias("output"), F.when(k % 2 == 0, F.concat(F.lit("Final Answer: "), word)).otherwise("none").alias("second"))
    return i.withColumn("second", F.when(k % 3 != 0, F.lit("Final Answer: C")).otherwise("none"))


def over_kinds(spark, sf_dir, make) -> DataFrame:
    return reduce(DataFrame.unionByName, [make(kind, a, a.normalize(rows_of(spark, sf_dir, kind))).select(F.lit(kind).alias("kind"), "*") for kind, a in ADAPTERS.items()])


_SAID = f"substring('{LETTERS}', cast(item_id * 7 % 10 + 1 as int), 1)"
_BODY = f"'It must be choice ' || lower({_SAID}) || ' here and not choice a'"
_WORD = "['yes', 'no', 'maybe'][cast(item_id % 3 + 1 as int)]"
NL = "chr(10)"
KINDS = (
    ITEMS
    + f""",
ten as (select item_id, question, opa, opb, opc, opd, substring('{LETTERS}', cast(item_id % 10 + 1 as int), 1) as gold,
  case item_id % 6 when 0 then '<think>a</think>' || {NL} || '## Final Response' || {NL} || 'The answer is ' || {_SAID} || '. so' when 1 then '## Final Response' || {NL} || {_BODY}
    when 2 then '## Final Response' || {NL} || 'pick (' || {_SAID} || ') now' when 3 then {_BODY} || {NL} || '## Final Response' || {NL} when 4 then 'I am not sure' else 'Option ' || lower({_SAID}) end as output,
  case when item_id % 3 = 0 then 'Final Answer: ' || {_SAID} else 'none' end as second from items),
abstract as (select item_id, question, concat_ws({NL} || {NL}, nullif(trim(opa), ''), nullif(trim(opb), '')) as context_text, ['yes', 'no', 'maybe'][cast(item_id % 4 % 3 + 1 as int)] as gold,
  case item_id % 5 when 0 then '## Final Response' || {NL} || 'The answer is ' || {_WORD} || '.' when 1 then '## Final Response' || {NL} || 'probably no' when 2 then '## Final Response' || {NL} || 'yes or no'
    when 3 then 'Answer: maybe' else 'nothing said' end as output,
  case when item_id % 2 = 0 then 'Final Answer: ' || {_WORD} else 'none' end as second from items),
four as (select *, case when item_id % 3 <> 0 then 'Final Answer: C' else 'none' end as second from items),
asked as (
  select 'four' as kind, item_id, gold, output, second, 'Question:' || {NL} || question || {NL} || {NL} || 'Options:' || {NL} || 'A. ' || opa || {NL} || 'B. ' || opb || {NL} || 'C. ' || opc || {NL} || 'D. ' || opd as body, null as again from four
  union all select 'ten', item_id, gold, output, second, question, 'Question:' || {NL} || question from ten
  union all select 'abstract', item_id, gold, output, second, 'Abstract:' || {NL} || context_text || {NL} || {NL} || 'Question:' || {NL} || question, 'Question:' || {NL} || question from abstract)"""
)


def said(text: str) -> str:
    """A text as SQL."""
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def by_kind(of) -> str:
    return "case kind " + " ".join(f"when '{k}' then {of(a)}" for k, a in ADAPTERS.items()) + " end"


@query(f"with {KINDS} select kind, item_id, {by_kind(lambda a: said(a.zero_shot_head))} || body || chr(10) || chr(10) || 'Answer:' as prompt from asked")
def q3_zero_shot_forms(spark, sf_dir):
    """The three prompts for one letter or word."""
    return over_kinds(spark, sf_dir, lambda kind, a, rows: rows.select("item_id", a.zero_shot().alias("prompt")))


def _form(a, style) -> str:
    from tessella.operators.adapters import FORMAT, HEADER_FORM, TAG_FORM

    return said(a.ask + FORMAT + (TAG_FORM if style.form == "tag" else HEADER_FORM).format(choices=a.choices, thinking=style.thinking, final=style.final))


@query(f"with {KINDS} " + " union all ".join(f"select kind, '{name}' as style, item_id, {by_kind(lambda a, s=s: _form(a, s))} || body || chr(10) as prompt from asked" for name, s in STYLES.items()))
def q4_prompts_by_style(spark, sf_dir):
    """The three prompts for reasoning and an answer, in each style."""
    one = lambda name, style: lambda kind, a, rows: rows.select(F.lit(name).alias("style"), "item_id", a.prompt(style).alias("prompt"))
    return reduce(DataFrame.unionByName, [over_kinds(spark, sf_dir, one(name, style)) for name, style in STYLES.items()])


def again(a) -> str:
    from tessella.operators.adapters import AGAIN_FORMAT

    return said(a.again + AGAIN_FORMAT.format(choices=a.choices))


PARSED = KINDS + rf""",
pz as (select *, case when regexp_matches(output, '(?is)##\s*Final Response\s*(.*)$') then trim(regexp_extract(output, '(?is)##\s*Final Response\s*(.*)$', 1), {WS}) end as final,
         trim(replace(replace(output, '<think>', ' '), '</think>', ' '), {WS}) as cleaned from asked),
opt as (select 'four' as kind, item_id, unnest(['A', 'B', 'C', 'D']) as letter, unnest([opa, opb, opc, opd]) as option from items
  union all select 'ten', item_id, unnest(['A', 'B', 'C', 'D', 'E', 'F', 'G', 'H', 'I', 'J']), unnest([opa, opb, opc, opd, 'choice e here', 'choice f here', 'choice g here', 'choice h here', 'choice i here', 'choice j here']) from items),
pl as (select kind, item_id, letter, lower(trim(option)) as o, trim(regexp_replace(lower(nullif(final, '')), '\s+', ' ', 'g')) as a, trim(regexp_replace(lower(cleaned), '\s+', ' ', 'g')) as b from pz join opt using (kind, item_id)),
pw as (select kind, item_id, letter, case when o <> '' and contains(a, o) then length(a) - strpos(reverse(a), reverse(o)) - length(o) + 2 end as x, case when o <> '' and contains(b, o) then length(b) - strpos(reverse(b), reverse(o)) - length(o) + 2 end as y from pl),
po as (select kind, item_id, arg_max(letter, (x, -ascii(letter))) filter (where x is not null) as r3, arg_max(letter, (y, -ascii(letter))) filter (where y is not null) as r4 from pw group by all),
pr as (select pz.*, r3, r4,
  case kind when 'four' then {explicit("final")} when 'ten' then {explicit("final", "[A-J]")} else lower({explicit("final", "yes|no|maybe")}) end as r1,
  case kind when 'four' then {explicit("cleaned")} when 'ten' then {explicit("cleaned", "[A-J]")} else lower({explicit("cleaned", "yes|no|maybe")}) end as r2,
  case kind when 'four' then regexp_extract_all(upper(nullif(final, '')), '\b([A-D])\b', 1) when 'ten' then regexp_extract_all(upper(nullif(final, '')), '\b([A-J])\b', 1) else regexp_extract_all(lower(nullif(final, '')), '\b(yes|no|maybe)\b', 1) end as alone,
  case kind when 'four' then {explicit("second")} when 'ten' then {explicit("second", "[A-J]")} else lower({explicit("second", "yes|no|maybe")}) end as recovered
  from pz left join po using (kind, item_id)),
parsed as (select *, coalesce(r1, r2, r3, r4, case when len(alone) = 1 then alone[1] end) as first,
  case when r1 is not null then 'answer_section:explicit' when r2 is not null then 'full_text:explicit' when r3 is not null then 'answer_section:option_text' when r4 is not null then 'full_text:option_text'
       when len(alone) = 1 then case when kind = 'abstract' then 'answer_section:single_word' else 'answer_section:single_letter' end else 'unparsed' end as source from pr),
done as (select kind, item_id, gold, output, body, again, first is null as fallback_used, coalesce(first, recovered) as pred, case when first is null and recovered is not null then 'fallback_extract' else source end as parse_source from parsed)"""


def done(spark, sf_dir) -> DataFrame:
    style = STYLES["custom"]
    return reduce(DataFrame.unionByName, [predictions(rows_of(spark, sf_dir, k), a, style, "output", "second").select(F.lit(k).alias("kind"), "item_id", "gold", "pred", "parse_source", "fallback_used", "correct") for k, a in ADAPTERS.items()])


@query(f"with {PARSED} select item_id, gold, first as pred, source as parse_source from parsed where kind = 'ten'")
def n4_ten_options(spark, sf_dir):
    """All rules for ten options: explicit forms, option texts, a letter alone."""
    return predictions(rows_of(spark, sf_dir, "ten"), ADAPTERS["ten"], STYLES["custom"]).select("item_id", "gold", "pred", "parse_source")


@query(f"with {PARSED} select kind, item_id, {by_kind(again)} || coalesce(again, body) || chr(10) || chr(10) || 'Draft response:' || chr(10) || output as prompt from parsed where first is null")
def q5_fallback_forms(spark, sf_dir):
    """The three prompts that ask again, for the outputs that gave nothing."""

    def one(kind, a, rows):
        return rows.where(a.parse(F.col("output"), STYLES["custom"])["pred"].isNull()).select("item_id", a.fallback(F.col("output")).alias("prompt"))

    return over_kinds(spark, sf_dir, one)


@query(f"with {PARSED} select kind, item_id, pred, parse_source, fallback_used, coalesce(pred = gold, false) as correct from done")
def p12_predictions(spark, sf_dir):
    """Every kind through its adapter, with a second try where the first gave nothing."""
    return done(spark, sf_dir).select("kind", "item_id", "pred", "parse_source", "fallback_used", "correct")


@query(f"""with {PARSED} select kind, count(*) as num_samples, count(*) filter (where pred = gold) as correct, round(avg(case when pred = gold then 1 else 0 end), 6) as accuracy, count(*) filter (where pred is null) as invalid_predictions,
count(*) filter (where fallback_used) as fallback_attempts, count(*) filter (where parse_source = 'fallback_extract') as fallback_recovered from done group by 1""")
def n11_run_summary(spark, sf_dir):
    """The counters of a run, by kind."""
    return run_summary(done(spark, sf_dir), ["kind"])


@query(rf"""with {KINDS}, b as (select *, trim(output, {WS}) as s from asked)
select kind, item_id, case kind when 'abstract' then coalesce(case when lower(s) in ('yes', 'no', 'maybe') then lower(s) end, nullif(regexp_extract(lower(s), '\b(yes|no|maybe)\b', 1), ''))
  when 'four' then coalesce(case when regexp_matches(upper(s), '^[A-D]$') then upper(s) end, nullif(regexp_extract(upper(s), '\b([A-D])\b', 1), ''))
  else coalesce(case when regexp_matches(upper(s), '^[A-J]$') then upper(s) end, nullif(regexp_extract(upper(s), '\b([A-J])\b', 1), '')) end as pred from b""")
def n1_n2_bare_answers(spark, sf_dir):
    """The letter or word alone, as the prompts without reasoning ask for it."""
    return over_kinds(spark, sf_dir, lambda kind, a, rows: rows.select("item_id", a.bare(F.col("output")).alias("pred")))


@query(f"with {KINDS} select kind, item_id, trim(regexp_replace(replace(replace(replace(o, '<|im_start|>', ''), '<|im_end|>', ''), '<|endoftext|>', ''), '(?s)<tool_call>.*?</tool_call>', '', 'g'), {WS}) as text from (select *, '<|im_start|>' || output || '<|im_end|><tool_call>' || chr(10) || '{{x}}</tool_call> <|endoftext|>' as o from asked)")
def x11_without_marks(spark, sf_dir):
    """Outputs without control marks and tool calls."""

    def one(kind, a, rows):
        o = F.concat(F.lit("<|im_start|>"), "output", F.lit("<|im_end|><tool_call>\n{x}</tool_call> <|endoftext|>"))
        return rows.select("item_id", T.without_tool_calls(T.without_control(o)).alias("text"))

    return over_kinds(spark, sf_dir, one)
