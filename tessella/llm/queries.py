"""The queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chaining, chat, infill, lines, packing, phrases, pieces, pii, quality, repeats, simhash, tiff, toxicity
from .common import read

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"))


def op2_preference_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations against versions whose last answer only repeats what came before it."""
    turns = read(spark, sf_dir, "conversations")
    return chat.preference_pairs(turns, chat.parroted(turns)).withColumnRenamed("pair_id", "conv_id")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every chunk of every text, and a digest of what they decode to."""
    path = vocabulary_path("piece_bpe_32k.model")
    coded = pieces.decode(pieces.encode(read(spark, sf_dir, "documents"), path), path)
    return coded.select("doc_id", "chunk", "n_chunks", F.size("ids").cast("long").alias("n_ids"), "ids", F.sha2("text", 256).alias("decoded_sha256"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document that shares a passage: its class, its links and its longest passage."""
    return chaining.passage_classes(chaining.shared_passages(read(spark, sf_dir, "documents")))


def op5_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.media_digest(read(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_dedup(read(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read(spark, sf_dir, "documents")).drop("text_hash")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read(spark, sf_dir, "documents")).drop("lang", "source", "distance")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.fill_in_middle(read(spark, sf_dir, "documents")).drop("output")


def op12_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(read(spark, sf_dir, "documents")).drop("kept")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_packing, op2_preference_chat, op3_sentencepiece, op4_substring_dedup, op5_tiff_media, op6_toxicity, op7_line_dedup, op8_pii, op9_quality, op10_simhash, op11_fill_in_middle, op12_suffix_array_dedup, op13_phrase_collocations)}

ORACLE_SQL: dict[str, str] = {
    "op2_preference_chat": """
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text,
         row_number() over (partition by conv_id order by turn, role, text) as nth,
         coalesce(lag(text) over (partition by conv_id order by turn, role, text), '') as before
  from conversations where conv_id is not null),
l as (select *, max(case when role = 'assistant' then nth end) over (partition by conv_id) as last from t),
s as (
  select conv_id, nth, role, text, 'c' as side, case when nth = last and text <> before then 1 else 0 end as differs from l
  union all
  select conv_id, nth, role, case when nth = last then before else text end, 'r', case when nth = last and text <> before then 1 else 0 end from l),
p as (select *, coalesce(min(case when differs = 1 then nth end) over (partition by conv_id) - 1, max(nth) over (partition by conv_id)) as n from s),
r as (
  select *, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) as shown from p),
q as (
  select *, coalesce(sum(case when nth > n then length(shown) else 0 end)
                     over (partition by conv_id, side order by nth rows between unbounded preceding and 1 preceding), 0) as gone from r),
z as (select *, case when nth > n and role = 'assistant'
        then cast(gone + 13 + length(role) as bigint)::varchar || ':' || cast(gone + length(shown) - 1 as bigint)::varchar end as span from q)
select conv_id, cast(max(n) as bigint) as n_prefix,
  coalesce(string_agg(shown, '' order by nth) filter (where side = 'c' and nth <= n), '') as prompt,
  coalesce(string_agg(shown, '' order by nth) filter (where side = 'c' and nth > n), '') as chosen,
  coalesce(string_agg(span, ',' order by nth) filter (where side = 'c' and span is not null), '') as chosen_spans,
  coalesce(string_agg(shown, '' order by nth) filter (where side = 'r' and nth > n), '') as rejected,
  coalesce(string_agg(span, ',' order by nth) filter (where side = 'r' and span is not null), '') as rejected_spans
from z group by conv_id
""",
    "op7_line_dedup": """
with l as (
  select doc_id, text, coalesce(source, '') as site, unnest(string_split(text, chr(10))) as line,
         generate_subscripts(string_split(text, chr(10)), 1) as pos
  from documents),
s as (select *, trim(translate(line, chr(9) || chr(13) || chr(11) || chr(12), '    '), ' ') as body from l),
b as (select body, min((doc_id, pos)) as first from s where body <> '' group by body having count(distinct site) >= 10),
m as (
  select s.*, case when b.body is not null and (s.doc_id, s.pos) <> b.first then 1 else 0 end as gone
  from s left join b on s.body = b.body)
select doc_id, coalesce(string_agg(line, chr(10) order by pos) filter (where gone = 0), '') as text,
       cast(count(*) as bigint) as n_lines, cast(sum(gone) as bigint) as n_removed
from m group by doc_id
""",
    "op11_fill_in_middle": """
with t as (select doc_id, coalesce(text, '') as text, sha256('7:' || doc_id) as d from documents),
w as (
  select doc_id, text, string_split(text, chr(10)) as cells,
         len(string_split(text, chr(10))) - case when text = '' or right(text, 1) = chr(10) then 1 else 0 end as n,
         ('0x' || d[1:8])::bigint as h1, ('0x' || d[9:16])::bigint as h2, ('0x' || d[17:24])::bigint as h3, ('0x' || d[25:32])::bigint as h4
  from t),
f as (
  select doc_id, text, n, cells, least(h1 % (n + 1), h2 % (n + 1)) as lo, greatest(h1 % (n + 1), h2 % (n + 1)) as hi,
         case when text = '' or text like '%<P>%' or text like '%<S>%' or text like '%<M>%' or h3 % 100 >= 100 then 'plain'
              when h4 % 100 < 50 then 'spm' else 'psm' end as form
  from w),
c as (
  select *, case when lo = 0 then 0 when lo = n then length(text) else length(array_to_string(cells[1:lo], chr(10))) + 1 end as x,
         case when hi = 0 then 0 when hi = n then length(text) else length(array_to_string(cells[1:hi], chr(10))) + 1 end as y from f),
o as (
  select *, case form when 'plain' then text
    when 'psm' then '<P>' || left(text, x) || '<S>' || substring(text, y + 1) || '<M>' || substring(text, x + 1, y - x)
    else '<S>' || substring(text, y + 1) || '<P>' || left(text, x) || '<M>' || substring(text, x + 1, y - x) end as output from c)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then cast(x as bigint) end as prefix_chars,
       case when form <> 'plain' then cast(y - x as bigint) end as middle_chars,
       sha256(output) as output_sha256, sha256(text) as restored_sha256
from o
""",
    "op13_phrase_collocations": """
with p as (
  select coalesce(lang, 'und') as lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece
  from documents),
w as (select lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') as words from p),
g as (
  select lang, m, unnest(list_transform(range(1, len(words) - m + 2), lambda i: array_to_string(words[i:i + m - 1], ' '))) as phrase
  from w, (values (1), (2), (3), (4)) v(m) where len(words) >= m),
f as (select lang, m, phrase, count(*) as c from g group by all),
t as (select lang, sum(len(words)) as n from w group by lang),
d as (select lang, m, phrase, c as a, string_split(phrase, ' ') as words from f where m >= 2 and c >= 30),
e as (
  select lang, phrase, a, k, array_to_string(words[1:k], ' ') as head, array_to_string(words[k + 1:], ' ') as tail
  from d, (values (1), (2), (3)) v(k) where k < m),
h as (select lang, phrase, c from f where m < 4 and c >= 30),
s as (
  select e.lang, e.phrase, e.a, k, x.c as l, y.c as r, (2000000::hugeint * e.a) // (x.c + y.c) as score
  from e join h x on x.lang = e.lang and x.phrase = e.head join h y on y.lang = e.lang and y.phrase = e.tail),
b as (select * from s qualify row_number() over (partition by lang, phrase order by score, k) = 1),
i as (
  select lang, a as whole, unnest(list_transform(range(1, m - j + 2), lambda q: array_to_string(words[q:q + j - 1], ' '))) as phrase
  from d, (values (2), (3)) v(j) where j < m),
o as (select lang, phrase, max(whole) as whole from i group by all),
k as (select b.* from b left join o using (lang, phrase) where o.whole is null or 100::hugeint * o.whole < 80::hugeint * b.a),
z as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from k)
select lang, cast(rank as bigint) as rank, phrase, a, l, r, cast(n as bigint) as n, cast(score as bigint) as score
from z join t using (lang) where rank <= 2000
""",
}
