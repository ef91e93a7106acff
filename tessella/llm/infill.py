"""Fill-in-middle transformation: DuckDB inside the tasks, one query over each slice of a batch.

A text is cut into lines, two cuts are drawn from a hash of its id, and the three parts are put in
the order that a model learns to fill. Each slice of an Arrow batch is registered as a table; one
SQL statement makes all columns; the result goes back as Arrow. No row passes through Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED = 7
#: Of 100 texts so many are transformed, and of 100 of those so many in the order suffix, prefix, middle.
RATE, SPM = 100, 50
#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
UNIT = r"[^\n]*\n|[^\n]+"
#: Bytes of text that one statement takes at once; one longer text still goes alone.
SLICE_BYTES = 4 << 20

RESULT = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string, restored_sha256 string"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def statement(seed: int = SEED, rate: int = RATE, spm: int = SPM, marks: tuple[str, str, str] = MARKS, unit: str = UNIT) -> str:
    """The SQL over a table ``given`` (nth, id, text), in DuckDB's dialect."""
    p, s, m = map(_quoted, marks)
    part = lambda k: f"cast(concat('0x', substring(sha256('{int(seed)}:' || coalesce(id, '')), {8 * k + 1}, 8)) as bigint)"
    return f"""
with texts as (select nth, id, coalesce(text, '') as text from given),
drawn as (
  select nth, text, regexp_extract_all(text, {_quoted(unit)}) as units, {part(0)} as h1, {part(1)} as h2,
         case when text = '' or contains(text, {p}) or contains(text, {s}) or contains(text, {m}) or {part(2)} % 100 >= {int(rate)} then 'plain'
              when {part(3)} % 100 < {int(spm)} then 'spm' else 'psm' end as form
  from texts),
cut as (
  select nth, text, form, units, len(units) as n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) as low, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) as high
  from drawn),
parts as (
  select nth, text, form, n,
         case when form <> 'plain' then array_to_string(list_slice(units, 1, low), '') end as prefix,
         case when form <> 'plain' then array_to_string(list_slice(units, low + 1, high), '') end as middle,
         case when form <> 'plain' then array_to_string(list_slice(units, high + 1, n), '') end as suffix
  from cut),
made as (
  select nth, n, form, length(prefix) as prefix_chars, length(middle) as middle_chars,
         case form when 'psm' then {p} || prefix || {s} || suffix || {m} || middle
                   when 'spm' then {s} || suffix || {p} || prefix || {m} || middle else text end as output
  from parts),
split as (
  select *, case form when 'psm' then instr(output, {s}) when 'spm' then instr(output, {p}) end as second, instr(output, {m}) as third from made),
back as (
  select *, case form when 'psm' then substring(output, {len(marks[0]) + 1}, second - {len(marks[0]) + 1})
                      when 'spm' then substring(output, second + {len(marks[0])}, third - second - {len(marks[0])}) end as a,
            case when form <> 'plain' then substring(output, third + {len(marks[2])}) end as b,
            case form when 'psm' then substring(output, second + {len(marks[1])}, third - second - {len(marks[1])})
                      when 'spm' then substring(output, {len(marks[1]) + 1}, second - {len(marks[1]) + 1}) end as c
  from split)
select n, form, prefix_chars, middle_chars, output, sha256(output) as output_sha256,
       sha256(case when form = 'plain' then output else a || b || c end) as restored_sha256
from back order by nth
"""


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM, marks: tuple[str, str, str] = MARKS, unit: str = UNIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: its id, n (units), form, prefix_chars and middle_chars, output, its sha256, and that of the text rebuilt from it.

    Units are the matches of ``unit``, a pattern that must cover every text from its start to its end.
    The form is plain, psm or spm; a plain text is its own output. What a mark begins with
    may stand in no mark again, and no mark may begin with another, so that none can arise where
    two parts meet.

    A null text is an empty one, and both are plain with no units. A null id draws as an empty one.
    Rows with equal ids draw the same numbers; repeated rows give repeated results. A text of one unit
    has cuts only at its ends, so up to two of its parts are empty. Very long texts are taken whole, in
    a slice of their own. An empty table gives no rows. Other columns don't come along, whatever they
    are called.
    """
    if not all(marks) or any(m[0] in x[1:] for m in marks for x in marks) or any(x.startswith(m) for i, m in enumerate(marks) for j, x in enumerate(marks) if i != j):
        raise ValueError("what a mark begins with must not stand in one again, and none may begin with another")
    given = docs.select(F.col(id_col).alias("id"), F.col(id_col).cast("string").alias("key"), F.col(text_col).cast("string").alias("text"))
    sql = statement(seed, rate, spm, marks, unit)
    names = [c.split()[0] for c in RESULT.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        # One thread and no files: the task has one core, and what a slice needs is bounded.
        con = duckdb.connect(config={"threads": 1, "temp_directory": "", "preserve_insertion_order": True})
        try:
            for batch in batches:
                for piece in _slices(batch):
                    table = pa.table({"nth": pa.array(range(len(piece)), pa.int64()), "id": piece["key"], "text": piece["text"]})
                    con.register("given", table)
                    made = con.sql(sql).to_arrow_table()
                    con.unregister("given")
                    out = [piece["id"]] + [made[c].combine_chunks().cast(pa.string() if pa.types.is_string(made[c].type) or pa.types.is_large_string(made[c].type) else pa.int64()) for c in names]
                    yield pa.RecordBatch.from_arrays(out, names=["id", *names])
        finally:
            con.close()

    kind = given.schema["id"].dataType.simpleString()
    return given.mapInArrow(work, f"id {kind}, {RESULT}").withColumnRenamed("id", id_col)


def _slices(batch: pa.RecordBatch, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows of at most ``most`` bytes of text together, a longer text alone."""
    ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(batch["text"]), 0).cast(pa.int64())).to_numpy(zero_copy_only=False)
    at = 0
    while at < len(batch):
        gone = ends[at - 1] if at else 0
        end = max(at + 1, int(ends.searchsorted(gone + most, "right")))
        yield batch.slice(at, end - at)
        at = end
