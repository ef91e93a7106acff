"""Personal data: fixed patterns, and contexts learned from what they find.

The matches of the fixed patterns are seeds; so are keys, long runs of letters and digits, as seeds
of a fifth kind, secret. The words before and after a seed are lexical patterns; all tokens with a
digit or an @ that stand by the same words are candidate instances, whatever their shape. Patterns and
instances form a graph: a pattern is trusted by the share of its instances that are already held
to be of a kind, an instance by the patterns that it stands by. A few rounds of joins and
aggregations score the graph, and instances by trusted patterns are added to the spans. A key that
no trusted pattern stands by is not a secret: it may be a checksum.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, slim, staged

KINDS = ("email", "ip", "card", "phone")
#: The kinds that contexts can add: those, and keys.
LEARNED = (*KINDS, "secret")
#: A key, as a seed: 32 hexadecimal digits, or 24 letters and digits of all sorts.
_KEY = re.compile(r"[0-9A-Fa-f]{32,}|(?=[^a-z]*[a-z])(?=[^A-Z]*[A-Z])(?=[^0-9]*[0-9])[A-Za-z0-9_+/=-]{24,}")
#: Characters of a token from which on it is told wherever it stands, not only by its patterns.
TELLING = 8

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A number that goes on from a digit can't begin a match that its first digit didn't.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]")
_DIGITS = re.compile(r"[0-9]")
_SPACE = frozenset(" \t\n\v\f\r")
_EDGE = ".,;:!?\"'()[]{}<>"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each match has one @ with a run of local characters right before it, back to the last match."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            done = m.end()
            yield start, done
            at = text.find("@", done)
        else:
            done = max(done, at + 1)
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(number of the kind, start, end) of the fixed patterns' matches, by kind and start."""
    out = [(0, *span) for span in emails(text)] if "@" in text else []
    if _DIGITS.search(text):
        out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or 0) <= 255 for g in m.groups())]
        for m in _CARD.finditer(text):
            if 13 <= len(m[0]) and 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                out.append((2, *m.span()))
        if "+" in text:
            out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.findall(m[0])) <= 15]
    return out


def candidates(text: str, taken: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Tokens with a digit or @ outside the spans taken, and keys around them; neighbours without letters go together."""
    held = sorted((s, e) for _, s, e in taken)
    spot, at, before = 0, 0, None
    while m := _HINT.search(text, at):
        start, end = m.start(), m.end()
        while start > at and text[start - 1] not in _SPACE:
            start -= 1
        while end < len(text) and text[end] not in _SPACE:
            end += 1
        at = end
        while start < end and text[start] in _EDGE:
            start += 1
        while end > start and text[end - 1] in _EDGE:
            end -= 1
        while spot < len(held) and held[spot][1] <= start:
            spot += 1
        if start == end or spot < len(held) and held[spot][0] < end:
            if before:
                yield before
            before = None
            if _KEY.fullmatch(text, start, end):  # a fixed pattern's match is a part of it
                yield start, end
            continue
        bare = not any(c.isalpha() or c == "@" for c in text[start:end])
        if before and bare and start - before[1] <= 3 and not text[before[1] : start].strip(" ()") and not any(c.isalpha() for c in text[before[0] : before[1]]):
            before = (before[0], end)
        else:
            if before:
                yield before
            before = (start, end)
    if before:
        yield before


#: Words of marks alone that are passed over beside a place.
MARKS = 3


def _beside(text: str, at: int, step: int) -> list[str]:
    """The two words before (step -1) or after (1) a place, the nearer one first, without edges."""
    out: list[str] = []
    stop, back = (0, 1) if step < 0 else (len(text), 0)
    for _ in range(2 + MARKS):
        while at != stop and text[at - back] in _SPACE:
            at += step
        start = at
        while at != stop and text[at - back] not in _SPACE:
            at += step
        word = text[min(start, at) : max(start, at)].strip(_EDGE + "=").lower()
        if word or at == stop:
            out.append(word)
        if len(out) == 2 or at == stop:
            break
    return [*out, "", ""][:2]


def context(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns of a place: the word and the two words before it, and those after it."""
    out = []
    for mark, (near, far) in (("<", _beside(text, start, -1)), (">", _beside(text, end, 1))):
        if near and not _HINT.search(near):
            out.append(mark + near)
            if far and not _HINT.search(far):
                out.append(mark + near + " " + far)
    return out


OCCURRENCE = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("token", pa.string()), ("patterns", pa.list_(pa.string()))])
SCAN = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_email", pa.int64()), ("n_ip", pa.int64()), ("n_card", pa.int64()), ("n_phone", pa.int64()), ("base", pa.string()), ("text_hash", pa.int64()), ("occurrences", pa.list_(OCCURRENCE))])
SCAN_DDL = "row long, doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, text_hash long, occurrences array<struct<kind:int,start:int,end:int,token:string,patterns:array<string>>>"


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What the fixed patterns find in each whole text, and the graph's occurrences in it.

    An occurrence's kind is the number of its fixed pattern, 4 for a key, and -1 if it is unknown.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slim()
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            out = []
            for doc, text, hashed in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                text = text.as_py() or ""
                spans, seen = base_spans(text), []
                if spans or _HINT.search(text):
                    found = [*spans, *((4 if _KEY.fullmatch(text, s, e) else -1, s, e) for s, e in candidates(text, spans))]
                    seen = [{"kind": k, "start": s, "end": e, "token": text[s:e].lower(), "patterns": context(text, s, e)} for k, s, e in found]
                counts = [0] * 4
                for k, _, _ in spans:
                    counts[k] += 1
                out.append((row, doc, *counts, joined(spans), hashed, seen))
                row += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), SCAN, strict=True)], schema=SCAN)

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash")).mapInArrow(run, SCAN_DDL)


def discovered(seen: DataFrame, rounds: int = 3, support: int = 5, trust: float = 0.8) -> DataFrame:
    """row, kind, start and end of the spans that learned contexts add to a scanned table.

    A pattern speaks for a kind if at least ``support`` different known instances of the kind
    stand by it and they, weighed by their scores, are at least ``trust`` of all its different
    instances and one more. An instance's score is one less the product of its patterns' doubts;
    from ``trust`` on it is known in the next round. An instance gets the kind of its best score,
    the first listed among equals. Its occurrences are spans by a trusted pattern of that kind,
    and from ``TELLING`` characters on everywhere.
    """
    flat = seen.select("row", F.explode("occurrences").alias("o")).select("row", "o.*")
    fixed = F.col("kind").between(0, len(KINDS) - 1)
    edges = staged(flat.select(F.explode("patterns").alias("pattern"), "token", "kind").groupBy("pattern", "token").agg(F.max(fixed).alias("fixed")), "edges")
    open_edges = edges.where("not fixed").select("pattern", "token")
    seeds = staged(flat.where("kind >= 0").select("token", "kind").distinct().withColumn("score", F.lit(1.0)), "seeds")
    instances = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    known, found, trusted = seeds, None, None
    for _ in range(rounds):
        speaks = edges.select("pattern", "token").join(known, "token").groupBy("pattern", "kind").agg(F.sum("score").alias("held"), F.count("*").alias("n_held"))
        trusted = staged(speaks.where(F.col("n_held") >= support).join(instances, "pattern").withColumn("faith", F.col("held") / (F.col("n") + 1)).where(F.col("faith") >= trust).select("pattern", "kind", "faith"), "trusted")
        scores = open_edges.join(trusted, "pattern").groupBy("token", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("faith"))))).alias("score"))
        best = scores.groupBy("token").agg(F.max_by("kind", F.struct("score", (-F.col("kind")).alias("k"))).alias("kind"), F.max("score").alias("score")).where(F.col("score") >= trust)
        found = staged(best, "found")
        known = seeds.unionByName(found).groupBy("token", "kind").agg(F.max("score").alias("score"))
    open_spans = flat.where(~fixed).drop("kind").join(found.select("token", "kind"), "token")
    telling = open_spans.where(F.length("token") >= TELLING).select("row", "kind", "start", "end")
    short = open_spans.where(F.length("token") < TELLING).select("row", "kind", "start", "end", F.explode("patterns").alias("pattern")).join(trusted.select("pattern", "kind"), ["pattern", "kind"])
    return telling.unionByName(short.select("row", "kind", "start", "end").distinct())


def find(docs: DataFrame, rounds: int = 3, support: int = 5, trust: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The personal data of every row: counts and digest of the fixed patterns' spans, and all spans.

    Spans are kind:start:end in code points, the end exclusive, by kind and then start. n_email,
    n_ip, n_card and n_phone count the fixed patterns' spans, n_learned those that contexts add;
    text_hash tells rows of one id apart. Contexts also add spans of keys, as secret. A null or empty text has no spans. Repeated rows stay,
    and count once as instances; a null id stays null; other columns are not read.
    """
    seen = staged(scan(docs, id_col, text_col), "scan")
    more = discovered(seen, rounds, support, trust).groupBy("row").agg(F.collect_set(F.struct("kind", "start", "end")).alias("more"))
    ordered = seen.join(more, "row", "left")
    base = F.transform(F.filter("occurrences", lambda o: o["kind"].between(0, len(KINDS) - 1)), lambda o: F.struct(o["kind"].alias("kind"), o["start"].alias("start"), o["end"].alias("end")))
    every = F.transform(F.array_sort(F.concat(base, "more")), lambda s: F.concat_ws(":", F.element_at(F.array(*[F.lit(k) for k in LEARNED]), s["kind"] + 1), s["start"], s["end"]))
    return ordered.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"),
        F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_join(every, ",")).alias("spans"),
        F.coalesce(F.size("more"), F.lit(0)).cast("long").alias("n_learned"), "text_hash",
    )


def masked(text: str, spans: str) -> str:
    """The text with every span, overlapping ones together, put as its kind in brackets."""
    out, done = [], 0
    cuts = sorted((int(s), -int(e), k) for k, s, e in (x.split(":") for x in spans.split(",") if x))
    for start, end, kind in cuts:
        end = -end
        if start >= done:
            out.append(text[done:start] + f"[{kind.upper()}]")
        done = max(done, end)
    return "".join(out) + text[done:]


def redact(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the spans of ``find`` masked in the text column; rows without spans are as they were."""
    key, print_of, of_text = (free(n, docs) for n in ("span_id", "span_hash", "span_list"))
    found = spans.where("spans <> ''").select(F.col("doc_id").alias(key), F.col("text_hash").alias(print_of), F.col("spans").alias(of_text)).dropDuplicates([key, print_of])

    @F.pandas_udf("string")
    def mask(text, of):
        import pandas as pd

        return pd.Series([t if s is None else masked(t, s) for t, s in zip(text, of, strict=True)], dtype=object)

    text = F.col(text_col).cast("string")
    met = docs.join(found, F.col(id_col).cast("long").eqNullSafe(F.col(key)) & (F.xxhash64(text) == F.col(print_of)), "left")
    return met.withColumn(text_col, F.when(F.col(of_text).isNull(), text).otherwise(mask(text, of_text))).select(*[F.col(f"`{c}`") for c in docs.columns])
