"""Answers out of model text: ordered rules, each with the name under which it is reported."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions import text as T

# What an explicit answer looks like, in the order in which the forms are tried.
EXPLICIT = [r"final\s+answer\s*[:\-]\s*({})\b", r"the\s+answer\s+is\s+({})\b", r"the\s+correct\s+answer\s+is\s+({})\b", r"the\s+correct\s+option\s+is\s+({})\b", r"option\s+({})\b", r"answer\s*[:\-]\s*({})\b"]
YES_NO = ["yes", "no", "maybe"]


def _found(s: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(s, pattern, group), F.lit(""))


def letter(s: Column, last: str = "D") -> Column:
    """The text itself if it is a letter, else the first letter that stands alone."""
    bare = F.upper(F.trim(s, F.lit(" \n\t\r")))
    return F.coalesce(F.when(F.regexp_like(bare, F.lit(f"^[A-{last}]$")), bare), _found(bare, rf"\b([A-{last}])\b"))


def yes_no(s: Column) -> Column:
    bare = F.lower(F.trim(s, F.lit(" \n\t\r")))
    return F.coalesce(F.when(bare.isin(YES_NO), bare), _found(bare, r"\b(yes|no|maybe)\b"))


def explicit(s: Column, options: str = "[ABCD]") -> Column:
    """A bare option, else the first form that occurs anywhere: forms are tried in order, not places."""
    bare = F.trim(s, F.lit(" \n\t\r"))
    forms = [_found(s, "(?i)" + p.format(options)) for p in EXPLICIT]
    return F.coalesce(F.when(F.regexp_like(bare, F.lit(f"(?i)^({options})$")), bare), *forms)


def option_text(body: Column, options: Column) -> Column:
    """The key of the option (a map) whose text occurs in a normalised text, the one that occurs last of several.

    Of options that end at one place the first key is taken.
    """
    entries = F.array_sort(F.map_entries(options))
    places = F.transform(entries, lambda e: F.struct(T.last_position(body, T.collapsed(e["value"])).alias("at"), e["key"].alias("key"), (F.length(T.collapsed(e["value"])) > 0).alias("full")))
    hits = F.filter(places, lambda p: p["full"] & (p["at"] > 0))
    best = F.aggregate(hits, F.struct(F.lit(0).alias("at"), F.lit(None).cast("string").alias("key")), lambda b, p: F.when(p["at"] > b["at"], F.struct(p["at"].alias("at"), p["key"].alias("key"))).otherwise(b))
    return best["key"]


def single(s: Column, options: str = "ABCD") -> Column:
    """The only letter that stands alone; null if there are several or none."""
    found = F.regexp_extract_all(F.upper(s), F.lit(rf"\b([{options}])\b"), F.lit(1))
    return F.when(F.size(found) == 1, found[0])


def mcq(s: Column, options: Column, form: str = "header", title: str = "Final Response", last: str = "D", bodies: tuple[Column, Column] | None = None) -> Column:
    """Struct of the parsed letter (null if unparsed) and the rule that gave it.

    ``bodies``: the normalised final section and cleaned text, where more than lower case and
    single spaces are asked for (``scopes`` gives what to normalise).
    """
    final, cleaned = scopes(s, form, title)
    cls = f"[A-{last}]"
    full = F.nullif(final, F.lit(""))
    in_final, in_all = bodies or (T.collapsed(full), T.collapsed(cleaned))
    rules = [
        ("answer_section:explicit", F.upper(explicit(final, cls))), ("full_text:explicit", F.upper(explicit(cleaned, cls))),
        ("answer_section:option_text", option_text(F.nullif(in_final, F.lit("")), options)), ("full_text:option_text", option_text(in_all, options)),
        ("answer_section:single_letter", single(full, f"A-{last}")),
    ]
    return _first(rules)


def mcq_unwrapped(s: Column, options: Column, title: str = "Final Response", last: str = "D") -> Column:
    """``mcq`` on the text whose thoughts have been unwrapped first, so that a section inside them counts;
    its rules speak of the final section."""
    found = mcq(T.without_think_marks(s), options, "header", title, last)
    return F.struct(found["pred"].alias("pred"), F.replace(found["parse_source"], F.lit("answer_section"), F.lit("final_section")).alias("parse_source"))


def scopes(s: Column, form: str, title: str = "Final Response") -> tuple[Column, Column]:
    """The answer section (null without one), and the text without its thoughts or their marks."""
    if form == "tag":
        return T.tag(s, "answer"), T.without_think(s)
    return T.section(s, title), T.without_think_marks(s)


def yes_no_maybe(s: Column, form: str = "header", title: str = "Final Response") -> Column:
    final, cleaned = scopes(s, form, title)
    cls = "yes|no|maybe"
    words = F.regexp_extract_all(F.lower(F.nullif(final, F.lit(""))), F.lit(r"\b(yes|no|maybe)\b"), F.lit(1))
    return _first([("answer_section:explicit", F.lower(explicit(final, cls))), ("full_text:explicit", F.lower(explicit(cleaned, cls))), ("answer_section:single_word", F.when(F.size(words) == 1, words[0]))])


def _first(rules: list[tuple[str, Column]]) -> Column:
    pred = F.coalesce(*[v for _, v in rules])
    by = F.coalesce(*[F.when(v.isNotNull(), F.lit(n)) for n, v in rules], F.lit("unparsed"))
    return F.struct(pred.alias("pred"), by.alias("parse_source"))


def trace_letter(s: Column) -> Column:
    """The letter right after the first answer tag that has one."""
    return F.upper(_found(s, r"(?i)<answer>\s*([A-E])\b"))


def tag_letter(s: Column) -> Column:
    """Of the first answer tag: a letter with its mark, a bare letter, or the first of A to E anywhere."""
    inside = T.tag(s, "answer")
    return F.upper(F.coalesce(_found(inside, r"^\s*([A-Ea-e])[.\):\s]"), F.when(F.regexp_like(inside, F.lit("^[A-Ea-e]$")), inside), _found(inside, "([A-Ea-e])")))


def options_from_literal(s: Column) -> Column:
    """A map from a literal with single or double quotes; an empty map if it can't be read."""
    read = F.from_json(s, "map<string,string>", {"allowSingleQuotes": "true"})
    return F.coalesce(read, F.create_map().cast("map<string,string>"))
