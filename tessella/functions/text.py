"""Column expressions on text: splitting, tokens, tags, rendering. All but ``nfkc`` stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are not counted as tokens, for retrieval, for evaluation, for grounding.
STOP_RETRIEVAL = ["a", "an", "and", "are", "as", "at", "be", "by", "does", "for", "from", "how", "in", "is", "of", "on", "or", "the", "to", "what", "which", "with"]
STOP_EVALUATION = ["a", "an", "the", "is", "are", "was", "were", "be", "been", "being", "in", "on", "at", "to", "for", "of", "and", "or", "not", "with", "that", "this", "which", "what", "how", "does", "do", "from"]
# Words that do not count when a thought is held against results.
STOP_GROUNDING = ["the", "and", "are", "for", "from", "has", "have", "that", "this", "with", "was", "were", "been", "being", "will", "would", "could", "should", "may", "can", "not", "but", "also", "which", "their", "there", "than", "other", "more", "most", "such", "when", "what", "its", "does", "did", "had", "into", "over", "between", "through", "often", "includes", "including", "associated", "patients"]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(s: Column) -> Column:
    """The parts of a text between white space, without empty ones."""
    return F.filter(F.split(s, r"\s+"), lambda w: w != "")


def word_count(s: Column) -> Column:
    return F.size(words(s))


def tokens(s: Column, stop: list[str] = STOP_RETRIEVAL, least: int = 1) -> Column:
    """The different lower-case letter and digit runs of at least ``least`` characters, less stop words."""
    pattern = "[a-z0-9]+" if least == 1 else f"[a-z0-9]{{{least},}}"
    found = F.regexp_extract_all(F.lower(s), F.lit(pattern), F.lit(0))
    return F.array_except(found, F.array(*[F.lit(w) for w in stop]))


def english_list(items: Column) -> Column:
    """x; x and y; x, y, and z. Empty for no items."""
    n = F.size(items)
    return (
        F.when(n <= 2, F.array_join(items, " and "))
        .otherwise(F.concat(F.array_join(F.slice(items, F.lit(1), n - 1), ", "), F.lit(", and "), F.element_at(items, -1)))
    )


def filled(template: Column, **values: Column) -> Column:
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def stable_pick(key: Column, n: Column) -> Column:
    """A number from 0 below n that depends on the key alone."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % n


def tag(s: Column, name: str) -> Column:
    """What stands in the first pair of the tag, trimmed; null without one."""
    pattern = f"(?s)<{name}>(.*?)</{name}>"
    return F.when(F.regexp_like(s, F.lit(pattern)), F.trim(F.regexp_extract(s, pattern, 1), F.lit(" \n\t\r")))


def tags(s: Column, name: str) -> Column:
    return F.regexp_extract_all(s, F.lit(f"(?s)<{name}>(.*?)</{name}>"), F.lit(1))


def section(s: Column, title: str) -> Column:
    """What follows a ``## title`` header to the end, trimmed; null without one."""
    quoted = "".join("\\" + c if not c.isalnum() and c != " " else c for c in title)
    pattern = rf"(?is)##\s*{quoted}\s*(.*)$"
    return F.when(F.regexp_like(s, F.lit(pattern)), F.trim(F.regexp_extract(s, pattern, 1), F.lit(" \n\t\r")))


def without_think(s: Column) -> Column:
    """For tag outputs: think blocks and answer tags become spaces."""
    s = F.regexp_replace(s, "(?s)<think>.*?</think>", " ")
    return F.trim(F.replace(F.replace(s, F.lit("<answer>"), F.lit(" ")), F.lit("</answer>"), F.lit(" ")), F.lit(" \n\t\r"))


def without_think_marks(s: Column) -> Column:
    """For header outputs: only the think marks become spaces."""
    return F.trim(F.replace(F.replace(s, F.lit("<think>"), F.lit(" ")), F.lit("</think>"), F.lit(" ")), F.lit(" \n\t\r"))


# Control marks of the chat markup.
CONTROL = ["<|im_start|>", "<|im_end|>", "<|endoftext|>"]


def without_control(s: Column) -> Column:
    for mark in CONTROL:
        s = F.replace(s, F.lit(mark), F.lit(""))
    return F.trim(s, F.lit(" \n\t\r"))


def without_tool_calls(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"(?s)<tool_call>.*?</tool_call>", ""), F.lit(" \n\t\r"))


def collapsed(s: Column) -> Column:
    """Lower case with single spaces: what ``nfkc`` does too, on ASCII text."""
    return F.trim(F.regexp_replace(F.lower(s), r"\s+", " "))


def nfkc(s: Column) -> Column:
    """Compatibility composition, lower case, single spaces. Arrow batches: the JVM functions lack it."""
    @F.pandas_udf("string")
    def run(values):
        return values.str.normalize("NFKC").str.lower().str.replace(r"\s+", " ", regex=True).str.strip()

    return run(s)


def last_position(s: Column, part: Column) -> Column:
    """1-based place where the last occurrence begins; 0 if there is none."""
    at = F.position(F.reverse(part), F.reverse(s))
    return F.when(at > 0, F.length(s) - at - F.length(part) + 2).otherwise(0)


def copied_share(query: Column, question: Column, stop: list[str] = STOP_EVALUATION) -> Column:
    """The share of the query's tokens that the question has; 0 for a query without tokens."""
    q = tokens(query, stop)
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, tokens(question, stop))) / F.size(q))


def multiset_common(a: Column, b: Column) -> Column:
    """Elements in common, each as often as the rarer side has it."""
    each = F.transform(F.array_distinct(a), lambda w: F.least(F.size(F.filter(a, lambda x: x == w)), F.size(F.filter(b, lambda x: x == w))))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x)


def token_f1(prediction: Column, gold: Column) -> Column:
    """F1 of white-space tokens as multisets, in lower case; 0 without common ones."""
    p, g = words(F.lower(prediction)), words(F.lower(gold))
    common = multiset_common(p, g)
    return F.when(common == 0, 0.0).otherwise(2.0 * common / (F.size(p) + F.size(g)))


def title_phrases(s: Column) -> Column:
    """Runs of capitalised words, and acronyms of two and more capitals."""
    return F.array_union(F.regexp_extract_all(s, F.lit(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b"), F.lit(0)), F.regexp_extract_all(s, F.lit(r"\b[A-Z]{2,}\b"), F.lit(0)))
