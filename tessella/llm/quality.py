"""Quality rules: statistics of whole texts, and robust multivariate outliers among them.

For each language and source, the minimum covariance determinant estimate of the transformed
statistics is found by concentration steps: take the half of the documents nearest to the present
centre, take their mean and covariance as the next. Four starts that outliers sway in different
ways take two steps each; the one of the least determinant goes on until its determinant stops
falling. The estimate is then made anew from all rows that are not far by it, which are more than half. A step
over all documents of all groups is one aggregation, so groups are never brought to one task: sums
are kept by bins of the distance, whose bounds are finer than any decision needs and do not depend on
how rows are dealt.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, Texts, Words, staged

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"

STATS_DDL = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_BEGINS = np.array([b & 0xC0 != 0x80 for b in range(256)])  # bytes that begin a code point


def text_stats(column: pa.Array, window: int = 5) -> np.ndarray:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text, as rows."""
    out = np.zeros((len(column), 5), np.int64)
    for first, end, data, offsets in Texts(column).steps():
        own = out[first:end]
        words = Words(data, offsets)
        own[:, 0] = np.diff(words.bounds)
        sums = lambda flags, cuts=offsets: np.diff(np.concatenate([[0], np.cumsum(flags)])[cuts])
        own[:, 1] = sums(~SPACES[data] & _BEGINS[data])
        own[:, 2] = sums(_SYMBOL[data])
        hashes = words.hashes()
        grams, whole = words.grams(hashes, window)
        at = np.flatnonzero(whole)
        if len(at):
            doc = words.text[at]
            order = np.lexsort((grams[at], doc))
            g, d = grams[at][order], doc[order]
            same = (g[1:] == g[:-1]) & (d[1:] == d[:-1])
            twice = np.zeros(len(g), bool)
            twice[1:] |= same
            twice[:-1] |= same
            hit = at[order][twice]
            cover = np.bincount(hit, minlength=len(hashes) + 1) - np.bincount(hit + window, minlength=len(hashes) + 1)
            own[:, 4] = sums(np.cumsum(cover[:-1]) > 0, words.bounds)
        text = data.tobytes()
        for i in range(end - first):
            lines = text[offsets[i] : offsets[i + 1]].split(b"\n")
            if len(lines) > 1:
                solid_lines = [x for x in lines if x.strip(b" \t\n\v\f\r")]
                own[i, 3] = len(solid_lines) - len(set(solid_lines))
    return out


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The statistics of every whole text. A null or empty text has zeros; repeated rows stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = text_stats(batch.column(3))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array(found[:, i]) for i in range(5)]], names=[c.split()[0] for c in STATS_DDL.split(", ")])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, STATS_DDL)


def base_failed(n_words: str | Column = "n_words", n_repeat_words: str | Column = "n_repeat_words") -> Column:
    n, r = (F.col(c) if isinstance(c, str) else c for c in (n_words, n_repeat_words))
    return (n < 10) | (100 * r > 20 * n)


#: The transformed statistics: a name, an expression, and the least standard deviation that counts
#: as spread, so that a group whose statistic never varies doesn't reject the first that does.
FEATURES: list[tuple[str, str, float]] = [
    ("size", "ln(1 + n_words)", 0.5),
    ("word_length", "ln(1 + word_chars / greatest(n_words, 1))", 0.1),
    ("symbols", "sqrt(n_symbols / greatest(n_words, 1))", 0.08),
    ("dup_lines", "sqrt(n_dup_lines / greatest(n_words, 1))", 0.05),
    ("repeats", "sqrt(n_repeat_words / greatest(n_words, 1))", 0.08),
]

#: Histogram bins of a distance's logarithm: 64 to each doubling.
_FINE = 64


@cache
def chi2_quantile(p: float, k: int) -> float:
    """By bisection of the regularised lower gamma function's series."""

    def cdf(x: float) -> float:
        a, y = k / 2, x / 2
        term = total = 1 / a
        for i in range(1, 2000):
            term *= y / (a + i)
            total += term
            if term < 1e-16 * total:
                break
        return total * math.exp(a * math.log(y) - y - math.lgamma(a))

    lo, hi = 1e-9, 10.0 * k + 200
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return hi


def _distance(x: list[str], model: str = "m") -> Column:
    """Squared Mahalanobis distance to ``{model}.center`` by the inverse in ``{model}.inverse``."""
    k = len(x)
    gap = [F.col(c) - F.col(f"{model}.center")[i] for i, c in enumerate(x)]
    terms = [gap[i] * gap[j] * F.col(f"{model}.inverse")[i * k + j] * (1 if i == j else 2) for i in range(k) for j in range(i, k)]
    return F.greatest(reduce(lambda a, b: a + b, terms), F.lit(0.0))


def _shape(center: np.ndarray, cov: np.ndarray, floors: list[float]) -> tuple[list[float], list[float], float]:
    """The centre, the inverse covariance with the floors as least spread, and the log determinant."""
    c = cov + np.diag(np.square(floors))
    return center.tolist(), np.linalg.inv(c).ravel().tolist(), float(np.linalg.slogdet(c)[1])


def _square(row: dict, name: str, k: int) -> np.ndarray:
    return np.array([[row[f"{name}{min(a, b)}_{max(a, b)}"] for b in range(k)] for a in range(k)])


def _shapes(sums: DataFrame, group: list[str], k: int, make) -> DataFrame:
    """Models of each group's sums: ``make`` gives (start, (centre, inverse, log determinant)) of a row; as few rows as groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(*[row[g] for g in group], start, *shape) for row in batch.to_pylist() for start, shape in make(row)]
            types = [pa.string()] * len(group) + [pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64()]
            columns = list(zip(*out, strict=True)) if out else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[*group, "start", "center", "inverse", "det"])

    made = sums.mapInArrow(run, ", ".join(f"{g} string" for g in group) + ", start int, center array<double>, inverse array<double>, det double")
    return made.select(*group, "start", F.struct("center", "inverse").alias("m"), "det")


def _classical(k: int, floors: list[float], scale: float):
    """The mean and covariance of n rows with sums s and sums of products q, under the row's own start."""

    def make(row: dict) -> list[tuple]:
        center = np.array([row[f"s{a}"] for a in range(k)]) / row["n"]
        return [(row.get("start") or 0, _shape(center, (_square(row, "q", k) / row["n"] - np.outer(center, center)) * scale, floors))]

    return make


#: Groups whose estimates are broadcast at most: about 5 MB. More are joined by key.
GROUPS = 10_000


def _small(models: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(models) if few else models


def _sums(x: list) -> list[Column]:
    """The sums of values and of their products, as _classical reads them."""
    k = len(x)
    return [F.count("*").alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(x)], *[F.sum(x[a] * x[b]).alias(f"q{a}_{b}") for a in range(k) for b in range(a, k)]]


#: Bins to one unit of a feature in which medians are told.
_MEDIAN = 1024


def _medians(rows: DataFrame, group: list[str], x: list[Column], name: str) -> DataFrame:
    """The median of each value of each group, to one bin, as an array."""
    each = rows.select(*group, F.posexplode(F.array(*x)).alias("i", "v")).groupBy(*group, "i", F.floor(F.col("v") * _MEDIAN).alias("bin")).agg(F.count("*").alias("n"))
    of = Window.partitionBy(*group, "i")
    told = each.withColumns({"upto": F.sum("n").over(of.orderBy("bin")), "all": F.sum("n").over(of)}).where("2 * upto >= all").groupBy(*group, "i").agg(((F.min("bin") + 0.5) / _MEDIAN).alias("v"))
    return told.groupBy(*group).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda p: p["v"]).alias(name))  # an entry a value


def starts(rows: DataFrame, group: list[str], x: list[str], floors: list[float]) -> DataFrame:
    """The estimates that concentration begins with, as models.

    0 is the classical one. The others have the medians as centre and take their spread from median
    absolute deviations: 1 without correlations, 2 with those of the directions from the centre
    alone (spatial signs), 3 with those of the values bent by tanh.
    """
    k = len(x)
    col = [F.col(c) for c in x]
    classical = _shapes(rows.groupBy(*group).agg(*_sums(col)), group, k, _classical(k, floors, 1.0))
    middle = staged(_medians(rows, group, col, "middle"), "middle")
    few = middle.count() <= GROUPS
    beside = rows.join(_small(middle, few), group)
    off = [F.abs(c - F.col("middle")[i]) for i, c in enumerate(col)]
    spread = staged(_medians(beside, group, off, "spread").join(middle, group), "spread")
    beside = rows.join(_small(spread, few), group)
    scaled = [(c - F.col("middle")[i]) / F.sqrt((1.4826 * F.col("spread")[i]) ** 2 + floors[i] ** 2) for i, c in enumerate(col)]
    beside = beside.select(*group, "middle", "spread", *[z.alias(f"z{i}") for i, z in enumerate(scaled)])
    z = [F.col(f"z{i}") for i in range(k)]
    norm = F.sqrt(reduce(lambda a, b: a + b, [c * c for c in z]))
    pairs = [(a, b) for a in range(k) for b in range(a, k)]
    bent = [F.tanh(c) for c in z]
    sums = beside.withColumn("norm", norm).groupBy(*group).agg(
        F.first("middle").alias("middle"), F.first("spread").alias("spread"), *_sums(bent),
        *[F.sum(F.when(F.col("norm") > 0, z[a] * z[b] / F.col("norm") ** 2).otherwise(0.0)).alias(f"u{a}_{b}") for a, b in pairs],
    )

    def make(row: dict) -> list[tuple]:
        center, n = np.array(row["middle"]), row["n"]
        own = np.sqrt((1.4826 * np.array(row["spread"])) ** 2 + np.square(floors))
        mean = np.array([row[f"s{a}"] for a in range(k)]) / n
        cov = _square(row, "q", k) / n - np.outer(mean, mean)
        root = np.sqrt(np.maximum(np.diag(cov), 1e-12))
        bent = cov / np.outer(root, root)
        np.fill_diagonal(bent, 1.0)
        signs = k * _square(row, "u", k) / n
        return [(i, _shape(center, shape * np.outer(own, own), floors)) for i, shape in ((1, np.eye(k)), (2, signs), (3, bent))]

    return classical.unionByName(_shapes(sums, group, k, make))


#: Steps that a model takes at most, if its determinant doesn't stop falling before.
STEPS = 20
#: Log determinants that fall by less, all groups together, have stopped.
FALLS = 1e-3
#: The share of rows that are not far: an estimate's rows at last are those within this chi-squared quantile.
NOT_FAR = 0.975


def mcd_models(rows: DataFrame, group: list[str], x: list[str], floors: list[float], share: float = 0.5) -> DataFrame:
    """The estimate of each group: columns ``group`` and m(center, inverse), and det, the log
    determinant that the steps came to.

    Each of the four ``starts`` concentrates twice on the ``share`` of the rows that are nearest; of
    each group the one of the least determinant goes on, until the sum of the groups' log
    determinants falls by less than ``FALLS``. The covariance is enlarged to that of all rows of a normal distribution.
    Centre and covariance are then taken anew from all rows within the ``NOT_FAR`` quantile.
    ``rows`` must be cheap to read again; group columns must not be null. A group of one row has
    that row as its centre and the floors as its spread.
    """
    k = len(x)
    col = [F.col(c) for c in x]
    scale = lambda p: p / chi2_quantile_share(chi2_quantile(p, k), k + 2)

    def step(models: DataFrame) -> DataFrame:
        at = F.floor(F.log2(_distance(x) + F.lit(1e-9)) * _FINE).cast("int")
        bins = rows.join(_small(models.drop("det"), few), group).groupBy(*group, "start", at.alias("bin")).agg(*_sums(col))
        of = Window.partitionBy(*group, "start")
        near = bins.withColumns({"before": F.sum("n").over(of.orderBy("bin")) - F.col("n"), "all": F.sum("n").over(of)}).where(F.col("before") < F.ceil(F.col("all") * share))
        sums = near.groupBy(*group, "start").agg(*[F.sum(c).alias(c) for c in bins.columns if c not in (*group, "start", "bin")])
        return staged(_shapes(sums, group, k, _classical(k, floors, scale(share))), "model")

    models = staged(starts(rows, group, x, floors), "model")
    few = models.count() <= 4 * GROUPS
    models = step(step(models))
    models = staged(models.groupBy(*group).agg(F.min_by(F.struct("start", "m", "det"), F.struct("det", "start")).alias("b")).select(*group, "b.*"), "model")
    before = None
    for _ in range(STEPS):
        after = step(models)
        total = after.agg(F.sum("det")).first()[0]
        if total is None or before is not None and total >= before - FALLS:
            break
        models, before = after, total
    limit = chi2_quantile(NOT_FAR, k)
    sums = rows.join(_small(models.drop("det"), few), group).where(_distance(x) <= limit).groupBy(*group).agg(*_sums(col))
    last = _shapes(sums, group, k, _classical(k, floors, scale(NOT_FAR))).select(*group, F.col("m").alias("anew"))
    return staged(models.join(last, group, "left").select(*group, F.coalesce("anew", "m").alias("m"), "det"), "model")


@cache
def chi2_quantile_share(x: float, k: int) -> float:
    """The share of a chi-squared distribution of ``k`` degrees below x."""
    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_quantile(mid, k) < x else (lo, mid)
    return lo


def quality(docs: DataFrame, confidence: float = 0.99999, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The statistics of every document with base_failed, distance and kept.

    A document is rejected if it fails the base rules or if its squared Mahalanobis distance to
    its group's estimate exceeds the chi-squared quantile of ``confidence``. Estimates are made from
    the documents that pass the base rules. Null languages or sources form groups of their own; a
    group none of whose documents pass has no estimate, and no rejections beyond the base rules.
    A null or empty text fails them; of a very long one all words count. Repeated rows stay and count as often as they occur; other columns are not read. Languages and sources are taken to be
    few: the estimates, of a few hundred bytes a group, are broadcast while they are under
    ``GROUPS`` groups and joined by key beyond that.
    """
    x, floors = [f"x{i}" for i in range(len(FEATURES))], [f for _, _, f in FEATURES]
    read = statistics(docs, id_col, text_col, lang_col, source_col).withColumn("base_failed", base_failed())
    read = read.withColumns({c: F.expr(e).cast("double") for c, (_, e, _) in zip(x, FEATURES, strict=True)})
    rows = staged(read.withColumns({"g_lang": F.concat(F.lit("="), F.coalesce("lang", F.lit(""))), "g_source": F.concat(F.when(F.col("source").isNull(), "0").otherwise("1"), F.when(F.col("lang").isNull(), "0").otherwise("1"), F.coalesce("source", F.lit("")))}), "stats")
    group = ["g_lang", "g_source"]
    models = mcd_models(rows.where("not base_failed").select(*group, *x), group, x, floors)
    limit = chi2_quantile(confidence, len(x))
    scored = rows.join(_small(models.drop("det"), models.count() <= GROUPS), group, "left").withColumn("distance", _distance(x))
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= limit)
    return scored.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", kept.alias("kept"))
