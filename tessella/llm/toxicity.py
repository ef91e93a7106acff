"""Toxicity by cumulative-link ordinal regression over sparse text features.

One weight a word is shared by all thresholds: P(grade > k) = sigmoid(w.x - t_k), with t_1 < t_2 <
t_3. Labels tell only toxic from clean; the grades to learn are made from them: 0 is clean, and
toxic texts get 1 (mild), 2 or 3 (severe) by the number of their words that the labels show to be
typical of toxic texts, cut at the thirds of that number over the labelled toxic texts.

Features are words and the first four and five letters of words, which inflected words share.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, staged

#: Labelled rows that the model is fitted on at most, taken evenly by a hash of their id.
LABELLED = 20_000
#: Words that become features at most, those that tell toxic from clean texts best.
WORDS = 2_000
GRADES = 3
#: Least root of the likelihood ratio statistic of a word against the label, in standard errors.
SURE = 3.5

#: Letters at the start of a word that are features too.
STEMS = (4, 5)
#: Words whose features a worker remembers before it starts anew.
REMEMBERED = 150_000

_WORD = re.compile(r"[^\W\d_]+")


def word_counts(text: str | None) -> Counter:
    return Counter(_WORD.findall((text or "").lower()))


def names(word: str) -> list[str]:
    """The features of a word."""
    return [word] + ["^" + word[:n] for n in STEMS if len(word) >= n]


@dataclass
class Model:
    vocabulary: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def __post_init__(self) -> None:
        self.known: dict[str, tuple[int, ...]] = {}

    def counts(self, words: Counter) -> dict[int, int]:
        """How often each feature occurs."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        out: dict[int, int] = {}
        for word, n in words.items():
            own = self.known.get(word)
            if own is None:
                own = self.known[word] = tuple(self.vocabulary[x] for x in names(word) if x in self.vocabulary)
            for i in own:
                out[i] = out.get(i, 0) + n
        return out

    def above(self, words: Counter) -> np.ndarray:
        """P(grade > k) for k from 0; a text without known features has the least of all grades."""
        z = sum(self.weights[i] * np.log1p(n) for i, n in sorted(self.counts(words).items()))
        return 1 / (1 + np.exp(np.clip(self.thresholds - z, -500, 500)))


def fit_ordinal(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grades: np.ndarray, n_features: int, n_grades: int = GRADES, ridge: float = 1e-3, rounds: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by gradient steps (Adam) on the mean log-likelihood.

    The thresholds are a first one and positive gaps, so they stay in order.
    """
    n = len(grades)
    w, first, gaps = np.zeros(n_features), 0.0, np.zeros(n_grades - 1)
    state = [np.zeros(n_features + n_grades), np.zeros(n_features + n_grades)]
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    for step in range(1, rounds + 1):
        t = first + np.concatenate([[0], np.cumsum(np.exp(gaps))])
        z = np.bincount(rows, values * w[columns], n)
        edge = np.concatenate([np.ones((n, 1)), sigmoid(z[:, None] - t), np.zeros((n, 1))], axis=1)  # P(grade >= k)
        slope = edge * (1 - edge)
        at = np.arange(n)
        p = np.maximum(edge[at, grades] - edge[at, grades + 1], 1e-12)
        dz = (slope[at, grades] - slope[at, grades + 1]) / p
        dt = np.zeros((n, n_grades + 2))
        dt[at, grades] -= slope[at, grades] / p
        dt[at, grades + 1] += slope[at, grades + 1] / p
        dt = dt[:, 1:-1].mean(axis=0)
        dw = np.bincount(columns, values * dz[rows], n_features) / n - ridge * w
        after = np.cumsum(dt[::-1])[::-1]  # of a threshold and all above it
        gradient = np.concatenate([dw, [after[0]], after[1:] * np.exp(gaps)])
        state[0] = 0.9 * state[0] + 0.1 * gradient
        state[1] = 0.99 * state[1] + 0.01 * gradient**2
        move = 0.1 * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-8)
        w, first, gaps = w + move[:n_features], first + move[n_features], gaps + move[n_features + 1 :]
    return w, first + np.concatenate([[0], np.cumsum(np.exp(gaps))])


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, words: int = WORDS, least: int = 3, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """A model from labelled texts, or None if the labels don't hold both toxic and clean ones.

    ``labels``: doc_id and toxic. At most about ``labelled`` rows are used; the chosen features
    and their sparse counts in those rows are all that reaches the driver. Labels without an
    id, a verdict or a document don't count; of several for an id the highest does. Null and empty
    texts have no words. Of features, the ``words`` that tell most are taken; the rest, which tell less, carry no weight.
    """
    own, verdict = free("label_id", docs), free("label_toxic", docs)
    one = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias(own)).agg(F.max(F.col("toxic").cast("int")).alias(verdict))
    share = min(1.0, labelled / max(one.count(), 1))
    picked = one.where(F.pmod(F.xxhash64(F.lit(17), own), F.lit(1 << 30)) < int(share * (1 << 30)))
    text = staged(docs.join(F.broadcast(picked), F.col(id_col).cast("long") == F.col(own)).select(F.col(own).alias("_id"), F.col(verdict).alias("_toxic"), F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("_text")), "labelled")
    # Copies would make every word of theirs look typical: of equal texts with one verdict one counts.
    alike = text.groupBy(F.sha2("_text", 256), "_toxic").agg(F.min("_id").alias("_id")).select("_id")
    text = text.join(F.broadcast(alike), "_id", "left_semi")
    sizes = {r["_toxic"]: r["n"] for r in text.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sum(n for t, n in sizes.items() if t), sizes.get(0, 0)
    if not n1 or not n0:
        return None
    stems = [F.transform(F.filter("_words", lambda w: F.length(w) >= n), lambda w: F.concat(F.lit("^"), F.substring(w, 1, n))) for n in STEMS]  # noqa: B023
    words_of = F.array_distinct(F.expr(r"regexp_extract_all(_text, '[\\p{L}]+', 0)"))
    held = text.select("_toxic", words_of.alias("_words")).select("_toxic", F.explode(F.array_distinct(F.concat("_words", *stems))).alias("word")).groupBy("word").agg(F.sum(F.when(F.col("_toxic") > 0, 1).otherwise(0)).alias("a"), F.count("*").alias("n")).where(F.col("n") >= least)
    n, part = n1 + n0, lambda seen, of, n_words: F.when(seen > 0, seen * F.log(seen * (n1 + n0) / (F.lit(float(of)) * n_words))).otherwise(0.0)
    a, w = F.col("a"), F.col("n")
    g = 2 * (part(a, n1, w) + part(w - a, n0, w) + part(n1 - a, n1, n - w) + part(n0 - w + a, n0, n - w))
    z = F.sqrt(F.greatest(g, F.lit(0.0))) * F.signum(a * n - w * n1)
    best = held.withColumn("z", F.round(z, 9)).where(F.abs("z") >= SURE).orderBy(F.abs("z").desc(), "word").limit(words).collect()
    if not best:
        return None
    vocabulary = {r["word"]: i for i, r in enumerate(best)}
    reader = Model(vocabulary, np.zeros(len(best)), np.zeros(GRADES))
    typical = np.array([r["z"] > 0 for r in best])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, of = [], []
            for body in batch.column(1).to_pylist():
                own = sorted(reader.counts(word_counts(body)).items())
                at.append([i for i, _ in own])
                of.append([c for _, c in own])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.list_(pa.int32())), pa.array(of, pa.list_(pa.int32()))], names=["toxic", "at", "of"])

    taken = text.orderBy("_id").select("_toxic", "_text").mapInArrow(count, "toxic int, at array<int>, of array<int>").toArrow().to_pydict()
    toxic = np.array(taken["toxic"])
    rows = np.repeat(np.arange(len(toxic)), [len(a) for a in taken["at"]])
    columns = np.array([i for a in taken["at"] for i in a], np.int64)
    counts = np.array([c for o in taken["of"] for c in o], float)
    typed = np.bincount(rows, counts * typical[columns], len(toxic))
    cuts = np.quantile(typed[toxic > 0], [i / GRADES for i in range(1, GRADES)])
    grades = np.where(toxic > 0, 1 + np.searchsorted(cuts, typed, "left"), 0)
    return Model(vocabulary, *fit_ordinal(rows, columns, np.log1p(counts), grades, len(vocabulary)))


SCORES = "expected_severity double, severity int, p_toxic double, toxic boolean"


def score(docs: DataFrame, model: Model | None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, expected_severity (0 to 3), severity (the likeliest grade, the lower of equals),
    p_toxic (of a grade over 0) and toxic (p_toxic at least ``threshold``) of every row.

    A null or empty text is scored as one without known words. Without a model nothing is toxic.
    Repeated rows stay; a null id stays null; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            over = np.zeros((n, GRADES))
            if model:
                for i, text in enumerate(batch.column(1)):
                    over[i] = model.above(word_counts(text.as_py()))
            each = np.concatenate([np.ones((n, 1)), over], axis=1) - np.concatenate([over, np.zeros((n, 1))], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(over.sum(axis=1)), pa.array(each.argmax(axis=1).astype(np.int32)), pa.array(over[:, 0]), pa.array(over[:, 0] >= threshold)], names=["doc_id", "expected_severity", "severity", "p_toxic", "toxic"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id long, {SCORES}")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``fit`` and ``score`` in one: a row for each row of ``docs``, as ``score`` says for nulls, empty
    texts and repeats. Whole texts are read however long. Empty tables give no rows, empty labels no toxic ones."""
    return score(docs, fit(docs, labels), threshold)


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not toxic, with all their columns, in one pass over the texts.

    Null and empty texts stay, equal texts all stay or all go, null ids count as any, and without
    labels of both verdicts all rows stay. No column but the id and the text is read.
    """
    model = fit(docs, labels, id_col=id_col, text_col=text_col)

    @F.pandas_udf("boolean")
    def toxic(text):
        import pandas as pd

        if model is None:
            return pd.Series([False] * len(text))
        return pd.Series([bool(model.above(word_counts(t))[0] >= threshold) for t in text])

    return docs.where(~toxic(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
