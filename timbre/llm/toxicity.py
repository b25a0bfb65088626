"""Toxicity: a classifier whose scores are held still when identity terms are swapped.

A logistic model over the presence of words and word beginnings. It is fitted on a bounded sample
of labelled rows: Spark counts the features of the sample, the most telling ones are kept, and in
the fit every labelled sentence that names a group is paired with copies in which its identity
terms are exchanged; the squared change of the logit between the two is part of the loss. So the
name of a group alone moves no score, while abuse around it does. The fitted model is a few
thousand weights; all documents are scored with it in Arrow batches, whole texts.

Defined results: null and empty texts get the score of a text without any telling feature; rows
with a null label are not learned from, of several labels of one document the largest counts; with
no labelled row, or one class only, the model is a constant; repeated rows are scored row by row; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from timbre.llm.memory import release
from timbre.session import cut_lineage

THRESHOLD = 0.3
#: Labelled rows of each class that the model is fitted on, the first in a hashed order.
SAMPLE_PER_CLASS = 4_096
#: Features kept, and the documents of a class that a feature must occur in.
FEATURES, SUPPORT = 4_096, 3
PREFIXES = (4, 5, 6)
RIDGE, COUNTERFACTUAL_WEIGHT, STEPS = 2e-4, 4.0, 400
_COUNT_TASKS, _COUNTS_AT_ONCE = 16, 50_000
_ERRORS, _MARGIN = 2.0, 1.0  # a kept feature has at least this log odds ratio, so many standard errors off

# Identity terms by category, the neutral noun of the category first.
IDENTITY_TERMS = (
    ("people", "women", "men", "girls", "boys", "transgender", "gay", "lesbian", "bisexual", "straight", "queer"),
    ("believers", "muslim", "muslims", "christian", "christians", "jewish", "jews", "hindu", "buddhist", "catholic", "atheist"),
    ("persons", "black", "white", "asian", "african", "latino", "arab", "european", "american", "immigrant", "immigrants", "refugees"),
    ("adults", "elderly", "young", "disabled", "blind", "deaf"),
    ("menschen", "frauen", "männer", "muslime", "christen", "juden", "ausländer", "flüchtlinge", "schwule", "lesben"),
    ("gens", "femmes", "hommes", "musulmans", "chrétiens", "juifs", "immigrés", "réfugiés", "homosexuels", "lesbiennes"),
    ("gente", "mujeres", "hombres", "musulmanes", "cristianos", "judíos", "inmigrantes", "refugiados", "homosexuales", "lesbianas"),
)

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?\n]+")


def swaps(categories: tuple[tuple[str, ...], ...]) -> dict[str, tuple[str, str]]:
    """For each identity term: the neutral noun and the next term of its category."""
    return {
        term: (terms[0], terms[1 + i % (len(terms) - 1)])
        for terms in categories
        for i, term in enumerate(terms[1:], start=1)
    }


def words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def features(found: set[str]) -> set[str]:
    """Words, and beginnings of longer words, marked by a trailing star."""
    begun = {w[:n] + "*" for w in found for n in PREFIXES if len(w) > n}
    return found | begun


def counterfactuals(text: str, exchange: dict[str, tuple[str, str]]) -> Iterator[tuple[set[str], set[str]]]:
    """(features that go, features that come) for each sentence with identity terms and each exchange."""
    for sentence in _SENTENCE.split(text):
        found = words(sentence)
        named = found & exchange.keys()
        if named:
            own = features(found)
            for k in (0, 1):
                other = features((found - named) | {exchange[w][k] for w in named})
                if other != own:
                    yield own - other, other - own


@dataclass
class Model:
    bias: float = 0.0
    weights: dict[str, float] = field(default_factory=dict)

    def logit(self, text: str | None) -> float:
        found, weights = words(text or ""), self.weights
        total = self.bias
        for feature in features(found) & weights.keys():
            total += weights[feature]
        return total

    def score(self, text: str | None) -> float:
        return 1.0 / (1.0 + math.exp(-min(700.0, max(-700.0, self.logit(text)))))


def held_out(doc_id: str = "doc_id"):
    """Rows that no label is learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def training_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the documents that labels are learned from."""
    one = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return one.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")


def labelled_sample(docs: DataFrame, one: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """(toxic, text) of at most ``per_class`` labelled documents of either class, whole texts."""
    shuffled = [F.xxhash64("doc_id"), F.col("doc_id")]
    parts = [one.filter(F.col("toxic") == k).orderBy(*shuffled).limit(per_class) for k in (0, 1)]
    # at most 2 * per_class ids, so the broadcast is bounded
    chosen = F.broadcast(parts[0].unionAll(parts[1]))
    joined = docs.select("doc_id", "text").join(chosen, "doc_id").dropDuplicates(["doc_id"])
    return joined.select("toxic", F.coalesce("text", F.lit("")).alias("text"))


def _telling(sample: DataFrame, totals: dict[int, int], size: int) -> list[str]:
    """The features whose odds differ most surely between the classes."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for frame in frames:
            for toxic, text in zip(frame["toxic"], frame["text"], strict=True):
                seen[int(toxic)].update(features(words(text)))
        names = chain(seen[0], (n for n in seen[1] if n not in seen[0]))
        while part := list(islice(names, _COUNTS_AT_ONCE)):
            yield pd.DataFrame({"feature": part, "clean": [seen[0][n] for n in part], "toxic": [seen[1][n] for n in part]})

    counted = sample.coalesce(_COUNT_TASKS).mapInPandas(count, "feature string, clean long, toxic long")
    sums = counted.groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    cells = [F.col("toxic") + 0.5, totals[1] - F.col("toxic") + 0.5, F.col("clean") + 0.5, totals[0] - F.col("clean") + 0.5]
    ratio = F.log(cells[0] * cells[3] / (cells[1] * cells[2]))
    error = F.sqrt(sum((1 / c for c in cells), F.lit(0.0)))
    ranked = sums.filter(F.greatest("clean", "toxic") >= SUPPORT).withColumn("sure", F.abs(ratio) - _ERRORS * error)
    return [r["feature"] for r in ranked.filter(F.col("sure") > _MARGIN).orderBy(F.desc("sure"), "feature").limit(size).collect()]


def _descend(labels: np.ndarray, rows: list[list[int]], changes: list[tuple[list[int], list[int]]], size: int) -> tuple[float, np.ndarray]:
    """Weights that minimise log loss, a ridge, and the squared logit changes of the counterfactuals."""
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    column = np.array([c for r in rows for c in r], np.int64)
    pair = np.repeat(np.arange(len(changes)), [len(a) + len(b) for a, b in changes])
    moved = np.array([c for a, b in changes for c in [*a, *b]], np.int64)
    sign = np.array([s for a, b in changes for s in [1.0] * len(a) + [-1.0] * len(b)])
    share = labels.mean()
    bias, weights = math.log(share / (1 - share)), np.zeros(size)
    first, second = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, STEPS + 1):  # Adam over the whole sample
        margin = bias + np.bincount(row, weights[column], len(rows))
        residual = (1 / (1 + np.exp(-margin)) - labels) / len(rows)
        slope = np.bincount(column, residual[row], size) + RIDGE * weights
        if len(changes):
            change = np.bincount(pair, sign * weights[moved], len(changes))
            slope += 2 * COUNTERFACTUAL_WEIGHT / len(changes) * np.bincount(moved, sign * change[pair], size)
        gradient = np.append(slope, residual.sum())
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        move = 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
        weights, bias = weights - move[:-1], bias - move[-1]
    return float(bias), weights


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, categories: tuple = IDENTITY_TERMS) -> Model:
    """Model fitted on a bounded sample; what reaches the driver are its kept features, by row."""
    counts = lambda df: {0: 0, 1: 0} | {int(r["toxic"]): r["count"] for r in df.groupBy("toxic").count().collect()}
    one = cut_lineage(training_labels(docs, labels))
    there = counts(one)
    if not there[0] or not there[1]:
        return Model(math.log((there[1] + 0.5) / (there[0] + 0.5)))
    sample = cut_lineage(labelled_sample(docs, one, per_class))
    totals = counts(sample)
    exchange = swaps(categories)
    kept = {f: i for i, f in enumerate(_telling(sample, totals, FEATURES))}

    def vectors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = lambda fs: sorted(kept[f] for f in fs & kept.keys())
        for frame in frames:
            out = []
            for toxic, text in zip(frame["toxic"], frame["text"], strict=True):
                out.append((int(toxic), number(features(words(text))), []))
                for gone, come in counterfactuals(text, exchange):
                    gone, come = number(gone), number(come)
                    if gone or come:
                        out.append((-1, gone, come))
            yield pd.DataFrame(out, columns=["toxic", "gone", "come"])

    rows = sample.coalesce(_COUNT_TASKS).mapInPandas(vectors, "toxic int, gone array<int>, come array<int>").toPandas()
    real = rows[rows["toxic"] >= 0]
    changes = [(list(a), list(b)) for a, b in zip(rows.loc[rows["toxic"] < 0, "gone"], rows.loc[rows["toxic"] < 0, "come"], strict=True)]
    bias, weights = _descend(real["toxic"].to_numpy(float), [list(r) for r in real["gone"]], changes, len(kept))
    # the sample may hold another share of toxic rows than the labels do
    bias += math.log(there[1] / there[0]) - math.log(totals[1] / totals[0])
    return Model(bias, {f: float(weights[i]) for f, i in kept.items()})


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, name: str = "toxicity") -> DataFrame:
    """``keep`` columns (``doc_id`` by default) and ``name``, the score of the whole text."""
    keep = keep or ["doc_id"]

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        release()
        for texts in batches:
            yield pd.Series([model.score(t) for t in texts], dtype="float64")

    return docs.select(*keep, scored("text").alias(name))
