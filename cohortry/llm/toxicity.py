"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

Features are words, and word beginnings of four to six letters, in lower case;
each counts as ln(1 + occurrences). Spark counts on a labelled sample in how many
toxic and clean documents every feature occurs, and the features that tell the
two apart best (likelihood ratio) are kept.

Labels only mark toxic rows, so grades are made from them by cross-fitting: the sample is dealt
into two halves by a hash of doc_id, a logistic regression on the labels of each half scores
the other one, and the toxic rows of a half get grades 1 to ``grades``, in equal parts by that
score; clean rows have grade 0. So no row's grade is made by a model that has seen its label. The
features are chosen on the whole sample. Where a half lacks a class, all rows score
themselves. The regression shares one weight vector across the ordered
thresholds: P(grade > k) = logistic(w x - t_k), t_0 < t_1 < ... The severity of
a document is its expected grade, the sum of these; a document is rejected if the
severity reaches a limit.

The sample is bounded per class, and drawn by a hash from the rows of ``labels`` and then of
their documents outside a held-out fold; rows that repeat a doc_id and its text count
once. Rows are weighted so that the classes count as in all
labels outside the fold. A null or empty text has no features and gets the
severity of that. Without labels of both classes nothing is toxic and every
severity is 0. Null labels do not count, and labels that repeat a doc_id
count once, the highest. Rows repeat as given; other columns of any name do no
harm. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import LOWER, UPPER, ascii_lower, cut, text_key

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BEGINNINGS = (4, 5, 6)
WHOLE = "$"

GRADES = 3
# A row of two toxic words in a long text is near this expected grade.
REJECTED = 0.35
ROWS_PER_CLASS = 3_000
SAMPLE_PARTS = 32
FEATURES = 512
LEAST_DOCUMENTS = 5
# What chance alone reaches about once among a million features.
LEAST_RATIO = 25.0
STEPS = 600
RATE = 0.1
PENALTY = 1e-5


@dataclass
class Model:
    """Feature numbers, their weights, and the ordered thresholds."""

    features: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def severity(self, found: Counter) -> float:
        total = sum(self.weights[f] * np.log1p(n) for f, n in found.items())
        return float(np.sum(1 / (1 + np.exp(np.clip(self.thresholds - total, -50, 50)))))


def features_of(word: str) -> list[str]:
    return [word + WHOLE, *(word[:n] for n in BEGINNINGS if len(word) >= n)]


class Reader:
    """Counts the known features of texts."""

    def __init__(self, features: dict[str, int]):
        self.features = features
        # Words that begin otherwise hold no known feature.
        self.heads = {f.removesuffix(WHOLE)[: BEGINNINGS[0]] for f in features}
        self.words = re.compile(WORD)
        self.fold = str.maketrans(UPPER, LOWER)

    def count(self, text: str | None) -> Counter:
        """Occurrences per feature."""
        words = self.words.findall((text or "").translate(self.fold))
        found: Counter = Counter()
        head = BEGINNINGS[0]
        for word, times in Counter(w for w in words if w[:head] in self.heads).items():
            for feature in features_of(word):
                if feature in self.features:
                    found[self.features[feature]] += times
        return found


def labelled(labels: DataFrame, label: str) -> DataFrame:
    """doc_id and label of the rows outside the held-out fold."""
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    return (
        labels.where(~held_out)
        .where(F.col(label).isin(0, 1))
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("_label"))
    )


def likelihood_ratio(toxic: Column, clean: Column, all_toxic: int, all_clean: int) -> Column:
    """How far presence among toxic and clean documents is from independence."""
    share = (toxic + clean) / (all_toxic + all_clean)

    def part(seen: Column, of: int) -> Column:
        rate = seen / of
        return seen * F.log(F.greatest(rate, F.lit(1e-12)) / share) + (of - seen) * F.log(
            F.greatest(1 - rate, F.lit(1e-12)) / F.greatest(1 - share, F.lit(1e-12))
        )

    return 2 * (part(toxic, all_toxic) + part(clean, all_clean))


def chosen_features(sample: DataFrame, sizes: dict[int, int], most: int) -> list[str]:
    """The most telling features."""
    words = F.array_distinct(
        F.regexp_extract_all(ascii_lower(F.coalesce("text", F.lit(""))), F.lit(WORD), F.lit(0))
    )
    beginnings = [_beginnings(words, n) for n in BEGINNINGS]
    whole = F.transform(words, lambda w: F.concat(w, F.lit(WHOLE)))
    counted = (
        sample.select("_label", F.explode(F.array_distinct(F.concat(whole, *beginnings))).alias("feature"))
        .groupBy("feature")
        .agg(F.sum("_label").alias("toxic"), F.sum(1 - F.col("_label")).alias("clean"))
        .where(F.col("toxic") + F.col("clean") >= LEAST_DOCUMENTS)
    )
    rows = (
        counted.select(
            "feature",
            likelihood_ratio(F.col("toxic"), F.col("clean"), sizes[1], sizes[0]).alias("ratio"),
        )
        .where(F.col("ratio") >= LEAST_RATIO)
        .orderBy(F.col("ratio").desc(), "feature")
        .limit(most)
        .collect()
    )
    return [r["feature"] for r in rows]


def _beginnings(words: Column, length: int) -> Column:
    return F.transform(
        F.filter(words, lambda w: F.length(w) >= length), lambda w: F.substring(w, 1, length)
    )


def graded(labels: np.ndarray, scores: np.ndarray, grades: int) -> np.ndarray:
    """0 for clean rows; toxic ones by their rank in ``scores``, ties together."""
    result = np.zeros(len(labels), int)
    toxic = labels == 1
    if toxic.any():
        bounds = np.quantile(scores[toxic], np.arange(1, grades) / grades)
        result[toxic] = 1 + np.searchsorted(bounds, scores[toxic], side="left")
    return result


def cross_graded(
    x: np.ndarray, labels: np.ndarray, halves: np.ndarray, weights: np.ndarray, grades: int
) -> np.ndarray:
    """Grades of each half by a binary model of the other half's labels."""
    sides = [np.flatnonzero(halves == h) for h in (0, 1)]
    if any(len(np.unique(labels[side])) < 2 for side in sides):
        sides = [np.arange(len(labels))] * 2
    result = np.zeros(len(labels), int)
    for side, other in (sides, sides[::-1]):
        slopes, _ = fitted(x[other], labels[other], weights[other], 1)
        result[side] = graded(labels[side], x[side] @ slopes, grades)
    return result


def fitted(x: np.ndarray, y: np.ndarray, weights: np.ndarray, grades: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by Adam on the weighted ordinal log loss.

    Each threshold separates the grades above it from the others. Thresholds
    are the first one plus exponentials, so they stay in order.
    """
    above = y[:, None] > np.arange(grades)
    share = np.clip((weights[:, None] * above).sum(0) / weights.sum(), 1e-4, 1 - 1e-4)
    start = np.log(1 / share - 1)
    values = [np.zeros(x.shape[1]), start[:1].copy(), np.log(np.maximum(np.diff(start), 1e-3))]
    moments = [(np.zeros_like(v), np.zeros_like(v)) for v in values]
    scale = weights / weights.sum()
    for step in range(1, STEPS + 1):
        gaps = np.exp(values[2])
        thresholds = values[1] + np.concatenate([[0.0], np.cumsum(gaps)])
        chance = 1 / (1 + np.exp(np.clip(thresholds - (x @ values[0])[:, None], -50, 50)))
        slope = scale[:, None] * (chance - above)
        to_thresholds = -slope.sum(0)
        later = np.cumsum(to_thresholds[::-1])[::-1]
        gradients = [x.T @ slope.sum(1) + PENALTY * values[0], later[:1], later[1:] * gaps]
        for value, gradient, (first, second) in zip(values, gradients, moments, strict=True):
            first += 0.1 * (gradient - first)
            second += 0.001 * (gradient**2 - second)
            value -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return values[0], values[1] + np.concatenate([[0.0], np.cumsum(np.exp(values[2]))])


def trained(
    docs: DataFrame, labels: DataFrame, label: str, rows_per_class: int, most: int, grades: int
) -> Model | None:
    """The model, or None where the labels hold less than two classes."""
    known = labelled(labels, label)
    counts = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}
    if len(counts) < 2:
        return None
    hashed = F.xxhash64("doc_id")
    drawn = [known.where(F.col("_label") == c).orderBy(hashed, "doc_id").limit(rows_per_class) for c in (0, 1)]
    texts = docs.select("doc_id", "text", text_key(F.col("text")).alias("_text"))
    # One doc_id may have many texts, so the rows are bounded as well as the labels.
    keys = texts.select("doc_id", "_text").join(F.broadcast(drawn[0].union(drawn[1])), "doc_id").distinct()
    keys = [keys.where(F.col("_label") == c).orderBy(hashed, "doc_id", "_text").limit(rows_per_class) for c in (0, 1)]
    sample = cut(
        texts.join(F.broadcast(keys[0].union(keys[1])), ["doc_id", "_text"])
        .dropDuplicates(["doc_id", "_text"])
        .select("doc_id", "text", "_label")
        .repartition(SAMPLE_PARTS, "doc_id")
    )
    sizes = {r["_label"]: r["count"] for r in sample.groupBy("_label").count().collect()}
    if len(sizes) < 2:
        return None
    chosen = chosen_features(sample, sizes, most)
    features = {name: i for i, name in enumerate(chosen)}

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(features)
        for batch in batches:
            found = [reader.count(text) for text in batch["text"]]
            texts = [zlib.crc32((t or "").encode("utf-8", "replace")) for t in batch["text"]]
            at = np.repeat(np.arange(len(batch)), [1 + len(f) for f in found])
            # The row without a feature stands for the document itself.
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"].to_numpy()[at],
                    "_text": np.array(texts, np.int64)[at],
                    "_label": batch["_label"].to_numpy()[at],
                    "feature": [f for each in found for f in (-1, *each.keys())],
                    "times": [n for each in found for n in (0, *each.values())],
                }
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    listed = (
        sample.mapInPandas(counted, f"doc_id {kind}, _text long, _label int, feature int, times int")
        .dropDuplicates(["doc_id", "_text", "feature"])
        .toPandas()
    )
    # Rows in one order, whatever the order of the tasks.
    keys = ["doc_id", "_text"]
    rows = listed[listed["feature"] < 0].drop_duplicates(keys).sort_values(keys, ignore_index=True)
    rows["row"] = np.arange(len(rows))
    held = listed[listed["feature"] >= 0].drop_duplicates([*keys, "feature"])
    held = held.merge(rows[[*keys, "row"]], on=keys)
    x = np.zeros((len(rows), len(features)), np.float32)
    x[held["row"].to_numpy(), held["feature"].to_numpy()] = held["times"].to_numpy()
    given = rows["_label"].to_numpy()
    total = sum(counts.values())
    share = np.array([counts[c] / total * len(rows) / sizes[c] for c in (0, 1)])
    np.log1p(x, out=x)
    halves = np.array([zlib.crc32(f"half:{i}".encode()) % 2 for i in rows["doc_id"]], int)
    weights, thresholds = fitted(x, cross_graded(x, given, halves, share[given], grades), share[given], grades)
    return Model(features, weights, thresholds)


def severity_of(docs: DataFrame, model: Model | None) -> Column:
    if model is None:
        return F.lit(0.0)
    sent = docs.sparkSession.sparkContext.broadcast((model.features, model.weights, model.thresholds))

    @F.pandas_udf("double")
    def severity(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held = Model(*sent.value)
        reader = Reader(held.features)
        for texts in batches:
            yield pd.Series([held.severity(reader.count(text)) for text in texts], dtype=float)

    return severity(docs["text"])


def graded_documents(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    rejected: float = REJECTED,
    rows_per_class: int = ROWS_PER_CLASS,
    most: int = FEATURES,
    grades: int = GRADES,
) -> DataFrame:
    """doc_id, severity, the nearest grade, and whether the document is rejected."""
    model = trained(docs, labels, label, rows_per_class, most, grades)
    return docs.select("doc_id", severity_of(docs, model).alias("severity")).select(
        "doc_id",
        "severity",
        F.round("severity").cast("int").alias("grade"),
        (F.col("severity") >= rejected).alias("rejected"),
    )


def without_toxic(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    rejected: float = REJECTED,
    rows_per_class: int = ROWS_PER_CLASS,
    most: int = FEATURES,
    grades: int = GRADES,
) -> DataFrame:
    """The documents whose severity stays below the limit."""
    model = trained(docs, labels, label, rows_per_class, most, grades)
    return docs.where(severity_of(docs, model) < rejected)
