"""Quality classifier: naive Bayes support vectors.

A document's features are indicators of n-grams: its words (lower case), and
runs of one to three word shapes, each with the share of the text it makes up
(1/2, 1/8, 1/32 or any).  A shape keeps letter case and symbols and
says whether the word repeats the one before.  Indicators are scaled by the
log-count ratio of the two classes, and a linear hinge-loss model on them is
fitted by dual coordinate descent.  A logistic curve over the margins of the
fitted rows gives the score.

The model is fitted on at most ``SAMPLE`` labelled rows of each class, those
with the lowest hash of their id; all documents are scored, whole.  Features
are hashed to ``BUCKETS``.

Null and empty texts have no features and get the score of the bias alone.
Rows without an id or a label don't teach; of several labels of an id the
largest counts.  If only one class has labels the score is that class, and
0.5 without any labels.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credo.llm.common import crc32_fold, give_back, held, text_or_empty

SAMPLE = 4000
BUCKETS = 1 << 18
FOLDS = 5
KEEP_FROM = 0.3
WORDS_KEPT = 300_000

RUNS = re.compile(r"(.)\1+", re.DOTALL)


def shape(word: str) -> str:
    kinds = "".join("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in word)
    return RUNS.sub(r"\1\1", kinds)[:12]


class Words(dict):
    """From a word to its hash, with 20 bits of its shape's hash in front."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        text = word.decode()
        value = (xxhash.xxh64_intdigest(shape(text)) & 0xFFFFF) << 43 | (xxhash.xxh64_intdigest(word.lower()) >> 21)
        if len(word) <= 64:
            self[word] = value
        return value


def words() -> Words:
    return held("shape words", Words)


def features(text: str | None) -> np.ndarray:
    """Sorted distinct features of a text, below ``BUCKETS``."""
    known = words()
    codes = np.array([known[w] for w in (text or "").encode().split()], dtype=np.int64)
    n = len(codes)
    if not n:
        return np.empty(0, dtype=np.int64)
    word = codes & ((1 << 43) - 1)
    kind = (codes >> 43) << 1
    kind[1:] |= word[1:] == word[:-1]
    found = [np.unique(word) * 4 + 3]
    gram = np.zeros(n, dtype=np.int64)
    for size in (1, 2, 3):
        gram = gram[:n - size + 1] * 1_000_003 + kind[size - 1:]
        if not len(gram):
            break
        grams, counts = np.unique(gram, return_counts=True)
        share = np.digitize(counts / n, (1 / 32, 1 / 8, 1 / 2))
        for least in range(4):
            found.append((grams[share >= least] * 16 + least * 4 + size - 1) * 31 + 7)
    mixed = np.concatenate(found).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return np.unique((mixed >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64))


def features_of(text: Column) -> Column:
    @F.pandas_udf("array<long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([features(t) for t in batch], dtype=object)
        give_back()

    return run(text)


class Model:
    """weights over ``BUCKETS``, bias, and the logistic curve (slope, offset)."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, offset: float):
        self.weights, self.bias, self.slope, self.offset = weights, bias, slope, offset

    def margin(self, found: np.ndarray) -> float:
        return float(self.weights[found].sum() / np.sqrt(max(len(found), 1)) + self.bias)

    def score(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(found) + self.offset, -500, 500))))


def fit(rows: list[np.ndarray], labels: np.ndarray, cost: float = 1.0, passes: int = 30, seed: int = 5) -> Model:
    """Log-count ratios, then dual coordinate descent for the hinge loss.

    A row is divided by the root of its number of indicators.  The classes
    weigh alike.  One more constant feature stands for the bias.
    """
    if len(set(labels.tolist())) < 2:
        only = float(labels[0]) if len(labels) else 0.5
        return Model(np.zeros(BUCKETS), 0.0, 0.0, (only - 0.5) * 1000)
    y = np.where(labels > 0, 1.0, -1.0)
    counts = {s: np.ones(BUCKETS) for s in (1.0, -1.0)}
    for x, s in zip(rows, y):
        counts[s][x] += 1
    ratio = np.log(counts[1.0] / counts[1.0].sum()) - np.log(counts[-1.0] / counts[-1.0].sum())
    values = [ratio[x] / np.sqrt(max(len(x), 1)) for x in rows]
    upper = np.where(y > 0, cost * len(y) / (2 * (y > 0).sum()), cost * len(y) / (2 * (y < 0).sum()))
    square = np.array([v @ v + 1.0 for v in values])
    weights, bias, alpha = np.zeros(BUCKETS), 0.0, np.zeros(len(y))
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        most = 0.0
        for i in rng.permutation(len(y)):
            x, v = rows[i], values[i]
            gradient = y[i] * (weights[x] @ v + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), upper[i])
            step = (new - alpha[i]) * y[i]
            if step:
                weights[x] += step * v
                bias += step
                alpha[i] = new
                most = max(most, abs(step))
        if most < 1e-3:
            break
    scaled = weights * ratio
    margins = np.array([weights[x] @ v + bias for x, v in zip(rows, values)])
    slope, offset = logistic(margins, labels)
    return Model(scaled, bias, slope, offset)


def logistic(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps on smoothed, evenly weighted targets."""
    good, bad = (labels > 0).sum(), (labels <= 0).sum()
    target = np.where(labels > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    share = np.where(labels > 0, 0.5 / good, 0.5 / bad)
    x = np.c_[margins, np.ones(len(margins))]
    at = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        gradient = x.T @ (share * (p - target)) + 1e-4 * at
        hessian = (x * (share * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        at -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(at[0]), float(at[1])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from ``labels`` (doc_id, quality) of rows outside the held-out fold."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("y"))
    known = known.filter("id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y"))
    known = known.filter(crc32_fold(F.col("id"), FOLDS) != 0)
    chosen = [known.filter(F.col("y") > 0 if good else F.col("y") <= 0).orderBy(F.xxhash64("id"), "id").limit(sample) for good in (True, False)]
    chosen = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most 2 * sample pairs of numbers
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), text_or_empty("text").alias("text")).join(chosen, "id")
    # an id may be in many rows; its first text counts
    texts = texts.groupBy("id", "y").agg(F.min("text").alias("text"))
    rows = texts.select("id", "y", features_of(F.col("text")).alias("x")).collect()
    rows.sort(key=lambda r: (r["id"], r["x"]))
    return fit([np.array(r["x"], dtype=np.int64) for r in rows], np.array([1 if r["y"] > 0 else 0 for r in rows]))


def score(text: Column, model: Model) -> Column:
    """Score of each text, 0 to 1; higher is likelier good."""
    shared = model

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([shared.score(features(t)) for t in batch], dtype="float64")
        give_back()

    return run(text)


def good_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rows that the classifier rejects."""
    return docs.filter(score(text_or_empty("text"), model) >= KEEP_FROM)
