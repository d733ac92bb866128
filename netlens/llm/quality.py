"""Quality classifier: naive Bayes support vectors.

A text's features are indicators of hashed character trigrams and of n-grams of one to four word
shapes (case, kind of last character, length, repetition of the word before). Each indicator is
scaled by the log-count ratio of the two classes, rows are brought to length one, and a linear
hinge-loss model is fitted by dual coordinate descent. The margin becomes a probability by a
logistic curve fitted on the same bounded sample, weighted back to the true class shares.

The model has a fixed number of bins and is broadcast. A null or empty text has no feature and
gets the score of the bare intercept. With no labelled row of one of the classes, the score is
the share of the class there is, or one half.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.llm.common import bounded_sample, map_batches, one_label, release

BINS = 1 << 16
SHAPES = (1, 2, 3, 4)
#: Labelled documents of each class that fitting reads at most.
SAMPLE_ROWS = 1_500
#: Word shapes that a task remembers.
MEMO_WORDS = 200_000
MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint32)


def shape(word: str) -> int:
    """Case, last character and length of a word as one number below 512, never odd."""
    cased = [c for c in word if c.isalpha()]
    if not cased:
        case = 0
    elif word.islower():
        case = 1
    elif word.isupper():
        case = 2 if len(cased) > 1 else 3
    else:
        case = 3 if word[:1].isupper() and word[1:].islower() else 4
    last = word[-1]
    kind = 0 if last.isalpha() else 1 if last.isdigit() else 2 + min(5, ".,;:?".find(last) + 1)
    if kind == 2 and len(word) > 1 and word[-2] == last:
        kind = 9
    return 2 * (case + 5 * (kind + 10 * min(4, len(word) // 4)))


class Features:
    """Sorted bins of a text's indicators."""

    def __init__(self):
        self.memo: dict[str, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        text = text or ""
        memo = self.memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        shapes, before = [], None
        for word in text.split():
            s = memo.get(word)
            if s is None:
                s = memo[word] = shape(word)
            shapes.append(s + 1 if word == before else s)
            before = word
        found = [self._grams(np.asarray(shapes, dtype=np.uint32), SHAPES, 7)]
        found.append(self._grams(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), (3,), 3))
        return np.unique(np.concatenate(found))

    @staticmethod
    def _grams(values: np.ndarray, lengths: tuple[int, ...], seed: int) -> np.ndarray:
        found = [np.zeros(0, dtype=np.uint32)]
        for n in lengths:
            m = len(values) - n + 1
            if m > 0:
                h = np.full(m, seed * 16 + n, dtype=np.uint32)
                for i in range(n):
                    h = (h ^ values[i : i + m]) * MULTIPLIERS[i]
                    h ^= h >> np.uint32(13)
                found.append(h & np.uint32(BINS - 1))
        return np.concatenate(found)


@dataclass(frozen=True)
class LinearModel:
    weights: np.ndarray  # by bin: the model's weight times the log-count ratio
    ratio2: np.ndarray  # squared log-count ratio, for the length of a row
    bias: float
    slope: float
    intercept: float

    def score(self, rows: np.ndarray) -> float:
        norm = np.sqrt(self.ratio2[rows].sum()) or 1.0
        margin = self.weights[rows].sum() / norm + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.intercept, -40, 40))))


def constant(p: float) -> LinearModel:
    """The model that gives every text the same score."""
    return LinearModel(np.zeros(BINS), np.ones(BINS), 0.0, 0.0, float(np.log(p / (1 - p))))


def dual_coordinate_descent(
    rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, bins: int, cost: np.ndarray, epochs: int = 15
) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear hinge-loss model; y is 1 or -1, cost the bound of each dual variable."""
    w, bias = np.zeros(bins), 0.0
    alpha = np.zeros(len(rows))
    norms = np.array([float(v @ v) + 1.0 for v in values])
    order = np.random.default_rng(11)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            slack = y[i] * (w[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - slack / norms[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[rows[i]] += step * values[i]
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-4:
            break
    return w, bias


def logistic_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope and intercept by Newton's method, lightly held to a slope of 2."""
    a, b = 2.0, 0.0
    target = np.where(y > 0, 1 - 1 / ((y > 0).sum() + 2), 1 / ((y < 0).sum() + 2))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g, h = weight * (p - target), weight * p * (1 - p)
        grad = np.array([g @ x + 1e-2 * (a - 2), g.sum()])
        hess = np.array([[h @ (x * x) + 1e-2, h @ x], [h @ x, h.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -1, 1))
    return a, b


def train(rows: list[np.ndarray], labels: np.ndarray, share: float, smoothing: float = 1.0) -> LinearModel:
    """Fit on the features of a sample; ``share`` is the share of label 1 among all labelled rows."""
    y = np.where(labels == 1, 1.0, -1.0)
    ones, zeros = np.full(BINS, smoothing), np.full(BINS, smoothing)
    for r, label in zip(rows, y, strict=True):
        (ones if label > 0 else zeros)[r] += 1
    ratio = np.log(ones / ones.sum()) - np.log(zeros / zeros.sum())
    values = []
    for r in rows:
        v = ratio[r]
        values.append(v / (np.sqrt(v @ v) or 1.0))
    fair = np.where(y > 0, share / max((y > 0).mean(), 1e-9), (1 - share) / max((y < 0).mean(), 1e-9))
    w, bias = dual_coordinate_descent(rows, values, y, BINS, np.full(len(rows), 1.0))
    margins = np.array([w[r] @ v + bias for r, v in zip(rows, values, strict=True)])
    slope, intercept = logistic_curve(margins, y, fair)
    return LinearModel(w * ratio, ratio * ratio, bias, slope, intercept)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> LinearModel:
    """Learn from ``docs`` (doc_id, text) and ``labels`` (doc_id, label 0 or 1).

    At most ``sample_rows`` labelled documents of each class are used; they are spread by a hash
    of the id. The bounded sample is fitted by one task.
    """
    known = one_label(labels)
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(counts) < 2:
        return constant(0.99 if 1 in counts else 0.01 if counts else 0.5)
    share = counts[1] / sum(counts.values())
    chosen = bounded_sample(known, "label", sample_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def start():
        features = Features()

        def step(batch: dict) -> dict:
            return {"label": batch["label"], "bins": [features(t).astype(np.int32) for t in batch["text"]]}

        return step

    def learn(sample: pd.DataFrame) -> pd.DataFrame:
        m = train([np.asarray(b) for b in sample["bins"]], sample["label"].to_numpy(), share)
        release()
        return pd.DataFrame({"weights": [m.weights], "ratio2": [m.ratio2], "bias": [m.bias], "slope": [m.slope], "intercept": [m.intercept]})

    found = map_batches(rows, "label int, bins array<int>", start).where("size(bins) > 0")
    model = found.withColumn("model", F.lit(0)).groupBy("model").applyInPandas(
        learn, "weights array<double>, ratio2 array<double>, bias double, slope double, intercept double"
    )
    got = model.toPandas()
    if not len(got):
        return constant(0.5)
    r = got.iloc[0]
    return LinearModel(np.asarray(r["weights"]), np.asarray(r["ratio2"]), r["bias"], r["slope"], r["intercept"])


def score(docs: DataFrame, model: LinearModel) -> DataFrame:
    """One row per document: doc_id, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        model, features = shared.value, Features()

        def step(batch: dict) -> dict:
            return {"doc_id": batch["doc_id"], "score": [model.score(features(t)) for t in batch["text"]]}

        return step

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id long, score double", start)


def keep_good(docs: DataFrame, model: LinearModel, least: float) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose score is at least ``least``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        features = Features()
        return pd.Series([shared.value.score(features(t)) for t in texts], dtype=float)

    return docs.where(scored(F.col("text")) >= least)
