"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, what is no letter becomes a space, and all n-grams of one to three
characters are hashed into a fixed number of bins. Fitting sums the bins of a bounded sample for
each language in Spark; the model, one log-probability for each language and bin, takes 64 kB a
language and is broadcast. Scoring gathers the rows of a whole batch at once and adds them up by
document.

A text that is null or has no letter is ``und`` with score 0. Equal scores give the language
first in the alphabet. Rows with a null language teach nothing, a repeated row teaches as often as
the sample has it. With no row to learn from, every text is ``und``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.llm.common import bounded_sample, fold_batches, map_batches

BINS = 1 << 14
LENGTHS = (1, 2, 3)
#: Documents of each language that fitting reads at most.
SAMPLE_ROWS = 3_000
UNKNOWN = "und"
# Odd multipliers of the hash, by position in the n-gram.
MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


def letters(text: str | None) -> np.ndarray:
    """Code points of the lower-cased text, padded by a space on either side; no letter, a space."""
    text = text or ""
    if text.isascii():
        points = np.frombuffer(text.lower().encode("ascii"), dtype=np.uint8)
        points = np.where((points >= 97) & (points <= 122), points, 32).astype(np.uint32)
    else:
        lower = text.lower()
        points = np.frombuffer(lower.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        alpha = ((points >= 97) & (points <= 122)) | (points >= 128)
        for other in np.unique(points[points >= 128]):
            if not chr(other).isalpha():
                alpha &= points != other
        points = np.where(alpha, points, np.uint32(32))
    return np.concatenate([[np.uint32(32)], points, [np.uint32(32)]]).astype(np.uint32)


def gram_bins(points: np.ndarray) -> np.ndarray:
    """Bins of all n-grams."""
    found = []
    for n in LENGTHS:
        if len(points) >= n:
            h = np.full(len(points) - n + 1, n, dtype=np.uint32)
            for i in range(n):
                h = (h ^ points[i : len(points) - n + 1 + i]) * MULTIPLIERS[i]
            found.append(h ^ (h >> np.uint32(15)))
    return np.concatenate(found) & np.uint32(BINS - 1)


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    log_prob: np.ndarray  # bins x languages
    log_prior: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        points = [letters(t) for t in texts]
        rows = [i for i, p in enumerate(points) if (p != 32).any()]
        if not rows or not self.languages:
            return names, scores
        bins = [gram_bins(points[i]) for i in rows]
        starts = np.cumsum([0, *[len(b) for b in bins[:-1]]])
        total = np.add.reduceat(self.log_prob[np.concatenate(bins)], starts, axis=0, dtype=np.float64) + self.log_prior
        best = total.argmax(axis=1)
        share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        for i, b, s in zip(rows, best, share, strict=True):
            names[i], scores[i] = self.languages[b], float(s)
        return names, scores


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, smoothing: float = 0.5) -> LanguageModel:
    """Learn from the rows of ``docs`` (doc_id, text, lang) whose language is known."""
    known = docs.select("doc_id", "lang").where("lang is not null and doc_id is not null")
    counts = known.groupBy("lang").count().collect()  # a row for each language
    languages = sorted(r["lang"] for r in counts)
    if not languages:
        return LanguageModel([], np.zeros((BINS, 0), np.float32), np.zeros(0))
    place = {v: i for i, v in enumerate(languages)}
    chosen = bounded_sample(known, "lang", sample_rows)
    rows = docs.select("doc_id", "text", "lang").join(chosen.distinct(), ["doc_id", "lang"], "left_semi")

    def start():
        sums = np.zeros((len(languages), BINS), dtype=np.int64)

        def take(batch: dict) -> None:
            for text, lang in zip(batch["text"], batch["lang"], strict=True):
                points = letters(text)
                if (points != 32).any():
                    sums[place[lang]] += np.bincount(gram_bins(points), minlength=BINS)

        def end() -> dict:
            lang, bin_ = np.nonzero(sums)
            return {"lang": lang, "bin": bin_, "n": sums[lang, bin_]}

        return take, end

    sums = fold_batches(rows, "lang int, bin int, n long", start).groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    found = sums.toPandas()  # languages x bins at most
    table = np.full((len(languages), BINS), smoothing)
    table[found["lang"], found["bin"]] += found["n"]
    log_prob = np.log(table / table.sum(axis=1, keepdims=True)).T.astype(np.float32)
    prior = np.array([dict(counts)[v] for v in languages], dtype=float)
    return LanguageModel(languages, np.ascontiguousarray(log_prob), np.log(prior / prior.sum()))


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """One row per document: doc_id, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        model = shared.value

        def step(batch: dict) -> dict:
            names, scores = [], []
            for i in range(0, len(batch["text"]), 50):
                n, s = model.predict(batch["text"][i : i + 50])
                names += n
                scores += s
            return {"doc_id": batch["doc_id"], "lang_pred": names, "score": scores}

        return step

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id long, lang_pred string, score double", start)
