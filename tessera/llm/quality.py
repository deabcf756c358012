"""Quality classifier by Bradley-Terry pairwise ranking.

Labelled documents give preference pairs (a good one over a bad one). The probability that the good
one wins is the logistic function of the difference of their scores, a score being linear in surface
features of the text, so fitting is logistic regression on feature differences. A quantile of the
training scores then becomes the threshold, and scores are mapped to 0..1 around it.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

#: Labelled documents that the fit reads at most, the smallest by a hash of their id.
MAX_LABELLED = 20_000
#: Preference pairs that the fit draws at most from those documents.
MAX_PAIRS = 60_000
#: A document is kept from this score on.
ACCEPT = 0.3

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_MARKS = [ord(c) for c in "!|#$%&*<>{}=_~^\\/@+"]
_RATES = np.array([1.0, 10.0, 100.0])


def _raw(text: str | None) -> list[float]:
    """Shares between 0 and 1 that describe the surface of one whole text, then its length."""
    b = text.encode("utf-8", "surrogatepass") if text else b""
    if not b:
        return [0.0] * 15
    n = len(b)
    counts = np.bincount(np.frombuffer(b, np.uint8), minlength=256)
    words = b.split()
    nw = max(1, len(words))
    lines = b.split(b"\n")
    again = sum(map(bytes.__eq__, words, words[1:]))
    counted = Counter(words)
    letters = int(counts[_LETTER].sum())
    marks = int(counts[_MARKS].sum())
    return [
        int(counts[65:91].sum()) / n,
        int(counts[48:58].sum()) / n,
        int(counts[33]) / n,
        int(counts[124]) / n,
        marks / n,
        (n - letters - marks - int(counts[[9, 10, 13, 32]].sum())) / n,
        int(counts[[46, 44]].sum()) / nw if nw > 1 else 0.0,
        int(counts[[10, 13]].sum()) / n,
        again / nw,
        1.0 - len(counted) / nw,
        max(counted.values(), default=0) / nw,
        1.0 - len(set(lines)) / len(lines),
        sum(len(w) > 24 for w in words) / nw,
        min(1.0, letters / nw / 20),
        float(np.log1p(nw)) / 12,
    ]


def features(texts: list[str | None]) -> np.ndarray:
    """One row per text: each share, and how it saturates, so that a trace of junk already shows."""
    raw = np.array([_raw(t) for t in texts], float).reshape(len(texts), 15)
    return np.concatenate([raw, *(np.log1p(raw * r * 10) for r in _RATES), raw[:, -1:] * raw], axis=1)


@dataclass(frozen=True)
class Ranking:
    """A fitted ranking: standardisation, weights, threshold on the linear score, its slope."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float

    def linear(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights

    def score(self, texts: list[str | None]) -> np.ndarray:
        """0 to 1; the threshold maps to ACCEPT."""
        if not len(texts):
            return np.zeros(0)
        z = self.slope * (self.linear(features(texts)) - self.threshold) + np.log(ACCEPT / (1 - ACCEPT))
        return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def _fit_pairs(diff: np.ndarray, ridge: float = 1e-3, rounds: int = 25) -> np.ndarray:
    """Newton steps on the mean logistic loss of feature differences (winner minus loser)."""
    w = np.zeros(diff.shape[1])
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(np.clip(diff @ w, -40, 40)))
        grad = -(diff * p[:, None]).mean(0) + ridge * w
        curve = (diff * (p * (1 - p))[:, None]).T @ diff / len(diff) + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(x: np.ndarray, good: np.ndarray, seed: int = 11, max_pairs: int = MAX_PAIRS) -> Ranking | None:
    """A ranking learned from at most ``max_pairs`` preference pairs, drawn from the labelled rows given; None where
    the labels hold only one class (there are no pairs to learn from)."""
    win, lose = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(win) or not len(lose):
        return None
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = (x - mean) / scale
    rng = np.random.default_rng(seed)
    n = min(max_pairs, 20 * len(x))
    w = _fit_pairs(z[rng.choice(win, n)] - z[rng.choice(lose, n)])
    s = z @ w
    # the quantile of all training scores at which both classes fare best on average
    cuts = np.quantile(s, np.linspace(0.0001, 0.9999, 9999))
    kept = 1 - np.searchsorted(np.sort(s[win]), cuts) / len(win)
    dropped = np.searchsorted(np.sort(s[lose]), cuts) / len(lose)
    best = np.flatnonzero(kept + dropped >= (kept + dropped).max() - 1e-12)
    cut = float(cuts[best[len(best) // 2]])
    spread = float(np.median(s[win]) - np.median(s[lose]))
    return Ranking(mean, scale, w, cut, 8.0 / max(spread, 1e-6))


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Ranking | None:
    """Fit on labelled documents that are not held out.

    At most ``max_labelled`` label rows are read, those with the smallest hash of their id; so few ids
    are safe to broadcast. Ids with contradicting labels, null ids and null labels are left out.
    """
    small_batches(docs.sparkSession)
    usable = (
        labels.where(F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("lo"), F.max("quality").alias("hi"))
        .where("lo = hi")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_labelled)
        .select("doc_id", (F.col("lo") == 1).alias("good"))
    )

    @F.pandas_udf("array<double>")
    def vector(texts: pd.Series) -> pd.Series:
        return pd.Series(list(features(list(texts))))

    joined = docs.select("doc_id", "text").join(F.broadcast(usable), "doc_id")
    # one text for each label, should an id repeat
    rows = joined.groupBy("doc_id", "good").agg(F.min("text").alias("text")).select("doc_id", "good", vector("text").alias("x"))
    got = sorted(map(tuple, rows.collect()))
    if not got:
        return None
    return fit(np.array([r[2] for r in got]), np.array([r[1] for r in got], bool))


def score_column(text: Column, model: Ranking | None) -> Column:
    """Score of a whole text; null and empty texts score as an empty text; without a model all score 1."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(np.ones(len(texts)) if model is None else model.score(list(texts)), dtype="float64")

    return score(text)


def classify(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """One row per document (repeats included): doc_id, held_out, score, predicted.

    Scoring is one pass without a shuffle. A null doc_id is not held out. Empty labels accept all.
    Extra columns of either table are ignored.
    """
    small_batches(docs.sparkSession)
    model = train(docs, labels, max_labelled)
    scored = docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), score_column(F.col("text"), model).alias("score"))
    return scored.select("*", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def accept(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``docs`` that score at least ACCEPT, as they are; see ``classify``."""
    small_batches(docs.sparkSession)
    return docs.where(score_column(F.col("text"), train(docs, labels, max_labelled)) >= ACCEPT)


def op3_bradley_terry_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns of the quality classifier over all documents."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
