"""Quality scores by Bradley-Terry ranking of preference pairs.

A document of label 1 beats one of label 0. The score w.x of a document's features is
learnt by logistic loss on the feature differences of such pairs, and the decision is a
threshold at a quantile of the scores. Features are shape statistics of the whole text.

Defined results: a null text counts as empty and gets a score as any other; every input row
gives one output row, repeated rows give equal rows; without labels of both classes all
scores are the cut itself; a column named like a result is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm.common import fold, hash_sample, with_columns

SAMPLE_ROWS = 20_000  # labelled rows that a fit reads at most
CUT = 0.3

UPPERS = bytes(range(65, 91))
LOWERS = bytes(range(97, 123))
DIGITS = bytes(range(48, 58))
MARKS = b"#$%&*@^~=+<>{}[]\\_|!?"


def shape(text: str | None) -> list[float]:
    """Lengths, character classes and repetition of a whole text."""
    raw = (text or "").encode("utf-8", "replace")
    size, words = len(raw), raw.split()
    n, lines = len(words), [x for x in raw.split(b"\n") if x.strip()]

    def share(chars: bytes) -> float:
        return (size - len(raw.translate(None, chars))) / max(size, 1)

    marks = [raw.count(m) / max(n, 1) for m in (b"|", b"!", b"#", b"$", b"%", b"&", b"*")]
    distinct = len(set(words))
    return [
        np.log1p(size), np.log1p(n), size / max(n, 1), share(UPPERS), share(LOWERS), share(DIGITS),
        share(MARKS), distinct / max(n, 1), np.log1p(distinct), sum(map(eq, words, words[1:])) / max(n, 1),
        len(set(lines)) / max(len(lines), 1), n / max(len(lines), 1) / 100, raw.count(b".") / max(n, 1),
        raw.count(b",") / max(n, 1), sum(map(bytes.isupper, words)) / max(n, 1), *marks,
    ]


def widened(x: np.ndarray) -> np.ndarray:
    """Each feature with its square root, so that a small share of noise already counts."""
    return np.hstack([x, np.sqrt(np.maximum(x, 0))])


@dataclass(frozen=True)
class Ranking:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    cut: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((widened(x) - self.mean) / self.spread) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        """In 0..1, increasing in the raw score, CUT at the chosen quantile."""
        z = np.clip(self.raw(x) - self.cut, -30, 30) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-z))


def fit_ranking(x: np.ndarray, label: np.ndarray, epochs: int = 60, rate: float = 0.03, decay: float = 1e-3) -> Ranking:
    """Logistic loss on differences of (label 1, label 0) pairs, drawn anew each epoch."""
    wide = widened(x) if len(x) else np.zeros((0, 2 * len(shape(""))))
    mean = wide.mean(0) if len(x) else np.zeros(wide.shape[1])
    spread = (wide.std(0) if len(x) else np.zeros(wide.shape[1])) + 1e-6
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return Ranking(mean, spread, np.zeros(wide.shape[1]), 0.0)
    unit, draw = (wide - mean) / spread, np.random.default_rng(7)
    w, first, second, step = np.zeros(wide.shape[1]), 0.0, 0.0, 0
    for _ in range(epochs):
        pairs = max(len(good), len(bad))
        left, right = draw.choice(good, pairs), draw.choice(bad, pairs)
        for at in range(0, pairs, 512):
            gap = unit[left[at : at + 512]] - unit[right[at : at + 512]]
            grad = -gap.T @ (1 / (1 + np.exp(np.clip(gap @ w, -30, 30)))) / len(gap) + decay * w
            step += 1
            first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
            w = w - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Ranking(mean, spread, w, quantile_cut(unit @ w, label))


def quantile_cut(raw: np.ndarray, label: np.ndarray) -> float:
    """The score quantile, in steps of 1/200, at which mean recall of the two classes is best."""
    cuts = np.quantile(raw, np.arange(1, 200) / 200)
    good, bad = np.sort(raw[label == 1]), np.sort(raw[label == 0])
    kept = 1 - np.searchsorted(good, cuts) / len(good)
    gone = np.searchsorted(bad, cuts) / len(bad)
    best = kept + gone
    return float(cuts[best >= best.max() - 1e-9].mean())


def with_quality(docs: DataFrame, ranking: Ranking) -> DataFrame:
    """docs with ``score`` and ``predicted``; one pass, no shuffle."""
    def per_batch(batch: pa.RecordBatch):
        texts = batch.column("text").to_pylist()
        score = ranking.scores(np.array([shape(t) for t in texts])) if texts else np.zeros(0)
        return score, (score >= CUT).astype("int32")

    return with_columns(docs, {"score": T.DoubleType(), "predicted": T.IntegerType()}, per_batch)


def learn_quality(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Ranking:
    """Fit on at most ``rows`` labelled documents; an id with several labels counts by majority."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    known = known.groupBy("doc_id").agg(F.avg("quality").alias("mean_label"))
    picked = F.broadcast(hash_sample(known, "doc_id", rows))  # bounded by ``rows``
    sample = docs.select("doc_id", "text").join(picked, "doc_id").join(known, "doc_id")
    sample = sample.select("text", (F.col("mean_label") >= 0.5).cast("int").alias("label"))

    def per_batch(batch: pa.RecordBatch):
        return ([shape(t) for t in batch.column("text").to_pylist()],)

    got = with_columns(sample, {"x": T.ArrayType(T.DoubleType())}, per_batch).select("label", "x").collect()
    width = len(shape(""))
    order = sorted(range(len(got)), key=lambda i: (got[i].label, got[i].x))
    return fit_ranking(
        np.array([got[i].x for i in order]).reshape(-1, width), np.array([got[i].label for i in order], dtype=int)
    )


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """Learn on the labels outside fold ``held`` and score every row of docs."""
    ranking = learn_quality(docs, labels.where(fold(F.col("doc_id"), folds) != held))
    slim = docs.select("doc_id", "text")
    return with_quality(slim, ranking).select(
        "doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), "score", "predicted"
    )
