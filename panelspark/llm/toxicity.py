"""Toxicity by non-negative positive-unlabelled learning.

Positives are confirmed toxic documents, the rest is unlabelled text. The risk of the
unlabelled part taken as negative is corrected by the class prior and held non-negative:
``prior * E_P[l(z)] + max(0, E_U[l(-z)] - prior * E_P[l(-z)])``. Features are words and word
beginnings of the whole text, chosen by document counts in the sample.

Defined results: a null text counts as empty; every input row gives one output row;
without a confirmed toxic document nothing is predicted toxic; a column named like a result
is replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm.common import Bounded, fold, forget_caches, hash_sample, saved, with_columns

POSITIVE_ROWS = 4_000  # confirmed toxic documents that a fit reads at most
UNLABELLED_ROWS = 12_000  # unlabelled documents that a fit reads at most
FEATURES = 800
CUT = 0.7
LETTERS = r"[^\W\d_]+"


def parts_of(word: str) -> list[str]:
    """The word itself (closed by $) and its beginnings of 3, 4 and 5 letters."""
    return [f"{word}$", *{word[:k] for k in (3, 4, 5) if len(word) >= k}]


@dataclass(frozen=True)
class ToxicModel:
    features: tuple[str, ...]
    weights: np.ndarray
    bias: float

    def scorer(self):
        """A function from texts to scores; its word cache lives as long as the task."""
        place = {f: i for i, f in enumerate(self.features)}
        hits = Bounded(lambda w: [place[p] for p in parts_of(w) if p in place], 150_000)
        words, weights, bias = re.compile(LETTERS).findall, self.weights, self.bias

        def scores(texts):
            out = np.empty(len(texts))
            for at, text in enumerate(texts):
                found: Counter = Counter()
                for word, n in Counter(words((text or "").lower())).items():
                    for i in hits[word]:
                        found[i] += n
                keys = np.fromiter(found, int, len(found))
                counts = np.fromiter(found.values(), float, len(found))
                out[at] = bias + (weights[keys] * np.log1p(counts)).sum()
            return 1 / (1 + np.exp(-np.clip(out + np.log(CUT / (1 - CUT)), -30, 30)))

        return scores


def fit_nnpu(
    positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 600, rate: float = 0.02, decay: float = 1e-4
) -> tuple[np.ndarray, float]:
    """Adam on the non-negative risk with the sigmoid loss; seeded, so equal input gives equal weights."""
    width = positive.shape[1]
    w, draw = np.zeros(width + 1), np.random.default_rng(11)
    w[-1] = -1.0
    middle = unlabelled.mean(0)  # features are centred, else their weights all sink at first
    first, second, step = np.zeros(width + 1), np.zeros(width + 1), 0

    def slope(x: np.ndarray, sign: int) -> tuple[float, np.ndarray]:
        """Mean of sigmoid(-sign * z) and its gradient."""
        loss = 1 / (1 + np.exp(np.clip(sign * (x @ w[:-1].astype(x.dtype) - middle @ w[:-1] + w[-1]), -30, 30)))
        d = -sign * loss * (1 - loss) / len(x)
        return loss.mean(), np.append(d.astype(x.dtype) @ x - d.sum() * middle, d.sum())

    batches = max(1, len(unlabelled) // 1000)
    for _ in range(-(-steps // batches)):
        for p, u in zip(
            np.array_split(draw.permutation(len(positive)), batches),
            np.array_split(draw.permutation(len(unlabelled)), batches), strict=True,
        ):
            if not len(p) or not len(u):
                continue
            _, gain = slope(positive[p], 1)
            as_negative, back = slope(positive[p], -1)
            rest, grad = slope(unlabelled[u], -1)
            # below zero the negative part is overfitted: step back along it
            full = prior * gain + grad - prior * back if rest >= prior * as_negative else prior * back - grad
            full[:-1] += decay * w[:-1]
            step += 1
            first, second = 0.9 * first + 0.1 * full, 0.999 * second + 0.001 * full**2
            w = w - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1] - middle @ w[:-1])


def learn_toxicity(docs: DataFrame, labels: DataFrame) -> ToxicModel:
    """Fit on bounded samples of the labelled positives and of docs; docs' labels stay unread."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    known = known.groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    prior = known.agg(F.avg("toxic")).first()[0] or 0.0
    positive = hash_sample(known.where("toxic = 1"), "doc_id", POSITIVE_ROWS)
    rest = hash_sample(docs.where("doc_id is not null").select("doc_id").distinct(), "doc_id", UNLABELLED_ROWS)
    picked = positive.withColumn("positive", F.lit(1)).unionByName(rest.withColumn("positive", F.lit(0)))
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # bounded by the two sizes
    find = re.compile(LETTERS).findall

    def per_batch(batch: pa.RecordBatch):
        forget_caches()
        texts = (t or "" for t in batch.column("text").to_pylist())
        return ([sorted({p for w in set(find(t.lower())) for p in parts_of(w)}) for t in texts],)

    sample = saved(with_columns(sample, {"parts": T.ArrayType(T.StringType())}, per_batch).drop("text"), "toxic-sample")
    size = {r["positive"]: r["n"] for r in sample.groupBy("positive").agg(F.count("*").alias("n")).collect()}
    n_pos, n_rest = size.get(1, 0), size.get(0, 0)
    if not n_pos or not n_rest:
        return ToxicModel((), np.zeros(0), -10.0)
    in_pos, in_rest = F.sum("positive"), F.sum(1 - F.col("positive"))
    lift = (F.col("p") / n_pos - F.col("u") / n_rest) / F.sqrt(F.col("u") / n_rest + F.lit(2.0) / n_rest)
    chosen = (
        sample.select("positive", F.explode("parts").alias("part"))
        .groupBy("part").agg(in_pos.alias("p"), in_rest.alias("u"))
        .where(F.col("p") >= 3)
        .orderBy(lift.desc(), "part").limit(FEATURES)
    )
    features = tuple(r["part"] for r in chosen.collect())
    slim = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    place = {f: i for i, f in enumerate(features)}

    def counted(batch: pa.RecordBatch):
        rows = []
        for t in batch.column("text").to_pylist():
            got = Counter(place[p] for w in find((t or "").lower()) for p in parts_of(w) if p in place)
            rows.append([x for pair in sorted(got.items()) for x in pair])
        return (rows,)

    rows = with_columns(slim, {"x": T.ArrayType(T.IntegerType())}, counted).select("positive", "x").collect()
    rows.sort(key=lambda r: (r["positive"], r["x"]))
    dense = np.zeros((len(rows), len(features)), dtype=np.float32)
    for at, r in enumerate(rows):
        dense[at, r["x"][::2]] = np.log1p(np.array(r["x"][1::2], dtype=float))
    is_pos = np.array([r["positive"] for r in rows]) == 1
    return ToxicModel(features, *fit_nnpu(dense[is_pos], dense[~is_pos], prior))


def with_toxicity(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """docs with ``score`` and ``predicted``; one pass, no shuffle."""
    made: list = []

    def per_batch(batch: pa.RecordBatch):
        if not made:
            forget_caches()
            made.append(model.scorer())
        score = made[0](batch.column("text").to_pylist())
        return score, (score >= CUT).astype("int32")

    return with_columns(docs, {"score": T.DoubleType(), "predicted": T.IntegerType()}, per_batch)


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """Learn outside fold ``held`` and score every row of docs."""
    inside = fold(F.col("doc_id"), folds) != held
    model = learn_toxicity(docs.where(inside), labels.where(inside))
    return with_toxicity(docs.select("doc_id", "text"), model).select(
        "doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), "score", "predicted"
    )


def without_toxic(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """Rows of docs that the model does not reject; columns stay as they are."""
    inside = fold(F.col("doc_id"), folds) != held
    model = learn_toxicity(docs.where(inside), labels.where(inside))
    mark = with_toxicity(docs.withColumn("__row", F.struct(*docs.columns)).select("__row", "text"), model)
    return mark.where(F.col("predicted") == 0).select("__row.*")
