"""Learnt recommenders: collaborative filtering, multiclass trees, pairwise and listwise rankers, a sequence net.

Each one ends in a ``scores`` array in catalogue order, the common input of lists,
fusion and the business layer.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest
from pyspark.ml.feature import StringIndexerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.functions import has_item, item_numbers, pseudo_random, top_k
from panelspark.operators import boosting, forest, network, trajectory
from panelspark.operators.boosting import BoostedTrees, Growth
from panelspark.operators.encode import Predictors, preprocess_stages, ready
from panelspark.operators.keys import dense_ids
from panelspark.operators.recommend import no_scores
from panelspark.operators.reshape import explode_adds, group_candidates
from panelspark.session import ensure_checkpoint_dir, materialize
from panelspark.spec import PanelSpec

SEED = 42
ALS_RANK = 16


# --- collaborative filtering -----------------------------------------------------------

INT_MAX = 2**31 - 1


@dataclass(frozen=True)
class Collaborative:
    """Fitted factors; ``ids`` maps entities to the model's whole numbers, or is null if they are such."""

    model: ALSModel
    ids: DataFrame | None = None

    @property
    def rank(self) -> int:
        return self.model.rank

    def user_vectors(self) -> DataFrame:
        """(entity, vector) of every entity the model saw."""
        users = self.model.userFactors.select(
            F.col("id").cast("long").alias("user"), F.col("features").cast("array<double>").alias("vector")
        )
        if self.ids is None:
            return users.withColumnRenamed("user", "entity")
        return users.join(self.ids, "user").select("entity", "vector")


def _fit_for_als(interactions: DataFrame) -> bool:
    """Whether the entity ids are whole numbers of 32 bits."""
    kind = interactions.schema["entity"].dataType
    if not isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return False
    low, high = interactions.agg(F.min("entity"), F.max("entity")).first()
    return low is None or (-INT_MAX <= low and high <= INT_MAX)


def fit_als(interactions: DataFrame, rank: int = ALS_RANK) -> Collaborative:
    """Implicit, nonnegative ALS on (entity, idx, rating).

    Text ids and numbers beyond 32 bits are numbered densely first, in their own order.
    """
    ensure_checkpoint_dir(interactions.sparkSession)
    als = ALS(
        userCol="entity", itemCol="idx", ratingCol="rating", implicitPrefs=True, nonnegative=True,
        rank=rank, maxIter=10, regParam=0.1, alpha=20.0, coldStartStrategy="drop", seed=SEED,
        checkpointInterval=5,
    )
    rated = interactions.withColumn("rating", F.col("rating").cast("float"))
    if _fit_for_als(interactions):
        return Collaborative(als.fit(rated))
    ids = materialize(dense_ids(interactions, "entity", "user"))
    numbered = rated.join(ids, "entity").select(F.col("user").alias("entity"), "idx", "rating")
    return Collaborative(als.fit(numbered), ids)


def _item_vectors(fitted: Collaborative) -> dict[int, list[float]]:
    """Item factors on the driver: one short vector per catalogue item."""
    return {r.id: [float(v) for v in r.features] for r in fitted.model.itemFactors.collect()}


def score_als(model: Collaborative, rows: DataFrame, spec: PanelSpec) -> DataFrame:
    """Factor products as a ``scores`` array; null for an entity the model never saw.

    The item factors are one small constant matrix, so each row multiplies its own vector
    and no (entity, item) rows are made.  An item without a vector scores 0.
    """
    items = _item_vectors(model)
    matrix = F.array(*[F.lit(items.get(i, [0.0] * model.rank)) for i in range(spec.n)])
    product = F.transform(
        matrix,
        lambda item: F.aggregate(
            F.zip_with(item, F.col("vector"), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v
        ),
    )
    return rows.join(model.user_vectors(), "entity", "left").withColumn(
        "scores", F.when(F.col("vector").isNotNull(), product)
    ).drop("vector")


def recommend_als(model: Collaborative, rows: DataFrame, spec: PanelSpec, k: int | None = None) -> DataFrame:
    """Best items by factor product, without held items and items the model never saw.

    An entity without a vector gets an empty list.
    """
    unseen = sum(1 << i for i in set(range(spec.n)) - set(_item_vectors(model)))
    excluded = F.col("prev_bits").bitwiseOR(F.lit(unseen).cast("long"))
    listed = top_k(F.col("scores"), excluded, k or spec.k)
    return score_als(model, rows, spec).withColumn(
        "recommended", F.coalesce(listed, F.array().cast("array<int>"))
    )


def user_factors(model: Collaborative, rank: int = ALS_RANK) -> DataFrame:
    """Latent vectors as columns, to be joined as predictors."""
    return model.user_vectors().select(
        "entity", *[F.get("vector", i).cast("float").alias(f"als_{i}") for i in range(rank)]
    )


def factor_names(rank: int = ALS_RANK) -> tuple[str, ...]:
    return tuple(f"als_{i}" for i in range(rank))


# --- multiclass models -----------------------------------------------------------------

@dataclass(frozen=True)
class Multiclass:
    """A fitted pipeline with what is needed to turn its output into scores."""

    model: PipelineModel
    predictors: Predictors
    kind: str
    trees: BoostedTrees | None = None


def fit_multiclass(
    train: DataFrame, predictors: Predictors, spec: PanelSpec, kind: str = "forest",
    trees: int = 80, depth: int = 8, parallelism: int = 4, bins: int = 64,
) -> Multiclass:
    """Which item is taken up, one train row per add; the class is the catalogue position.

    ``boosted`` grows one tree per item and round from joint softmax gradients, ``forest`` bootstrapped trees
    of all items; ``one_vs_rest`` fits a binary model per item instead.
    """
    ensure_checkpoint_dir(train.sparkSession)
    if kind == "one_vs_rest":
        one_item = GBTClassifier(
            maxIter=trees, maxDepth=depth, maxBins=256, stepSize=0.1, subsamplingRate=0.8, seed=SEED,
        )
        classifier = OneVsRest(
            classifier=one_item, featuresCol="features", labelCol="label", parallelism=parallelism
        )
    elif kind == "logistic":
        classifier = LogisticRegression(featuresCol="features", labelCol="label", regParam=0.001)
    elif kind not in ("boosted", "forest"):
        raise ValueError(f"unknown multiclass model: {kind}")
    inputs = (*predictors.numeric, *predictors.categorical, *predictors.extra)
    carried = ("entity", "period", *[c for c in inputs if c not in ("entity", "period")])
    adds = explode_adds(train, spec, keep=carried).withColumn("label", F.col("idx").cast("double"))
    if kind in ("boosted", "forest"):  # a row with all its adds, prepared as its adds are
        rows = train.filter(F.col("add_bits") != 0).select(*carried, item_numbers(F.col("add_bits"), spec.n).alias("labels"))
        prepared, vectors, width = _vectors(adds, predictors, "labels", rows=rows)
    if kind == "boosted":
        binning = boosting.fit_binning(vectors, "x", width, bins, F.size("labels"))
        rows = boosting.examples(vectors, binning, "x", F.col("labels"), outputs=spec.n)
        growth = Growth(rounds=trees, depth=depth, seed=SEED)
        fitted = boosting.boost(rows, binning, spec.n, boosting.softmax_gradients, growth)
        return Multiclass(prepared, predictors, kind, fitted)
    if kind == "forest":
        sizes = _category_sizes(prepared)
        binning = boosting.fit_binning(vectors, "x", width - len(sizes), 256, F.size("labels"))
        binning = boosting.Binning((*binning.cuts, *[tuple(float(i) for i in range(n - 1)) for n in sizes]))
        nominal = [i >= width - len(sizes) for i in range(width)]
        fitted = forest.fit_forest(vectors, binning, nominal, spec.n, forest.Growth(trees, depth, seed=SEED))
        return Multiclass(PipelineModel([*prepared.stages, forest.ForestScorer.of(fitted)]), predictors, kind)
    stages = preprocess_stages(predictors, with_one_hot=kind == "logistic")
    return Multiclass(Pipeline(stages=[*stages, classifier]).fit(ready(adds, predictors)), predictors, kind)


def _category_sizes(prepared: PipelineModel) -> list[int]:
    """Categories of the last columns of x, each with one for those unseen in train."""
    return [len(labels) + 1 for s in prepared.stages if isinstance(s, StringIndexerModel) for labels in s.labelsArray]


def _vectors(learnt: DataFrame, predictors: Predictors, *keep: str, rows: DataFrame | None = None) -> tuple[PipelineModel, DataFrame, int]:
    """The preparation fitted on ``learnt``, (entity, period, keep, x) of ``rows`` written once, and the length of x."""
    prepared = Pipeline(stages=preprocess_stages(predictors)).fit(ready(learnt, predictors))
    width = len(prepared.stages[-1].getInputCols())
    made = prepared.transform(ready(learnt if rows is None else rows, predictors))
    return prepared, materialize(made.select("entity", "period", *keep, vector_to_array("features").alias("x"))), width


def _aligned(values: Column, spec: PanelSpec) -> Column:
    """Pad to the catalogue: items never taken up in train are classes the model lacks."""
    padded = F.concat(values, F.array_repeat(F.lit(0.0), spec.n))
    return F.slice(padded, 1, spec.n)


def score_multiclass(fitted: Multiclass, rows: DataFrame, spec: PanelSpec) -> DataFrame:
    """Rows with their ``scores``; margins of binary models become probabilities per item."""
    scored = fitted.model.transform(ready(rows, fitted.predictors))
    if fitted.kind == "boosted":
        vectors = scored.select(*rows.columns, vector_to_array("features").alias("x"))
        return boosting.class_scores(fitted.trees, vectors, "x").drop("x")
    if fitted.kind == "one_vs_rest":
        margins = vector_to_array("rawPrediction")
        values = F.transform(margins, lambda m: F.lit(1.0) / (F.lit(1.0) + F.exp(-2.0 * m)))
    elif fitted.kind == "forest":
        values = F.col(forest.SHARES)
    else:
        values = vector_to_array("probability")
    return scored.select(*rows.columns, _aligned(values, spec).alias("scores"))


# --- pairwise ranker -------------------------------------------------------------------

@dataclass(frozen=True)
class PairwiseRanker:
    """One weight row per item over the row's context; score = weights . context."""

    weights: list[list[float]]
    context: tuple[str, ...]


def _context(columns: tuple[str, ...]) -> Column:
    """1 and the context columns, squeezed so that counts of any size stay comparable."""
    squeezed = [F.log1p(F.greatest(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))) for c in columns]
    return F.array(F.lit(1.0), *squeezed)


def preference_pairs(features: DataFrame, spec: PanelSpec, negatives: int = 6) -> DataFrame:
    """(better, worse) item pairs of rows with adds.

    Each sampled open item is set against one add, in turn, so a row yields at most
    ``negatives`` pairs whatever its number of adds.
    """
    idle = F.bitwise_not(F.col("prev_bits").bitwiseOR(F.col("add_bits")))
    drawn = F.array_sort(
        F.transform(
            item_numbers(idle, spec.n),
            lambda i: F.struct(pseudo_random(F.col("entity"), F.col("period"), i).alias("r"), i.alias("i")),
        )
    )
    prepared = features.filter(F.col("add_bits") != 0).select(
        "*", F.inline(F.array(F.struct(item_numbers(F.col("add_bits"), spec.n).alias("adds"))))
    )
    pairs = F.transform(
        F.slice(drawn, 1, negatives),
        lambda x, j: F.struct(
            F.get(F.col("adds"), F.pmod(j, F.size("adds"))).alias("better"), x["i"].alias("worse")
        ),
    )
    return prepared.select("*", F.inline(pairs)).drop("adds")


def fit_ranker(
    features: DataFrame, spec: PanelSpec, context: tuple[str, ...] = ("n_prev", "history", "adds_recent"),
    negatives: int = 6,
) -> PairwiseRanker:
    """Logistic regression without intercept on the difference of the two candidates' inputs.

    A candidate's inputs are its item crossed with the context, so the difference is the
    context under the better item minus the context under the worse one.  Every second
    pair is turned round to give both classes.
    """
    pairs = preference_pairs(features, spec, negatives).select(
        "better", "worse", F.inline(F.array(F.struct(_context(context).alias("x")))),
        F.pmod(pseudo_random(F.col("entity"), F.col("period"), F.col("worse")), F.lit(2)).cast("double").alias("label"),
    )
    side = F.when(F.col("label") == 1, F.lit(1.0)).otherwise(F.lit(-1.0))

    def block(i: Column) -> Column:
        sign = F.when(i == F.col("better"), side).when(i == F.col("worse"), -side).otherwise(F.lit(0.0))
        return F.transform("x", lambda v: v * sign)

    difference = F.flatten(F.transform(F.lit(list(range(spec.n))), block))
    train = pairs.select(array_to_vector(difference).alias("features"), "label")
    fitted = LogisticRegression(fitIntercept=False, standardization=False, regParam=0.001, maxIter=50).fit(train)
    flat = [float(v) for v in fitted.coefficients.toArray()]
    width = len(context) + 1
    return PairwiseRanker([flat[i * width : (i + 1) * width] for i in range(spec.n)], context)


def score_ranker(ranker: PairwiseRanker, rows: DataFrame) -> DataFrame:
    """Scores for the whole catalogue from one small constant matrix; no row per candidate."""
    matrix = F.array(*[F.array(*[F.lit(v) for v in row]) for row in ranker.weights])
    held = rows.select("*", F.inline(F.array(F.struct(_context(ranker.context).alias("x")))))
    scores = F.transform(
        matrix,
        lambda w: F.aggregate(F.zip_with(w, F.col("x"), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v),
    )
    return held.withColumn("scores", scores).drop("x")


# --- listwise ranker -------------------------------------------------------------------

@dataclass(frozen=True)
class ListwiseRanker:
    """Boosted trees over (row, candidate item), the item being one more predictor."""

    model: PipelineModel
    predictors: Predictors
    trees: BoostedTrees


def ranking_lists(rows: DataFrame, spec: PanelSpec, negatives: int, *keep: str) -> DataFrame:
    """Rows with adds, their candidates in catalogue order (``items``) and 0/1 ``labels``."""
    items = F.array_sort(group_candidates(spec, negatives))
    listed = rows.filter(F.col("add_bits") != 0).select(*keep, "add_bits", items.alias("items"))
    return listed.withColumn("labels", F.transform("items", lambda i: has_item(F.col("add_bits"), i))).drop("add_bits")


def fit_listwise(
    train: DataFrame, predictors: Predictors, spec: PanelSpec, negatives: int | None = None,
    trees: int = 100, depth: int = 8, bins: int = 64, least: float = 1.0,
) -> ListwiseRanker:
    """Trees that follow the NDCG-weighted pair gradients of each row's candidates."""
    rows = train.filter(F.col("add_bits") != 0)
    prepared, vectors, width = _vectors(rows, predictors, "prev_bits", "add_bits")
    binning = boosting.fit_binning(vectors, "x", width, bins)
    lists = ranking_lists(vectors, spec, spec.negatives if negatives is None else negatives, "entity", "period", "x")
    packed = boosting.examples(lists, binning, "x", F.col("labels"), F.col("items"))
    growth = Growth(rounds=trees, depth=depth, least=least, seed=SEED)
    fitted = boosting.boost(packed, binning, 1, boosting.ndcg_gradients, growth, items=spec.n)
    return ListwiseRanker(prepared, predictors, fitted)


def score_listwise(ranker: ListwiseRanker, rows: DataFrame, spec: PanelSpec) -> DataFrame:
    """Scores for the whole catalogue; no row per candidate leaves a task."""
    made = ranker.model.transform(ready(rows, ranker.predictors))
    vectors = made.select(*rows.columns, vector_to_array("features").alias("x"))
    return boosting.candidate_scores(ranker.trees, vectors, "x", range(spec.n)).drop("x")


# --- sequence model --------------------------------------------------------------------

@dataclass(frozen=True)
class SequenceModel:
    weights: np.ndarray
    shape: network.Shape
    static: tuple[str, ...]


def sequence_inputs(features: DataFrame, spec: PanelSpec, length: int) -> DataFrame:
    """Rows with their padded trajectory as item sets, three a step; the windows run over the whole table."""
    trimmed = trajectory.trim_trajectory(trajectory.trajectories(features, length), length)
    sets = F.flatten(F.transform("steps", lambda s: F.array(s["prev_bits"], s["add_bits"], s["drop_bits"])))
    return trimmed.withColumn("sequence", sets).drop("steps")


def fit_sequence(
    train: DataFrame, spec: PanelSpec, length: int, static: tuple[str, ...] = ("n_prev", "history"),
    hidden: int = 64, iterations: int = 60,
) -> SequenceModel:
    """Feed-forward net over the trajectory and standardised static columns.

    ``train`` comes from ``sequence_inputs``.  Every (entity, period) row is an example, so
    the adds at each step of a trajectory are already targets of its earlier rows.
    """
    shape = network.Shape(length, spec.n, len(static), hidden)
    return SequenceModel(network.fit_net(train, "sequence", static, "add_bits", shape, iterations, SEED), shape, static)


def score_sequence(fitted: SequenceModel, rows: DataFrame, spec: PanelSpec) -> DataFrame:
    return network.net_scores(rows, fitted.weights, "sequence", fitted.static, fitted.shape)


# --- several models side by side -------------------------------------------------------

def side_by_side(rows: DataFrame, spec: PanelSpec, scorers: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Rows with ``scores_<name>`` of every model, the input of fusion and routing.

    A scorer returns its rows with ``scores``; a row that a model knows nothing about ranks in
    catalogue order.  The models add columns, so nothing is joined or multiplied.
    """
    for name, score in scorers.items():
        made = score(rows)
        rows = made.select(*rows.columns, F.coalesce("scores", no_scores(spec)).alias(f"scores_{name}"))
    return rows
