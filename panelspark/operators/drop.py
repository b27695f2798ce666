"""Drop models, calibration, and the studies that question a model or a column."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.operators.calibration import apply_map, calibration_map, calibration_points, isotonic_blocks
from panelspark.operators.clean import median_of
from panelspark.operators.encode import Predictors, preprocess_stages, ready
from panelspark.operators.metrics import auc_by, cumulative_histogram, regression_error, roc_auc
from panelspark.operators.reshape import explode_held, explode_open, random_split
from panelspark.operators.split import rolling_windows
from panelspark.session import ensure_checkpoint_dir, materialize
from panelspark.spec import PanelSpec

SEED = 42

# fixed values: verdict limits of the leakage control and the missingness study
LEAK_AUC, LEAK_CLOSED, LEAK_PARTIAL = 0.995, 0.80, 0.40
MISSING_PREDICTABLE, MISSING_PARTLY = 0.70, 0.60
DRIFT_COST = 0.01  # fixed value: AUC loss from which refitting pays


def boosted_classifier(
    trees: int = 40, depth: int = 6, bins: int = 40, step: float = 0.1, subsample: float = 0.8
) -> GBTClassifier:
    return GBTClassifier(
        featuresCol="features", labelCol="label", maxIter=trees, maxDepth=depth, maxBins=bins,
        stepSize=step, subsamplingRate=subsample, seed=SEED, checkpointInterval=10,
    )


def fit_binary(train: DataFrame, predictors: Predictors, classifier: GBTClassifier, **stages) -> PipelineModel:
    ensure_checkpoint_dir(train.sparkSession)
    prepared = ready(train, predictors).withColumn("label", F.col("label").cast("double"))
    return Pipeline(stages=[*preprocess_stages(predictors, **stages), classifier]).fit(prepared)


def score_binary(model: PipelineModel, rows: DataFrame, predictors: Predictors, name: str = "p_raw") -> DataFrame:
    """Positive-class probability as a plain column; the input columns stay."""
    scored = model.transform(ready(rows, predictors))
    keep = [c for c in rows.columns]
    return scored.select(*keep, F.get(vector_to_array("probability"), 1).alias(name))


def fit_drop_model(train: DataFrame, predictors: Predictors, trees: int = 40, depth: int = 6) -> PipelineModel:
    """One binary model over (entity, period, held item) rows, item and tenure being inputs."""
    return fit_binary(train, predictors, boosted_classifier(trees, depth))


def calibrate(calibration: DataFrame, target: DataFrame, raw: str = "p_raw", out: str = "p") -> DataFrame:
    """Isotonic map from raw score to observed rate, fitted on t-1 and applied to t."""
    blocks = isotonic_blocks(calibration_points(calibration, raw))
    return apply_map(target, calibration_map(blocks), raw, out)


def auc_of(scored: DataFrame, score: str = "p_raw", label: str = "label") -> float | None:
    """Exact AUC as a number: one row reaches the driver."""
    return roc_auc(cumulative_histogram(scored, score, label)).first()["auc"]


def leakage_verdict(aucs: DataFrame) -> DataFrame:
    """(auc_clean, auc_leaked) rows with the share of the remaining error that the answer removes.

    The share and not the jump is judged: a clean model close to 1 leaves little to jump.
    """
    jump = F.col("auc_leaked") - F.col("auc_clean")
    remaining = 1.0 - F.col("auc_clean")
    closed = F.when(remaining > 1e-9, jump / remaining).otherwise(F.lit(0.0))
    verdict = (
        F.when((F.col("auc_leaked") > LEAK_AUC) | (closed > LEAK_CLOSED), "clean")
        .when(closed > LEAK_PARTIAL, "attention")
        .otherwise("review")
    )
    return aucs.withColumns({"jump": jump, "error_closed": closed, "verdict": verdict})


def leakage_control(
    features: DataFrame, panel: DataFrame, spec: PanelSpec, predictors: Predictors, measured: int,
    lookback: int = 4, trees: int = 20, depth: int = 5,
) -> DataFrame:
    """Negative control per item: the model must become near perfect once it is shown the answer.

    One model over (row, open item) with the item as a category, and a second one that also sees
    the item's current state, joined back from the panel.  If that does not close the
    remaining error, the features already knew it, or the control is broken.  An item of one class
    in the measured period has no verdict.
    """
    inputs = predictors.plus(categorical=("item",))
    kept = dict.fromkeys(("entity", "period", "prev_bits", "add_bits", *predictors.numeric, *predictors.categorical, *predictors.extra))
    wanted = features.filter(F.col("period").between(measured - lookback, measured))
    # the state is joined per row and read per item, so no (row, item) pair is shuffled
    rows = explode_open(wanted.select(*kept).join(panel.select("entity", "period", "held"), ["entity", "period"]), spec, keep=(*kept, "held"))
    rows = materialize(rows.withColumn("answer", F.getbit("held", F.col("idx")).cast("double")))
    train, test = rows.filter(F.col("period") < measured), rows.filter(F.col("period") == measured)
    scored = []
    for name, shown in (("auc_clean", inputs), ("auc_leaked", inputs.plus(extra=("answer",)))):
        model = fit_binary(train, shown, boosted_classifier(trees, depth, bins=256, subsample=1.0))
        made = score_binary(model, test, shown, "score").select("item", "label", "score")
        scored.append(made.withColumn("model", F.lit(name)))
    aucs = auc_by(scored[0].unionByName(scored[1]), ("item", "model"), "score", "label")
    both = aucs.groupBy("item").agg(
        *[F.max(F.when(F.col("model") == m, F.col("auc"))).alias(m) for m in ("auc_clean", "auc_leaked")],
        F.max("positives").alias("positives"), F.max("negatives").alias("negatives"),
    )
    known = F.col("auc_clean").isNotNull()
    judged = leakage_verdict(both)
    return judged.withColumns({c: F.when(known, F.col(c)) for c in ("jump", "error_closed", "verdict")})


def grouped_importance(model: PipelineModel, scored: DataFrame) -> DataFrame:
    """Tree importances summed per source column, through the vector's own metadata."""
    assembler = next(s for s in model.stages if isinstance(s, VectorAssembler))
    sources = sorted(assembler.getInputCols(), key=len, reverse=True)
    groups = scored.schema["features"].metadata.get("ml_attr", {}).get("attrs", {})
    weights = model.stages[-1].featureImportances
    totals: dict[str, float] = {}
    for attribute in (a for group in groups.values() for a in group):
        name = attribute["name"]
        source = next(c for c in sources if name == c or name.startswith(f"{c}_"))
        totals[source] = totals.get(source, 0.0) + float(weights[attribute["idx"]])
    return scored.sparkSession.createDataFrame(
        sorted(totals.items(), key=lambda kv: (-kv[1], kv[0])), "source string, importance double"
    )


def missingness_model(
    df: DataFrame, column: str, predictors: Predictors, trees: int = 30, depth: int = 5
) -> tuple[DataFrame, DataFrame]:
    """Can the missing flag be predicted?  One row with AUC and verdict, and the importances."""
    labelled = materialize(df.withColumn("label", F.col(column).isNull().cast("double")))
    train, test = random_split(labelled, 800, seed=SEED)
    options = dict(invalid="skip", with_one_hot=True, impute=False)
    model = fit_binary(
        train, predictors, boosted_classifier(trees, depth, bins=256, subsample=1.0), **options
    )
    auc = auc_of(score_binary(model, test, predictors))
    rate = labelled.agg(F.avg("label")).first()[0]
    verdict = (
        "unknown" if auc is None
        else "not at random" if auc > MISSING_PREDICTABLE
        else "partly predictable" if auc > MISSING_PARTLY
        else "compatible with random"
    )
    summary = df.sparkSession.createDataFrame(
        [(rate, auc, verdict)], "missing_rate double, auc double, verdict string"
    )
    return summary, grouped_importance(model, model.transform(ready(test, predictors)))


def compare_imputation(
    df: DataFrame, column: str, predictors: Predictors, trees: int = 30, depth: int = 6
) -> DataFrame:
    """Median against a model as estimates of known values, on a held-out fifth.

    Rows with an incomplete predictor are skipped by the model; both estimates are judged
    on the same remaining rows and the skipped count is reported.
    """
    known = materialize(df.filter(F.col(column).isNotNull()))
    train, test = random_split(known, 800, seed=SEED)
    ensure_checkpoint_dir(df.sparkSession)
    regressor = GBTRegressor(
        featuresCol="features", labelCol=column, maxIter=trees, maxDepth=depth, maxBins=256, seed=SEED,
        checkpointInterval=10,
    )
    stages = preprocess_stages(predictors, invalid="skip", with_one_hot=True, impute=False)
    model = Pipeline(stages=[*stages, regressor]).fit(ready(train, predictors))
    median = median_of(train, [column])[column]
    judged = materialize(
        model.transform(ready(test, predictors)).select(
            column, F.col("prediction").alias("model"), F.lit(float(median)).alias("median")
        )
    )
    held_out = test.count()
    parts = [
        regression_error(judged, column, estimate).select(
            F.lit(estimate).alias("estimate"), "rows", (F.lit(held_out) - F.col("rows")).alias("skipped"),
            "rmse", "mae",
        )
        for estimate in ("median", "model")
    ]
    return parts[0].unionByName(parts[1])


def drift_curve(
    long: DataFrame, predictors: Predictors, periods: Sequence[int], window: int = 4, horizon: int = 6,
    trees: int = 30, depth: int = 6,
) -> DataFrame:
    """AUC of a frozen model against one refitted before each period, same window length.

    ``periods`` are the calendar's periods in order; the frozen model sees the first
    ``window`` of them.
    """
    rows = materialize(long)

    def fitted(first: int, last: int) -> PipelineModel:
        part = rows.filter(F.col("period").between(first, last))
        return fit_binary(part, predictors, boosted_classifier(trees, depth, bins=256, subsample=1.0))

    frozen = fitted(periods[0], periods[window - 1])
    ahead = list(periods[window : window + horizon])
    scored = []
    for period in ahead:
        target = rows.filter(F.col("period") == period)
        for name, model in (("frozen", frozen), ("refit", fitted(period - window, period - 1))):
            made = score_binary(model, target, predictors, "score").select("period", "label", "score")
            scored.append(made.withColumn("model", F.lit(name)))
    return _curve(reduce(DataFrame.unionByName, scored), ahead).filter("cost is not null")


def _curve(scored: DataFrame, ahead: Sequence[int]) -> DataFrame:
    """Both models' AUC per period from one plan over (period, model, score, label)."""
    by_model = auc_by(scored, ("period", "model"), "score", "label")
    place = F.array_position(F.lit(list(ahead)), F.col("period")).cast("int")
    return by_model.groupBy("period").agg(
        F.max(F.when(F.col("model") == "frozen", F.col("auc"))).alias("auc_frozen"),
        F.max(F.when(F.col("model") == "refit", F.col("auc"))).alias("auc_refit"),
    ).select(
        "period", place.alias("periods_ahead"), "auc_frozen", "auc_refit",
        (F.col("auc_refit") - F.col("auc_frozen")).alias("cost"),
    )


def rate_drift_curve(
    features: DataFrame, spec: PanelSpec, periods: Sequence[int], window: int = 4, horizon: int = 6
) -> DataFrame:
    """The same curve for the (item, tenure) drop rates."""
    ahead = periods[window : window + horizon]
    return _curve(rate_drift_scores(features, spec, periods, window, horizon), ahead)


def rate_drift_scores(
    features: DataFrame, spec: PanelSpec, periods: Sequence[int], window: int = 4, horizon: int = 6
) -> DataFrame:
    """(period, label, model, score) of frozen and refitted drop rates, all periods in one plan.

    Refitted rates come from one pass in which a row counts for each later window holding it.
    """
    ahead = list(periods[window : window + horizon])
    held = explode_held(features.filter(F.col("period") <= ahead[-1]), spec)
    old = _rates(held.filter(F.col("period") <= periods[window - 1])).withColumnRenamed("rate", "frozen")
    new = _rates(rolling_windows(held, ahead, window), "evaluated").select(
        F.col("evaluated").alias("period"), "idx", "tenure", F.col("rate").alias("refit")
    )
    # at most catalogue x tenure rates, and as many again per evaluated period
    return (
        held.filter(F.col("period").isin(ahead))
        .join(F.broadcast(old), ["idx", "tenure"], "left")
        .join(F.broadcast(new), ["period", "idx", "tenure"], "left")
        .select(
            "period", "label",
            F.explode(
                F.create_map(
                    F.lit("frozen"), F.coalesce("frozen", F.lit(0.0)), F.lit("refit"), F.coalesce("refit", F.lit(0.0))
                )
            ).alias("model", "score"),
        )
    )


def _rates(held: DataFrame, *keys: str) -> DataFrame:
    return held.groupBy(*keys, "idx", "tenure").agg((F.sum("label") / F.count("*")).alias("rate"))


def drift_summary(curve: DataFrame, limit: float = DRIFT_COST) -> DataFrame:
    """Total AUC loss, mean cost of not refitting, and the first distance at which it pays."""
    first = F.min_by("auc_frozen", "periods_ahead")
    last = F.max_by("auc_frozen", "periods_ahead")
    ordered = F.array_sort(F.collect_list(F.struct("periods_ahead", "cost")))
    return curve.agg(
        F.count("*").alias("points"), (first - last).alias("auc_loss"),
        F.aggregate(ordered, F.lit(0.0), lambda acc, x: acc + x["cost"]).alias("cost_total"),
        F.min(F.when(F.col("cost") >= limit, F.col("periods_ahead"))).alias("refit_after"),
    ).select(
        "points", "auc_loss", (F.col("cost_total") / F.col("points")).alias("mean_cost"), "refit_after"
    )


