"""From features to a calibrated drop risk and the threshold at which calling pays."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.operators import drop, encode, metrics, reshape, split
from panelspark.operators.encode import Predictors
from panelspark.session import materialize
from panelspark.sources.exports import export_drop_scores
from panelspark.spec import PanelSpec


@dataclass(frozen=True)
class DropPlan:
    scores: DataFrame
    ranking: DataFrame
    brier: DataFrame
    reliability: DataFrame
    sweep: DataFrame


def run_drop(features: DataFrame, spec: PanelSpec, predictors: Predictors | None = None, trees: int = 40) -> DropPlan:
    """Fit before t-1, calibrate on t-1, measure on t."""
    inputs = predictors or Predictors(extra=encode.held_names_of(spec))
    table = encode.held_flags(features.filter(F.col("period") <= spec.measured), spec)
    keep = tuple(dict.fromkeys(("entity", "period", *inputs.numeric, *inputs.categorical, *inputs.extra)))
    long = materialize(reshape.explode_held(table, spec, keep))
    full = inputs.plus(numeric=("tenure",), categorical=("item",))
    parts = split.split_three(long, spec.measured)
    model = drop.fit_drop_model(parts.train, full, trees=trees)
    columns = ("entity", "item", "label", "p_raw")
    decision = materialize(drop.score_binary(model, parts.decision, full).select(*columns))
    measured = drop.score_binary(model, parts.measured, full).select(*columns)
    calibrated = materialize(drop.calibrate(decision, measured))
    return DropPlan(
        scores=export_drop_scores(calibrated, "p", "p_raw"),
        ranking=metrics.pr_auc(metrics.cumulative_histogram(calibrated, "p_raw", "label")),
        brier=metrics.brier(calibrated, "p_raw", "p"),
        reliability=metrics.reliability(calibrated, "p"),
        sweep=metrics.threshold_sweep(calibrated, "p"),
    )
