"""From a panel to a contact plan: features, scores chosen on t-1, lists, capture curve, quadrants."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.operators import business, features as feat, fusion, metrics, reshape, split
from panelspark.operators import recommend as rec
from panelspark.session import materialize
from panelspark.spec import PanelSpec

MODELS = rec.SCORE_TABLE_MODELS


@dataclass(frozen=True)
class PurchasePlan:
    weights: DataFrame
    portfolio: DataFrame
    map_at_k: DataFrame
    capture: DataFrame
    quadrants: DataFrame


def run_purchase(panel: DataFrame, spec: PanelSpec) -> PurchasePlan:
    """Blend three deterministic models with weights fixed on t-1 and report t.

    The feature table is written once; the train pass and both scored periods read it.
    """
    table = materialize(feat.build_features(panel, spec).filter(F.col("period") <= spec.measured))
    parts = split.split_three(table, spec.measured)
    evaluated = table.filter(F.col("period") >= spec.decision)
    rows = rec.with_model_scores(evaluated, parts.train, spec)
    ranked = materialize(fusion.with_rank_arrays(rows, MODELS))
    weights = materialize(
        fusion.search_weights(ranked.filter(F.col("period") == spec.decision), MODELS, spec)
    )
    measured = ranked.filter(F.col("period") == spec.measured)
    blended = fusion.blend_with(measured, weights, MODELS, spec)
    propensity = rec.client_propensity(blended.withColumn("scores", F.col("scores_conditional_rate")))
    portfolio = materialize(
        propensity.select(
            "entity", "prob_buy", (F.col("n_adds") > 0).cast("int").alias("took_up"),
            "recommended", "add_bits",
        )
    )
    drops = rec.score_drops(
        reshape.explode_held(parts.measured, spec), rec.drop_rates(parts.train, spec)
    )
    valued = materialize(
        business.with_risk(portfolio.select("entity", "prob_buy"), business.client_risk(drops))
    )
    cuts = business.percentile_cuts(valued, ["prob_buy", "prob_drop"])
    return PurchasePlan(
        weights=weights,
        portfolio=portfolio.drop("add_bits"),
        map_at_k=metrics.map_at_k(rec.with_ap(portfolio, spec)),
        capture=business.capture_curve(portfolio, "prob_buy", "took_up"),
        quadrants=business.quadrants(business.with_quadrant(valued, cuts)),
    )
