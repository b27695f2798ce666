"""Splits, recommendation lists and ranking metrics (T*, P*, M1-M3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.functions import ap_at_k, item_numbers, names_of
from panelspark.operators import metrics, reshape, split
from panelspark.operators import recommend as rec
from panelspark.registry.core import Data, query
from panelspark.registry.features import joined


def popular_lists(d: Data):
    train, measured = split.split_two(d.features, d.spec.measured)
    return rec.recommend_popular(measured, train, d.spec)


def named(d: Data, column: str = "recommended"):
    return F.array_join(names_of(F.col(column), d.spec.items), ",").alias(column)


@query("t1_split_two", "ab")
def _(d: Data):
    train, measured = split.split_two(d.features, d.spec.measured)
    return (
        train.select("entity", "period", F.lit("train").alias("part"))
        .unionByName(measured.select("entity", "period", F.lit("measured").alias("part")))
    )


@query("t2_split_three", "ab")
def _(d: Data):
    return split.split_names(d.features, d.spec.measured, lookback=8).select("entity", "period", "part")


@query("t3_rolling_windows", "ab")
def _(d: Data):
    evaluated = [d.spec.measured - i for i in range(4)]
    rows = split.rolling_windows(d.features, evaluated, 4)
    return rows.groupBy("evaluated").agg(
        F.count("*").alias("rows"), F.min("period").alias("first_period"),
        F.max("period").alias("last_period"), F.sum("n_adds").alias("adds"),
    )


@query("p1_popularity", "ab")
def _(d: Data):
    train, _ = split.split_two(d.features, d.spec.measured)
    return rec.popularity(train, d.spec)


@query("p2_recommend_popular", "ab")
def _(d: Data):
    return popular_lists(d).select("entity", named(d))


@query("p6_coverage_gap", "ab")
def _(d: Data):
    """Entities with adds in the train rows against everyone served, for the signal of past holdings."""
    adders = d.parts.train.filter(F.col("n_adds") > 0)
    known = reshape.interaction_counts(d.parts.train, d.spec, "held")
    return rec.coverage_gap(adders, d.parts.measured, known)


@query("p10_top_k", "ab")
def _(d: Data):
    return rec.with_recommendation(d.by_rates, d.spec).select("entity", "period", named(d))


@query("p11_client_propensity", "ab")
def _(d: Data):
    return rec.client_propensity(d.by_rates).select("entity", "period", "prob_buy")


@query("p13_order_by_score", "ab")
def _(d: Data):
    long = d.by_rates.select("entity", "period", F.posexplode("scores").alias("idx", "score"))
    return rec.order_by_score(long).select("entity", "period", named(d, "ordered"))


@query("p16_score_portfolio", "ab")
def _(d: Data):
    measured = d.by_rates.filter(F.col("period") == d.spec.measured)
    scored = rec.score_portfolio(measured, d.spec)
    return scored.select(
        "entity", "took_up", named(d),
        F.floor(F.col("prob_buy") * 1000000 + 0.5).cast("long").alias("prob_buy_micro"),
    )


@query("p17_compare_approaches", "ab")
def _(d: Data):
    """Popularity, popularity within the holdings band, and conditional rates, side by side."""
    from panelspark.registry.fusion import model_rows, MODELS
    from panelspark.operators import fusion

    rows = model_rows(d).filter(F.col("period") == d.spec.measured)
    return rec.compare_approaches(fusion.ap_by_client(rows, MODELS, d.spec), "popularity")


@query("m1_ap_at_k", "ab")
def _(d: Data):
    return rec.with_ap(popular_lists(d), d.spec).select("entity", "ap_micro")


@query("m1_ap_at_k_names", "ab")
def _(d: Data):
    """The same metric on lists of names."""
    rows = popular_lists(d).filter(F.col("add_bits") != 0)
    predicted = names_of(F.col("recommended"), d.spec.items)
    actual = names_of(item_numbers(F.col("add_bits"), d.spec.n), d.spec.items)
    ap = ap_at_k(predicted, actual, d.spec.k)
    return rows.select("entity", F.floor(ap * 1000000 + 0.5).cast("long").alias("ap_micro"))


@query("m2_map_popularity", "ab")
def _(d: Data):
    return metrics.map_at_k(rec.with_ap(popular_lists(d), d.spec))


@query("m2_map_conditional_rate", "ab")
def _(d: Data):
    lists = rec.with_recommendation(d.by_rates, d.spec)
    ap = rec.with_ap(lists, d.spec)
    return split.mean_ap(ap, "period")


@query("m3_map_full_base", "ab")
def _(d: Data):
    lists = popular_lists(d)
    return metrics.map_full_base(rec.with_ap(lists, d.spec), lists)
