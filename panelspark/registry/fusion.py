"""Fusion, routing and choices on t-1 (E*, U*, T5, T6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.functions import names_of, pseudo_random
from panelspark.operators import fusion, split
from panelspark.operators import recommend as rec
from panelspark.registry.core import Data, query

MODELS = rec.SCORE_TABLE_MODELS


def model_rows(d: Data):
    """Rows of t-1 and t with one score array per model, all learnt before t-1."""
    return rec.with_model_scores(d.evaluated, d.parts.train, d.spec)


def ranked_rows(d: Data, period: int):
    return fusion.with_rank_arrays(model_rows(d).filter(F.col("period") == period), MODELS)


def client_ap(d: Data):
    return fusion.ap_by_client(model_rows(d), MODELS, d.spec, keep=("history", "n_prev"))


@query("e1_rank_scores", "ab")
def _(d: Data):
    return fusion.rank_scores(d.by_rates)


@query("e2_blend", "ab")
def _(d: Data):
    rows = fusion.blend(ranked_rows(d, d.spec.measured), MODELS, (0.2, 0.3, 0.5), d.spec)
    return rows.select(
        "entity", F.array_join(names_of(F.col("recommended"), d.spec.items), ",").alias("recommended")
    )


@query("e3_search_weights", "ab")
def _(d: Data):
    return fusion.search_weights(ranked_rows(d, d.spec.decision), MODELS, d.spec)


@query("e4_blend_gain", "ab")
def _(d: Data):
    d = d.written()
    chosen = fusion.search_weights(ranked_rows(d, d.spec.decision), MODELS, d.spec)
    rows = ranked_rows(d, d.spec.measured)
    blended = fusion.blend_with(rows, chosen, MODELS, d.spec)
    ap = (
        fusion.ap_by_client(rows, MODELS, d.spec).select("model", "ap_micro")
        .unionByName(rec.with_ap(blended, d.spec).select(F.lit("blend").alias("model"), "ap_micro"))
    )
    return fusion.blend_gain(ap)


@query("u1_segment_bands", "ab")
def _(d: Data):
    by_history = fusion.with_segment(d.features, "history", fusion.HISTORY_BANDS)
    return by_history.select(
        "entity", "period", F.col("segment").alias("by_history"),
        fusion.segment_label(F.col("n_prev"), fusion.HOLDING_BANDS).alias("by_holdings"),
    )


@query("u2_ap_by_client", "ab")
def _(d: Data):
    return client_ap(d).select("entity", "period", "model", "ap_micro")


@query("u3_segment_winners", "ab")
def _(d: Data):
    ap = fusion.with_segment(client_ap(d), "history", fusion.HISTORY_BANDS)
    return fusion.segment_winners(ap, ("period", "segment"))


@query("u4_route", "ab")
def _(d: Data):
    ap = fusion.with_segment(client_ap(d), "n_prev", fusion.HOLDING_BANDS)
    return fusion.route(ap, d.spec.measured)


@query("u4_routing_gain", "ab")
def _(d: Data):
    ap = fusion.with_segment(client_ap(d), "n_prev", fusion.HOLDING_BANDS)
    return fusion.routing_gain(ap, d.spec.measured)


@query("u5_rule_stability", "ab")
def _(d: Data):
    ap = fusion.with_segment(client_ap(d), "n_prev", fusion.HOLDING_BANDS)
    return fusion.rule_stability(ap, d.spec.measured)


@query("u6_history_distribution", "ab")
def _(d: Data):
    return fusion.history_distribution(d.parts.measured)


LOOKBACKS = (2, 4, 8)


def lookback_ap(d: Data):
    """AP rows of popularity learnt from the last 2, 4 and 8 periods before t-1."""
    windows = {f"last_{n}": F.col("period") >= d.spec.decision - n for n in LOOKBACKS}
    recent = split.split_three(d.features, d.spec.measured, max(LOOKBACKS)).train
    learnt = rec.popularity_by_window(recent, d.spec, windows).withColumn("one", F.lit(1))
    rows = d.evaluated.withColumn("one", F.lit(1)).join(F.broadcast(learnt), "one")
    return fusion.ap_by_client(rows, list(windows), d.spec).withColumnRenamed("model", "candidate")


@query("t5_select_on_holdout", "ab")
def _(d: Data):
    return split.select_on_holdout(lookback_ap(d), d.spec.measured)


SEEDS = (1, 2, 3)


@query("t6_noise_report", "ab")
def _(d: Data):
    """Reruns of the conditional rates on three repeatable 40 percent samples of the train rows."""
    key = pseudo_random(F.col("entity"), F.col("period"), seed=F.col("seed"))
    sampled = d.parts.train.select("*", F.explode(F.lit(list(SEEDS))).alias("seed")).filter(
        F.pmod(key, F.lit(1000)) < 400
    )
    rates = rec.add_rates(sampled, d.spec, ("seed",)).groupBy("band").agg(
        *[F.max(F.when(F.col("seed") == s, F.col("scores"))).alias(f"scores_{s}") for s in SEEDS]
    )
    rows = d.parts.decision.withColumn("band", rec.band(F.col("n_prev"))).join(
        F.broadcast(rates), "band", "left"
    )
    rows = rows.withColumns(
        {f"scores_{s}": F.coalesce(f"scores_{s}", rec.no_scores(d.spec)) for s in SEEDS}
    )
    ap = fusion.ap_by_client(rows, [str(s) for s in SEEDS], d.spec).withColumnRenamed("model", "seed")
    report = split.noise_report(ap, gain=0.002)
    return report.select(
        "reruns", F.floor(F.col("mean_map") * 1000000 + 0.5).cast("long").alias("mean_map_micro"),
        F.floor(F.col("std_map") * 1000000 + 0.5).cast("long").alias("std_map_micro"), "gain_above_noise",
    )
