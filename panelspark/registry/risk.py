"""Classification metrics on given scores, the business layer and score exports (M4-M11, N*, S5-S7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.functions import names_of
from panelspark.operators import business, calibration, drop, metrics, reshape
from panelspark.operators import recommend as rec
from panelspark.registry.core import Data, query
from panelspark.session import materialize
from panelspark.sources import exports


def measured_drops(d: Data):
    return d.drop_scores.filter(F.col("period") == d.spec.measured)


def portfolio(d: Data):
    """Entities of t with propensity, outcome and list, from the conditional rates."""
    scored = d.by_rates.filter(F.col("period") == d.spec.measured)
    return rec.with_recommendation(rec.client_propensity(scored), d.spec).select(
        "entity", "prob_buy", (F.col("n_adds") > 0).cast("int").alias("took_up"), "recommended"
    )


def with_drop_risk(d: Data):
    """Written once: both cuts and the classification read it."""
    d = d.written()
    purchase = portfolio(d).select("entity", "prob_buy", "took_up")
    return materialize(business.with_risk(purchase, business.client_risk(measured_drops(d))))


def both_cuts(df):
    return business.percentile_cuts(df, ["prob_buy", "prob_drop"])


@query("m4_roc_auc", "ab")
def _(d: Data):
    return metrics.roc_auc(metrics.cumulative_histogram(measured_drops(d), "p", "label"))


@query("m5_pr_auc", "ab")
def _(d: Data):
    return metrics.pr_auc(metrics.cumulative_histogram(measured_drops(d), "p", "label")).select(
        "positives", "rows", "pr_auc", "base_rate"
    )


@query("m6_lift_over_base", "ab")
def _(d: Data):
    return metrics.lift_over_base(measured_drops(d), "p", "label")


@query("m7_brier", "ab")
def _(d: Data):
    return metrics.brier(measured_drops(d), "p_item", "p")


@query("m8_reliability", "ab")
def _(d: Data):
    return metrics.reliability(measured_drops(d), "p")


@query("m9_tie_levels", "ab")
def _(d: Data):
    return metrics.tie_levels(measured_drops(d), "p")


@query("m10_threshold_sweep", "ab")
def _(d: Data):
    return metrics.threshold_sweep(measured_drops(d), "p")


@query("m11_regression_error", "b")
def _(d: Data):
    """Error of the median as an estimate of a known income."""
    known = d.profile.filter(F.col("income").isNotNull()).withColumn("zero", F.lit(0))
    cut = metrics.exact_cuts(metrics.cumulative_histogram(known, "income", "zero"), [500])
    median = cut.select(F.lit(1).alias("one"), F.col("cut_500.score").alias("median"))
    rows = known.withColumn("one", F.lit(1)).join(F.broadcast(median), "one")
    return metrics.regression_error(rows, "income", "median")


@query("n1_capture_curve", "ab")
def _(d: Data):
    return business.capture_curve(portfolio(d), "prob_buy", "took_up")


@query("n2_client_risk", "ab")
def _(d: Data):
    return business.client_risk(measured_drops(d))


@query("n3_percentile_cuts", "ab")
def _(d: Data):
    return both_cuts(with_drop_risk(d))


SKETCH_ERROR = 0.02  # of a rank, far above the sketch's own bound


@query("n3_sketch_cuts", "ab")
def _(d: Data):
    """Whether the sketched cuts of every period, and of all merged (-1), keep their rank error."""
    scored = rec.client_propensity(d.by_rates).select("period", F.coalesce("prob_buy", F.lit(0.0)).alias("prob_buy"))
    scored = materialize(scored)
    sketches = materialize(business.score_sketches(scored, ["prob_buy"]))
    asked = [500, 800, 950, 990]
    cuts = business.sketch_cuts(sketches, ["prob_buy"], asked, by="period").unionByName(
        business.sketch_cuts(sketches, ["prob_buy"], asked).withColumn("period", F.lit(-1))
    )
    rows = scored.unionByName(scored.withColumn("period", F.lit(-1)))
    share = rows.join(F.broadcast(cuts), "period").groupBy("period", "score", "per_mille").agg(
        (F.count_if(F.col("prob_buy") < F.col("cut")) / F.count("*")).alias("below"),
        (F.count_if(F.col("prob_buy") <= F.col("cut")) / F.count("*")).alias("upto"),
    )
    rank = F.col("per_mille") / 1000
    within = (F.col("below") - SKETCH_ERROR <= rank) & (rank <= F.col("upto") + SKETCH_ERROR)
    return share.select("period", "score", "per_mille", within.alias("within"))


@query("n4_quadrants", "ab")
def _(d: Data):
    rows = with_drop_risk(d)
    return business.quadrants(business.with_quadrant(rows, both_cuts(rows)))


@query("n5_action_labels", "ab")
def _(d: Data):
    rows = with_drop_risk(d)
    return business.with_action(business.with_quadrant(rows, both_cuts(rows))).select(
        "entity", "quadrant", "action"
    )


@query("n7_call_list", "ab")
def _(d: Data):
    return business.call_list(portfolio(d), 50).select(
        "entity", "prob_buy",
        F.array_join(names_of(F.col("recommended"), d.spec.items), ",").alias("recommended"),
    )


@query("s5_purchase_scores", "ab")
def _(d: Data):
    table = exports.export_purchase_scores(portfolio(d), d.spec)
    return table.withColumn("recommended", F.array_join("recommended", ","))


@query("s6_drop_scores", "ab")
def _(d: Data):
    return exports.export_drop_scores(measured_drops(d))


@query("s7_serving_extract", "ab")
def _(d: Data):
    d = d.written()
    purchase = exports.export_purchase_scores(portfolio(d), d.spec)
    drops = exports.export_drop_scores(measured_drops(d))
    extract = exports.serving_extract(purchase, drops, d.parts.measured, d.spec, 100)
    return extract.withColumns(
        {c: F.array_join(c, ",") for c in ("recommended", "held")}
    )


def sink_buckets(d: Data) -> int:
    return int(d.spark.conf.get("spark.sql.shuffle.partitions"))


@query("s5_purchase_sink", "ab")
def _(d: Data):
    """The purchase table as its consumer reads it, after the write."""
    written = exports.write_bucketed(exports.export_purchase_scores(portfolio(d), d.spec), "purchase_scores", sink_buckets(d))
    return written.withColumn("recommended", F.array_join("recommended", ","))


@query("s6_drop_sink", "ab")
def _(d: Data):
    return exports.write_bucketed(exports.export_drop_scores(measured_drops(d)), "drop_scores", sink_buckets(d))


@query("s7_serving_profile", "b")
def _(d: Data):
    """The serving extract from the written sinks, with the customers' profile columns."""
    d = d.written()
    purchase = exports.write_bucketed(exports.export_purchase_scores(portfolio(d), d.spec), "purchase_scores", sink_buckets(d))
    drops = exports.write_bucketed(exports.export_drop_scores(measured_drops(d)), "drop_scores", sink_buckets(d))
    extract = exports.serving_extract(purchase, drops, d.parts.measured, d.spec, 100, d.profile)
    return extract.withColumns({c: F.array_join(c, ",") for c in ("recommended", "held")})


@query("b3_leakage_verdict", "ab")
def _(d: Data):
    """Negative control on the conditional rate of one item: its score against the answer itself."""
    index = 2
    rows = d.by_rates.filter(F.col("period") == d.spec.measured).select(
        F.getbit("add_bits", F.lit(index)).cast("int").alias("label"), F.get("scores", index).alias("score"),
        F.getbit("prev_bits", F.lit(index)).alias("held"),
    )
    both = rows.filter(F.col("held") == 0).select(
        "label",
        F.explode(F.create_map(F.lit("auc_clean"), "score", F.lit("auc_leaked"), F.col("label").cast("double"))).alias("model", "p"),
    )
    by_model = metrics.auc_by(both, ("model",), "p", "label")
    aucs = by_model.agg(
        *[F.max(F.when(F.col("model") == m, F.col("auc"))).alias(m) for m in ("auc_clean", "auc_leaked")]
    )
    return drop.leakage_verdict(aucs)


def curve_rows(d: Data):
    periods = list(range(d.spec.measured - 9, d.spec.measured + 1))
    return d.features.filter(F.col("period") >= periods[0]), d.spec, periods


def rate_curve(d: Data):
    return drop.rate_drift_curve(*curve_rows(d))


@query("m4_auc_by_key", "ab")
def _(d: Data):
    """Twelve keys: six periods of a frozen and a refitted rate."""
    return metrics.auc_by(drop.rate_drift_scores(*curve_rows(d)), ("period", "model"), "score", "label")


@query("m5_pr_auc_by_key", "ab")
def _(d: Data):
    keys = ("period", "model")
    counted = metrics.cumulative_by(drop.rate_drift_scores(*curve_rows(d)), keys, "score", "label")
    return metrics.pr_auc(counted, keys).select(*keys, "positives", "rows", "pr_auc", "base_rate")


@query("b2_isotonic", "ab")
def _(d: Data):
    """The calibration fitted on the drop rates of t-1, at the scores that occur there."""
    decided = d.drop_scores.filter(F.col("period") == d.spec.decision)
    points = materialize(calibration.calibration_points(decided, "p"))
    fitted = calibration.calibration_map(calibration.isotonic_blocks(points))
    return points.join(fitted, "point").select("point", "n", "pos", F.col("p").alias("calibrated"))


@query("b7_drift_curve", "ab")
def _(d: Data):
    return rate_curve(d)


@query("b7_drift_summary", "ab")
def _(d: Data):
    return drop.drift_summary(rate_curve(d))


@query("b6_median_error", "b")
def _(d: Data):
    """Median of four fifths of the known incomes, judged on the last fifth."""
    known = d.profile.filter(F.col("income").isNotNull()).withColumns(
        {"period": F.lit(0), "zero": F.lit(0)}
    )
    train, test = reshape.random_split(known, 800, seed=42)
    cut = metrics.exact_cuts(metrics.cumulative_histogram(train, "income", "zero"), [500])
    median = cut.select(F.lit(1).alias("one"), F.col("cut_500.score").alias("median"))
    rows = test.withColumn("one", F.lit(1)).join(F.broadcast(median), "one")
    return metrics.regression_error(rows, "income", "median")
