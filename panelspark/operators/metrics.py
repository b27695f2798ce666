"""Ranking, classification and calibration metrics.

AUC, PR area, the capture curve and exact percentiles all read one cumulative score
histogram.  It is built without a global sort in one task: rows collapse to one per
distinct score, the distinct scores are cut into even ranges, and running counts are
taken inside a range on top of the totals of the ranges before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions import micro
from panelspark.functions.fixedpoint import MICRO
from panelspark.session import materialize

WIDE = "decimal(38,0)"  # products of two row counts outgrow BIGINT at scale


def score_histogram(df: DataFrame, score: str, label: str) -> DataFrame:
    return (
        df.filter(F.col(score).isNotNull())
        .groupBy(F.col(score).cast("double").alias("score"))
        .agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))
    )


def with_range(histogram: DataFrame, ranges: int) -> DataFrame:
    """Number of the score range, by literal edges: the same for every task and re-run."""
    shares = [i / ranges for i in range(1, ranges)]
    edges = sorted(set(histogram.approxQuantile("score", shares, 0.5 / ranges))) if shares else []
    bucketizer = Bucketizer(
        splits=[float("-inf"), *edges, float("inf")] if edges else [float("-inf"), 0.0, float("inf")],
        inputCol="score", outputCol="range",
    )
    return bucketizer.transform(histogram).withColumn("range", F.col("range").cast("int"))


def cumulative_histogram(df: DataFrame, score: str, label: str, ranges: int | None = None) -> DataFrame:
    """One row per distinct score with counts at, below and in total.

    ``below_*`` count strictly lower scores; ``all_*`` are the grand totals.  The histogram
    is written once, because the edges and both branches below read it.
    """
    if ranges is None:
        ranges = max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = with_range(materialize(score_histogram(df, score, label)), ranges)
    per_range = ranged.groupBy("range").agg(F.sum("n").alias("range_n"), F.sum("pos").alias("range_pos"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # <= ranges rows
    whole = Window.partitionBy()
    offsets = per_range.select(
        "range",
        F.coalesce(F.sum("range_n").over(before), F.lit(0)).alias("offset_n"),
        F.coalesce(F.sum("range_pos").over(before), F.lit(0)).alias("offset_pos"),
        F.sum("range_n").over(whole).alias("all_n"),
        F.sum("range_pos").over(whole).alias("all_pos"),
    )
    inside = Window.partitionBy("range").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.join(F.broadcast(offsets), "range")
        .select(
            "score", "n", "pos",
            (F.col("offset_n") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("below_n"),
            (F.col("offset_pos") + F.coalesce(F.sum("pos").over(inside), F.lit(0))).alias("below_pos"),
            "all_n", "all_pos",
        )
    )


def roc_auc(cumulative: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Exact area: pairs ranked right plus half the ties, over all pairs; one row per key."""
    wins = F.col("pos").cast(WIDE) * (
        2 * (F.col("below_n") - F.col("below_pos")) + (F.col("n") - F.col("pos"))
    ).cast(WIDE)
    totals = _grouped(cumulative, keys).agg(
        F.sum(wins.cast(WIDE)).alias("twice"), F.max("all_pos").alias("positives"),
        F.max(F.col("all_n") - F.col("all_pos")).alias("negatives"),
    )
    pairs = 2.0 * F.col("positives").cast("double") * F.col("negatives").cast("double")
    return totals.select(
        *keys, "positives", "negatives",
        F.when(pairs > 0, F.col("twice").cast("double") / pairs).alias("auc"),
    )


def cumulative_by(
    df: DataFrame, keys: Sequence[str], score: str, label: str, ranges: int | None = None
) -> DataFrame:
    """``cumulative_histogram`` of every key at once, its keys as further columns.

    All keys share the range edges.  Running counts are taken inside a (key, range), on top of
    the key's totals of lower ranges, which are at most ``ranges`` numbers.
    """
    if ranges is None:
        ranges = max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keyed = df.filter(F.col(score).isNotNull()).groupBy(*keys, F.col(score).cast("double").alias("score"))
    levels = keyed.agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))
    ranged = with_range(materialize(levels), ranges)
    part = F.struct("range", F.col("range_n").alias("n"), F.col("range_pos").alias("pos"))
    per_range = ranged.groupBy(*keys, "range").agg(F.sum("n").alias("range_n"), F.sum("pos").alias("range_pos"))
    parts = per_range.groupBy(*keys).agg(F.collect_list(part).alias("parts"))  # <= ranges each

    def sum_of(what: str, lower: bool) -> Column:
        chosen = F.filter("parts", lambda x: x["range"] < F.col("range")) if lower else F.col("parts")
        return F.aggregate(chosen, F.lit(0).cast("long"), lambda total, x: total + x[what])

    offsets = parts.select(*keys, "parts", F.explode(F.transform("parts", lambda x: x["range"])).alias("range")).select(
        *keys, "range", sum_of("n", True).alias("offset_n"), sum_of("pos", True).alias("offset_pos"),
        sum_of("n", False).alias("all_n"), sum_of("pos", False).alias("all_pos"),
    )
    inside = Window.partitionBy(*keys, "range").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(offsets, [*keys, "range"]).select(
        *keys, "score", "n", "pos",
        (F.col("offset_n") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("below_n"),
        (F.col("offset_pos") + F.coalesce(F.sum("pos").over(inside), F.lit(0))).alias("below_pos"),
        "all_n", "all_pos",
    )


def auc_by(df: DataFrame, keys: Sequence[str], score: str, label: str) -> DataFrame:
    """Exact AUC of every key from one plan; null where a key has one class only."""
    return roc_auc(cumulative_by(df, keys, score, label), keys)


def _grouped(df: DataFrame, keys: Sequence[str]):
    return df.groupBy(*keys) if keys else df


def pr_auc(cumulative: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Step-wise area under precision-recall, and its lift over the base rate; one row per key.

    Each score's step (positives there times precision down to there) is rounded to
    millionths before summing, so the total does not depend on the order of the sum.
    """
    hits = F.col("all_pos") - F.col("below_pos")
    called = F.col("all_n") - F.col("below_n")
    totals = _grouped(cumulative, keys).agg(
        F.sum(micro(F.col("pos") * (hits / called))).alias("area_micro"),
        F.max("all_pos").alias("positives"), F.max("all_n").alias("rows"),
    )
    area = F.col("area_micro") / (F.col("positives") * F.lit(MICRO))
    base = F.col("positives") / F.col("rows")
    return totals.filter(F.col("positives") > 0).select(
        *keys, "positives", "rows", area.alias("pr_auc"), base.alias("base_rate"), (area / base).alias("lift")
    )


def lift_over_base(df: DataFrame, score: str, label: str) -> DataFrame:
    return pr_auc(cumulative_histogram(df, score, label)).select("base_rate", "lift")


def map_at_k(ap: DataFrame) -> DataFrame:
    """MAP over rows with at least one add (``ap_micro`` comes from ``with_ap``)."""
    return ap.agg(F.sum("ap_micro").alias("ap_sum"), F.count("*").alias("clients")).withColumn(
        "map", F.col("ap_sum") / (F.col("clients") * F.lit(MICRO))
    )


def map_full_base(ap: DataFrame, base_rows: DataFrame) -> DataFrame:
    """MAP spread over the whole base: entities without adds weigh in with zero."""
    scored = map_at_k(ap).withColumn("one", F.lit(1))
    size = base_rows.agg(F.count("*").alias("base")).withColumn("one", F.lit(1))
    return scored.join(F.broadcast(size), "one").select(
        "clients", "base", "map",
        (F.col("ap_sum") / (F.col("base") * F.lit(MICRO))).alias("map_full_base"),
    )


def brier(df: DataFrame, *probabilities: str, label: str = "label") -> DataFrame:
    """Mean squared error of each probability column, and its improvement over the first."""
    totals = df.agg(
        F.count("*").alias("rows"),
        *[F.sum(micro(F.pow(F.col(p) - F.col(label), 2))).alias(f"sum_{p}") for p in probabilities],
    )
    scores = {p: F.col(f"sum_{p}") / (F.col("rows") * F.lit(MICRO)) for p in probabilities}
    first = probabilities[0]
    gains = [
        F.when(
            F.col(f"sum_{first}") > 0,
            100 * (F.col(f"sum_{first}") - F.col(f"sum_{p}")) / F.col(f"sum_{first}"),
        ).alias(f"improvement_pct_{p}")
        for p in probabilities[1:]
    ]
    return totals.select("rows", *[v.alias(f"brier_{p}") for p, v in scores.items()], *gains)


def reliability(df: DataFrame, probability: str, bins: int = 10, label: str = "label") -> DataFrame:
    """Promised against observed per probability bin; 1.0 belongs to the last bin."""
    bin_of = F.least(F.floor(F.col(probability) * bins), F.lit(bins - 1)).cast("int")
    return (
        df.groupBy(bin_of.alias("bin"))
        .agg(
            F.count("*").alias("rows"),
            F.sum(micro(F.col(probability))).alias("promised_micro"),
            F.sum(F.col(label).cast("long")).alias("positives"),
        )
        .select(
            "bin", "rows",
            (F.col("promised_micro") / (F.col("rows") * F.lit(MICRO))).alias("promised"),
            (F.col("positives") / F.col("rows")).alias("observed"),
        )
    )


def tie_levels(df: DataFrame, probability: str) -> DataFrame:
    return df.agg(F.count_distinct(probability).alias("levels"), F.count("*").alias("rows"))


def threshold_sweep(
    df: DataFrame, probability: str, cost: int = 5, value: int = 120, success_pct: int = 30,
    label: str = "label",
) -> DataFrame:
    """Contacts, hits and campaign value at every threshold 0.01 .. 0.99, best one flagged.

    One aggregate to at most 101 buckets; the running sums see only those.
    """
    bucket = F.floor(F.col(probability) * 100 + 0.5).cast("int")
    histogram = df.groupBy(bucket.alias("threshold_pct")).agg(
        F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("pos")
    )
    spark = df.sparkSession
    grid = spark.range(1, 100).select(F.col("id").cast("int").alias("threshold_pct"))
    down = Window.orderBy(F.desc("threshold_pct")).rowsBetween(Window.unboundedPreceding, 0)
    curve = (
        histogram.join(grid.withColumn("asked", F.lit(1)), "threshold_pct", "full")
        .select(
            "threshold_pct", "asked",
            F.coalesce(F.sum("n").over(down), F.lit(0)).alias("contacts"),
            F.coalesce(F.sum("pos").over(down), F.lit(0)).alias("hits"),
        )
        .filter(F.col("asked") == 1)
        .drop("asked")
        .withColumn(
            "value", (F.col("hits") * (success_pct * value) - F.col("contacts") * (100 * cost)) / 100
        )
    )
    best = Window.orderBy(F.desc("value"), "threshold_pct")
    return curve.withColumn("best", F.row_number().over(best) == 1)


def regression_error(df: DataFrame, actual: str, estimate: str) -> DataFrame:
    """RMSE and MAE of an estimate column."""
    gap = F.col(estimate) - F.col(actual)
    totals = df.agg(
        F.count("*").alias("rows"),
        F.sum(F.floor(gap * gap * 100 + 0.5).cast(WIDE)).alias("squares"),
        F.sum(F.floor(F.abs(gap) * 100 + 0.5).cast(WIDE)).alias("absolutes"),
    )
    return totals.select(
        "rows",
        F.sqrt(F.col("squares").cast("double") / F.col("rows") / 100).alias("rmse"),
        (F.col("absolutes").cast("double") / F.col("rows") / 100).alias("mae"),
    )


def exact_cuts(cumulative: DataFrame, per_mille: list[int]) -> DataFrame:
    """Discrete percentiles: the lowest score whose share of rows at or below reaches q.

    Also returns how many rows and positives lie at or above each cut.  One row in all.
    """
    at_or_below = F.col("below_n") + F.col("n")
    row = F.struct(
        "score",
        (F.col("all_n") - F.col("below_n")).alias("rows_from"),
        (F.col("all_pos") - F.col("below_pos")).alias("pos_from"),
    )
    return cumulative.agg(
        F.max("all_n").alias("all_n"), F.max("all_pos").alias("all_pos"),
        *[
            F.min(F.when(at_or_below * 1000 >= F.col("all_n") * q, row)).alias(f"cut_{q}")
            for q in per_mille
        ],
    )
