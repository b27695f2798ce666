"""Temporal splits, and choices that are made on t-1 and reported on t."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.fixedpoint import MICRO


@dataclass(frozen=True)
class ThreeWay:
    train: DataFrame
    decision: DataFrame
    measured: DataFrame


def split_two(df: DataFrame, measured: int) -> tuple[DataFrame, DataFrame]:
    """Before the measured period, and the measured period itself."""
    return df.filter(F.col("period") < measured), df.filter(F.col("period") == measured)


def split_at(df: DataFrame, cutoff: DataFrame) -> DataFrame:
    """Rows up to the period of a one-row table, with their ``part``: train before it, measured in it."""
    known = F.broadcast(cutoff.select(F.col("period").alias("measured_period")))
    part = F.when(F.col("period") < F.col("measured_period"), "train").otherwise("measured")
    return df.join(known, F.col("period") <= F.col("measured_period")).withColumn("part", part).drop("measured_period")


def split_three(df: DataFrame, measured: int, lookback: int | None = None) -> ThreeWay:
    """Train before t-1 (optionally only the last periods), decide on t-1, measure on t."""
    decision = measured - 1
    train = df.filter(F.col("period") < decision)
    if lookback is not None:
        train = train.filter(F.col("period") >= decision - lookback)
    return ThreeWay(
        train, df.filter(F.col("period") == decision), df.filter(F.col("period") == measured)
    )


def split_names(df: DataFrame, measured: int, lookback: int | None = None) -> DataFrame:
    """The three-way split as a column, for one pass over all parts."""
    period = F.col("period")
    in_train = period < measured - 1
    if lookback is not None:
        in_train = in_train & (period >= measured - 1 - lookback)
    part = (
        F.when(in_train, "train").when(period == measured - 1, "decision")
        .when(period == measured, "measured")
    )
    return df.withColumn("part", part).filter(F.col("part").isNotNull())


def rolling_windows(df: DataFrame, evaluated: list[int], n: int) -> DataFrame:
    """Each row once per evaluated period whose n-period train window contains it.

    The window is narrow, so a row is repeated at most n times.
    """
    targets = F.filter(
        F.lit(sorted(evaluated)), lambda e: (e > F.col("period")) & (e <= F.col("period") + n)
    )
    return df.select("*", F.explode(targets).alias("evaluated"))


def first_periods(df: DataFrame) -> list[int]:
    """Distinct periods in order: calendar-sized, collected to plan one fit per period."""
    return [r.period for r in df.select("period").distinct().orderBy("period").collect()]


def mean_ap(ap: DataFrame, *keys: str) -> DataFrame:
    """MAP per key from (ap_micro) rows."""
    return ap.groupBy(*keys).agg(
        F.sum("ap_micro").alias("ap_sum"), F.count("*").alias("clients")
    ).withColumn("map", F.col("ap_sum") / (F.col("clients") * F.lit(MICRO)))


def select_on_holdout(ap: DataFrame, measured: int) -> DataFrame:
    """Winner on t-1 (ties: first name), its figure on t, and the spread of the search.

    ``ap`` has one row per (candidate, period, entity); the table of means is as small as
    the list of candidates.
    """
    means = mean_ap(ap.filter(F.col("period").isin(measured - 1, measured)), "candidate", "period")
    per_candidate = means.groupBy("candidate").agg(
        F.max(F.when(F.col("period") == measured - 1, F.col("map"))).alias("map_decision"),
        F.max(F.when(F.col("period") == measured, F.col("map"))).alias("map_measured"),
    )
    best = F.array_min(
        F.collect_list(
            F.struct(
                (-F.col("map_decision")).alias("worse"), "candidate", "map_decision", "map_measured"
            )
        )
    )
    return per_candidate.agg(
        best.alias("best"),
        F.count("*").alias("candidates"),
        (F.max("map_decision") - F.min("map_decision")).alias("search_range"),
    ).select(
        F.col("best.candidate").alias("candidate"),
        F.col("best.map_decision").alias("map_decision"),
        F.col("best.map_measured").alias("map_measured"),
        "candidates", "search_range",
    )


def noise_report(ap: DataFrame, gain: float) -> DataFrame:
    """Mean and population deviation of MAP over reruns, next to the gain being claimed."""
    means = mean_ap(ap, "seed")
    ordered = F.array_sort(F.collect_list("map"))

    def total(values):
        return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)

    summary = means.agg(ordered.alias("maps"), F.count("*").alias("reruns")).withColumn(
        "mean_map", total(F.col("maps")) / F.col("reruns")
    )
    spread = F.sqrt(
        total(F.transform("maps", lambda x: (x - F.col("mean_map")) * (x - F.col("mean_map"))))
        / F.col("reruns")
    )
    return summary.withColumn("std_map", spread).select(
        "reruns", "mean_map", "std_map", (F.lit(gain) > F.col("std_map")).alias("gain_above_noise")
    )
