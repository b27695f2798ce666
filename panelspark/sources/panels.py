"""Panels built from the given tables.

Raw rows are OR-ed into one bit set per (entity, period) before anything is keyed by
entity, so an entity owning a third of the raw rows reaches the windows with one row
per period.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions import known_mask
from panelspark.spec import DAILY, QUARTERLY, PanelSpec

DAY_ZERO = "2024-01-01"
YEAR_ZERO = 1995
MISSING_PRIORITY = "4-NOT SPECIFIED"


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def period_index(column, unit: str, origin: int | str):
    """Whole periods since the origin, so that a frame of 3 means 3 calendar periods."""
    if unit == "day":
        return F.datediff(column.cast("date"), F.lit(origin).cast("date"))
    if unit == "month":
        return (F.year(column) - origin) * 12 + F.month(column) - 1
    if unit == "quarter":
        return (F.year(column) - origin) * 4 + F.quarter(column) - 1
    raise ValueError(f"unknown period unit: {unit}")


def daily_panel(spark: SparkSession, folder: str) -> DataFrame:
    """(user, day): which event types happened, and how many events."""
    events = table(spark, folder, "events", "user_id", "ts", "event_type")
    return (
        events.select(
            F.col("user_id").alias("entity"),
            period_index(F.col("ts"), "day", DAY_ZERO).alias("period"),
            known_mask(F.col("event_type"), DAILY.items).alias("mask"),
        )
        .groupBy("entity", "period")
        .agg(
            F.coalesce(F.bit_or("mask"), F.lit(0).cast("long")).alias("held"),
            F.count("*").alias("activity"),
        )
    )


def quarterly_panel(spark: SparkSession, folder: str) -> DataFrame:
    """(customer, quarter): which brands were bought, and how many orders.

    Lines collapse to one bit set per order before the order join, orders to one per
    (customer, quarter) before the windows.
    """
    masks = table(spark, folder, "part", "p_partkey", "p_brand").select(
        F.col("p_partkey").alias("l_partkey"),
        known_mask(F.col("p_brand"), QUARTERLY.items).alias("mask"),
    )
    per_order = (
        table(spark, folder, "lineitem", "l_orderkey", "l_partkey")
        .join(masks, "l_partkey")
        .groupBy("l_orderkey")
        .agg(F.bit_or("mask").alias("mask"))
    )
    orders = table(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    return (
        orders.join(per_order, F.col("o_orderkey") == F.col("l_orderkey"))
        .select(
            F.col("o_custkey").alias("entity"),
            period_index(F.col("o_orderdate"), "quarter", YEAR_ZERO).alias("period"),
            "mask",
        )
        .groupBy("entity", "period")
        .agg(
            F.coalesce(F.bit_or("mask"), F.lit(0).cast("long")).alias("held"),
            F.count("*").alias("activity"),
        )
    )


def build_panel(spark: SparkSession, folder: str, spec: PanelSpec) -> DataFrame:
    return {DAILY.name: daily_panel, QUARTERLY.name: quarterly_panel}[spec.name](spark, folder)


def period_calendar(spark: SparkSession, folder: str, spec: PanelSpec) -> DataFrame:
    """(period, first, last): the days that occur in each period of the raw rows."""
    name, column, unit, origin = {
        DAILY.name: ("events", "ts", "day", DAY_ZERO), QUARTERLY.name: ("orders", "o_orderdate", "quarter", YEAR_ZERO),
    }[spec.name]
    day = F.col(column).cast("date")
    rows = table(spark, folder, name, column).select(period_index(F.col(column), unit, origin).alias("period"), day.alias("day"))
    return rows.groupBy("period").agg(F.min("day").alias("first"), F.max("day").alias("last"))


def customer_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Static attributes of the quarterly panel's entities; a negative balance is the sentinel."""
    customer = table(
        spark, folder, "customer", "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"
    )
    nation = table(spark, folder, "nation", "n_nationkey", "n_name", "n_regionkey")
    region = table(spark, folder, "region", "r_regionkey", "r_name")
    return (
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
        .select(
            F.col("c_custkey").alias("entity"),
            F.col("c_mktsegment").alias("segment"),
            F.col("n_name").alias("province"),
            F.col("r_name").alias("region"),
            F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("income"),
        )
    )
