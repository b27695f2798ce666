"""Isotonic calibration whose pooling runs in Spark tasks.

Scores become whole millionths, so there are at most SCORE_GRID + 1 points whatever the row
count.  Points are cut into ranges of even point numbers; each range pools its adjacent
violators, and neighbouring ranges merge their blocks FAN at a time until one is left.  Rates are
compared as whole-number products, so no result depends on partitions.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.operators.metrics import with_range
from panelspark.session import materialize

SCORE_GRID = 1_000_000  # points between 0 and 1
RANGES = 64
FAN = 8

BLOCKS = "range int, low long, high long, n long, pos long, next_low long, next_n long, next_pos long, first boolean"


def grid_point(score: Column) -> Column:
    inside = F.greatest(F.lit(0.0), F.least(score, F.lit(1.0)))
    return F.when(score.isNotNull(), F.floor(inside * SCORE_GRID + 0.5).cast("long"))


def calibration_points(df: DataFrame, score: str, label: str = "label") -> DataFrame:
    """(point, n, pos) per distinct millionth of score."""
    known = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    return known.groupBy(grid_point(F.col(score)).alias("point")).agg(
        F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("pos")
    )


def pooled(blocks: Iterable[tuple[int, int, int, int]]) -> list[list[int]]:
    """(low, high, n, pos) blocks in rising order, merged until their rates rise."""
    out: list[list[int]] = []
    for low, high, n, pos in blocks:
        out.append([low, high, n, pos])
        while len(out) > 1 and out[-2][3] * out[-1][2] >= out[-1][3] * out[-2][2]:
            _, high, n, pos = out.pop()
            out[-1][1] = high
            out[-1][2] += n
            out[-1][3] += pos
    return out


def isotonic_blocks(points: DataFrame) -> DataFrame:
    """Blocks of equal rate, each with what is known of the next one."""
    def pool(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("low")
        made = pooled(group[["low", "high", "n", "pos"]].itertuples(index=False, name=None))
        part = int(group["range"].iloc[0])
        after = [[b[0], b[2], b[3]] for b in made[1:]] + [[None] * 3]
        rows = [(part, *map(int, b), *follow, i == 0) for i, (b, follow) in enumerate(zip(made, after, strict=True))]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in BLOCKS.split(", ")])

    start = with_range(materialize(points.withColumn("score", F.col("point").cast("double"))), RANGES)
    blocks = start.select("range", F.col("point").alias("low"), F.col("point").alias("high"), "n", "pos")
    width = RANGES
    while True:
        blocks = blocks.groupBy("range").applyInPandas(pool, BLOCKS)
        if width == 1:
            return blocks.drop("range")
        width = -(-width // FAN)
        blocks = blocks.withColumn("range", F.expr(f"cast(range div {FAN} as int)"))


def calibration_map(blocks: DataFrame) -> DataFrame:
    """(point, p) for every point of the grid: the block's rate, straight lines between blocks.

    Points before the first block and after the last take the nearest rate.
    """
    rate, following = F.col("pos") / F.col("n"), F.col("next_pos") / F.col("next_n")
    spread = blocks.withColumn("from", F.when(F.col("first"), F.lit(0)).otherwise(F.col("low")))
    each = spread.select(
        "*", F.explode(F.sequence("from", F.coalesce(F.col("next_low") - 1, F.lit(SCORE_GRID)))).alias("point")
    )
    way = (F.col("point") - F.col("high")) / (F.col("next_low") - F.col("high"))
    between = (F.col("point") > F.col("high")) & F.col("next_low").isNotNull()
    return each.select("point", F.when(between, rate + (following - rate) * way).otherwise(rate).alias("p"))


def apply_map(target: DataFrame, found: DataFrame, raw: str, out: str) -> DataFrame:
    """Target rows with their calibrated value; a null score stays null."""
    keyed = target.withColumn("__point", grid_point(F.col(raw)))
    values = found.select(F.col("point").alias("__point"), F.col("p").alias(out))
    return keyed.join(values, "__point", "left").drop("__point")
