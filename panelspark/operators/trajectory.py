"""Trajectories: the last L steps of an entity as three aligned lists of bit sets.

The frame counts rows, not periods, so a gap is compressed; the feature windows count
periods.  A step's ``state`` is what was held before it, next to its adds and drops, so
the newest step is complete through t-1 and nothing of t is inside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions import has_item
from panelspark.operators.reshape import explode_bits
from panelspark.spec import PanelSpec

LENGTH = 16


def trajectories(features: DataFrame, length: int = LENGTH) -> DataFrame:
    frame = Window.partitionBy("entity").orderBy("period").rowsBetween(-length, -1)
    steps = F.collect_list(F.struct("prev_bits", "add_bits", "drop_bits")).over(frame)
    return features.withColumn("steps", steps)


def trim_trajectory(df: DataFrame, length: int) -> DataFrame:
    """Keep the newest steps, pad with zeros on the left, report the real length."""
    size = F.size("steps")
    newest = F.slice("steps", F.greatest(size - length, F.lit(0)) + 1, length)
    empty = F.lit(0).cast("long")
    blank = F.struct(empty.alias("prev_bits"), empty.alias("add_bits"), empty.alias("drop_bits"))
    padding = F.array_repeat(blank, F.greatest(F.lit(length) - size, F.lit(0)))
    return df.withColumns(
        {"steps": F.concat(padding, newest), "real_length": F.least(size, F.lit(length))}
    )


def step_flags(step: Column, spec: PanelSpec) -> Column:
    """One step as 3 x n flags: state, adds, drops, each in catalogue order."""

    def flags(bits: str) -> Column:
        return F.transform(F.lit(list(range(spec.n))), lambda i: has_item(step[bits], i))

    return F.concat(flags("prev_bits"), flags("add_bits"), flags("drop_bits"))


def flatten_trajectory(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Padded steps as one flat 0/1 array, oldest step first."""
    flat = F.flatten(F.transform("steps", lambda s: step_flags(s, spec)))
    return df.withColumn("flags", flat)


def position_examples(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """From each real step, which items not held there are added at the next step.

    ``df`` carries unpadded ``steps``, so there is no padding to skip; the newest step
    has no next one inside the trajectory and yields nothing.
    """
    pairs = F.transform(
        F.slice("steps", 1, F.greatest(F.size("steps") - 1, F.lit(0))),
        lambda s, j: F.struct(
            s["prev_bits"].alias("state"), F.get(F.col("steps"), j + 1)["add_bits"].alias("next_adds")
        ),
    )
    positions = df.select("entity", "period", F.posexplode(pairs).alias("step", "pair")).select(
        "entity", "period", "step", "pair.state", "pair.next_adds"
    )
    return explode_bits(positions, F.bitwise_not("state"), spec).select(
        "entity", "period", "step", "idx", has_item(F.col("next_adds"), F.col("idx")).alias("label")
    )
