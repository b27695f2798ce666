"""Arithmetic whose result does not depend on row or partition order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICRO = 1_000_000


def micro(value: Column) -> Column:
    """A double as whole millionths, so that sums are exact in any order."""
    return F.floor(value * MICRO + 0.5).cast("long")


def pseudo_random(entity: Column, period: Column, item: Column | None = None, seed: Column | int = 0) -> Column:
    """Repeatable order or sampling key in [0, 2^60); unlike ``rand`` it survives a re-run task.

    The digits of a digest are mixed, so items of one row come in any order and two seeds
    draw independently of one another.
    """
    parts = [entity, period, F.lit("") if item is None else item, seed if isinstance(seed, Column) else F.lit(seed)]
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
