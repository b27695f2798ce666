"""Per-entity ranking expressions: everything stays inside one row, with no shuffle.

Score arrays enter as the argument of a higher-order function, never inside its lambda:
an expression inside a lambda is evaluated again for every element.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelspark.functions.bits import has_item


def _keyed(scores: Column, excluded: Column | None = None) -> Column:
    """(score, position) per item, without the excluded set."""
    keyed = F.transform(scores, lambda s, i: F.struct((-s).alias("s"), i.alias("i")))
    if excluded is None:
        return keyed
    return F.filter(keyed, lambda x: has_item(excluded, x["i"]) == 0)


def full_order(scores: Column, excluded: Column | None = None) -> Column:
    """Catalogue positions by falling score, ties by position, without the excluded set."""
    return F.transform(F.array_sort(_keyed(scores, excluded)), lambda x: x["i"])


def top_k(scores: Column, held: Column, k: int) -> Column:
    """The K best items the entity does not hold yet."""
    return F.transform(F.slice(F.array_sort(_keyed(scores, held)), 1, k), lambda x: x["i"])


def best_open(scores: Column, held: Column) -> Column:
    """Score of the best item not held; null when everything is held."""
    return -F.array_min(_keyed(scores, held))["s"]


def _fold_precision(predicted: Column, k: int, is_hit) -> Column:
    """Sum of precision at each hit: a left fold that carries place, hits and total."""
    start = F.struct(
        F.lit(0).alias("pos"), F.lit(0).alias("hits"), F.lit(0.0).cast("double").alias("total")
    )

    def step(acc: Column, item: Column) -> Column:
        hit = is_hit(item)
        hits = acc["hits"] + F.when(hit, 1).otherwise(0)
        pos = acc["pos"] + 1
        return F.struct(
            pos.alias("pos"),
            hits.alias("hits"),
            (acc["total"] + F.when(hit, hits.cast("double") / pos).otherwise(F.lit(0.0))).alias("total"),
        )

    folded = F.aggregate(F.slice(predicted, 1, k), start, step, lambda acc: acc["total"])
    return F.coalesce(folded, F.lit(0.0))


def _over_possible(total: Column, n_actual: Column, k: int) -> Column:
    return F.when(n_actual > 0, total / F.least(n_actual, F.lit(k))).otherwise(F.lit(0.0))


def ap_at_k(predicted: Column, actual: Column, k: int) -> Column:
    """Average precision of a list against a list; 0 if either is null or empty."""
    total = _fold_precision(predicted, k, lambda item: F.array_contains(actual, item))
    return _over_possible(total, F.size(F.array_distinct(actual)), k)


def ap_at_k_bits(predicted: Column, actual_bits: Column, k: int) -> Column:
    """The same against a bit set, for lists of catalogue positions."""
    total = _fold_precision(predicted, k, lambda i: has_item(actual_bits, i) == 1)
    return _over_possible(total, F.bit_count(actual_bits), k)
