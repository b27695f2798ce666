"""Rank fusion of several models, and routing each segment to its best model.

Weights and rules are chosen on t-1 and applied on t.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions import ap_at_k_bits, full_order, micro, top_k
from panelspark.functions.fixedpoint import MICRO
from panelspark.operators.split import mean_ap
from panelspark.spec import PanelSpec

DAMPING = 60.0  # fixed value of the reciprocal-rank formula; positions start at 0

# fixed values: (label, first, last) of each segmentation; the top band is open
HISTORY_BANDS = (("1", 0, 1), ("2-3", 2, 3), ("4-6", 4, 6), ("7-11", 7, 11), ("12+", 12, None))
HOLDING_BANDS = (("0", 0, 0), ("1", 1, 1), ("2-3", 2, 3), ("4-5", 4, 5), ("6+", 6, None))


def reciprocal_ranks(scores: Column) -> Column:
    """1 / (60 + place) for every item, in catalogue order."""
    placed = F.transform(
        full_order(scores),
        lambda i, place: F.struct(i.alias("i"), (F.lit(1.0) / (F.lit(DAMPING) + place)).alias("r")),
    )
    return F.transform(F.array_sort(placed), lambda x: x["r"])


def rank_scores(scored: DataFrame) -> DataFrame:
    """Long form: one row per (entity, period, item) with its place and rank score."""
    return (
        scored.select("entity", "period", F.posexplode(full_order(F.col("scores"))).alias("place", "idx"))
        .withColumn("rank_score", F.lit(1.0) / (F.lit(DAMPING) + F.col("place")))
    )


def with_rank_arrays(rows: DataFrame, models: Sequence[str]) -> DataFrame:
    """``scores_<model>`` columns to ``rr_<model>`` columns."""
    return rows.withColumns({f"rr_{m}": reciprocal_ranks(F.col(f"scores_{m}")) for m in models})


def blended(models: Sequence[str], weights: Sequence[Column | float]) -> Column:
    """Weighted sum of the rank arrays, item by item, models in the given order."""
    columns = [w if isinstance(w, Column) else F.lit(float(w)) for w in weights]
    total = F.transform(F.col(f"rr_{models[0]}"), lambda x: columns[0] * x)
    for model, weight in zip(models[1:], columns[1:]):
        total = _add_weighted(total, F.col(f"rr_{model}"), weight)
    return total


def _add_weighted(total: Column, ranks: Column, weight: Column) -> Column:
    return F.zip_with(total, ranks, lambda a, b: a + weight * b)


def blend(rows: DataFrame, models: Sequence[str], weights: Sequence[Column | float], spec: PanelSpec) -> DataFrame:
    """Blended scores, held items masked, top K."""
    return rows.withColumn("scores", blended(models, weights)).withColumn(
        "recommended", top_k(F.col("scores"), F.col("prev_bits"), spec.k)
    )


def simplex_grid(models: int, parts: int = 10) -> list[tuple[int, ...]]:
    """All ways to share ``parts`` equal weights among the models."""
    return [w for w in product(range(parts + 1), repeat=models) if sum(w) == parts]


def search_weights(rows: DataFrame, models: Sequence[str], spec: PanelSpec, parts: int = 10) -> DataFrame:
    """MAP of every weight combination on the given (t-1) rows, best first.

    All combinations are tried on one Arrow batch of rows at a time as array arithmetic; a
    task hands on one partial sum per combination and batch, so the shuffle is grid-sized.
    """
    names = [f"w_{m}" for m in models]
    grid = simplex_grid(len(models), parts)
    k, n = spec.k, spec.n

    def partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                held, adds = (_bit_matrix(batch.column(c), n) for c in ("prev_bits", "add_bits"))
                ranks = [_list_matrix(batch.column(f"rr_{m}"), n) for m in models]
                sums = [_ap_sum(_weighted(ranks, w, parts), held, adds, k) for w in grid]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(range(len(grid)), pa.int32()),
                        pa.array(sums, pa.int64()),
                        pa.array([batch.num_rows] * len(grid), pa.int64()),
                    ],
                    ["g", "ap_sum", "clients"],
                )

    sums = (
        rows.filter(F.col("add_bits") != 0)
        .select("prev_bits", "add_bits", *[f"rr_{m}" for m in models])
        .mapInArrow(partial_sums, "g int, ap_sum long, clients long")
        .groupBy("g")
        .agg(F.sum("ap_sum").alias("ap_sum"), F.sum("clients").alias("clients"))
    )
    weights = [F.get(F.lit([w[j] for w in grid]), F.col("g")).alias(name) for j, name in enumerate(names)]
    order = Window.orderBy(F.desc("ap_sum"), *names)  # grid-sized
    return sums.select("clients", "ap_sum", *weights).select(
        "clients", *names,
        (F.col("ap_sum") / (F.col("clients") * F.lit(MICRO))).alias("map"),
        F.row_number().over(order).alias("place"),
    )


def _bit_matrix(column: pa.Array, n: int) -> np.ndarray:
    bits = column.to_numpy(zero_copy_only=False).astype(np.int64)
    return (bits[:, None] >> np.arange(n)) & 1


def _list_matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, n)


def _weighted(ranks: list[np.ndarray], weights: tuple[int, ...], parts: int) -> np.ndarray:
    total = (weights[0] / parts) * ranks[0]
    for weight, matrix in zip(weights[1:], ranks[1:]):
        total = total + (weight / parts) * matrix
    return total


def _ap_sum(scores: np.ndarray, held: np.ndarray, adds: np.ndarray, k: int) -> int:
    """Sum of AP@K in millionths; ties keep catalogue order, held items never count."""
    order = np.argsort(np.where(held == 1, np.inf, -scores), axis=1, kind="stable")[:, :k]
    found = np.take_along_axis(adds, order, axis=1)
    hits = np.zeros(len(scores))
    total = np.zeros(len(scores))
    for place in range(order.shape[1]):
        hits = hits + found[:, place]
        total = total + np.where(found[:, place] == 1, hits / (place + 1), 0.0)
    possible = np.minimum(adds.sum(axis=1), k)
    return int(np.floor(total / possible * MICRO + 0.5).sum())


def blend_with(rows: DataFrame, chosen: DataFrame, models: Sequence[str], spec: PanelSpec, parts: int = 10) -> DataFrame:
    """Blend with the weights of the winning row of ``search_weights``, without collecting it."""
    best = chosen.filter(F.col("place") == 1).select(
        F.lit(1).alias("one"), *[(F.col(f"w_{m}") / parts).alias(f"w_{m}") for m in models]
    )
    weights = [F.col(f"w_{m}") for m in models]
    weighted = rows.withColumn("one", F.lit(1)).join(F.broadcast(best), "one")
    return blend(weighted, models, weights, spec).drop("one", *[f"w_{m}" for m in models])


def blend_gain(ap: DataFrame, blend_name: str = "blend") -> DataFrame:
    """MAP of the blend against the best single model, from (model, ap_micro) rows."""
    means = mean_ap(ap, "model")
    single = F.col("model") != blend_name
    return means.agg(
        F.max(F.when(~single, F.col("map"))).alias("map_blend"),
        F.max(F.when(single, F.col("map"))).alias("map_best"),
        F.min(F.when(single, F.struct((-F.col("map")).alias("s"), "model")))["model"].alias("best_model"),
    ).withColumns(
        {
            "gain": F.col("map_blend") - F.col("map_best"),
            "gain_pct": 100 * (F.col("map_blend") - F.col("map_best")) / F.greatest("map_best", F.lit(1e-9)),
        }
    )


def segment_label(column: Column, bands: Sequence[tuple[str, int, int | None]]) -> Column:
    """Band label; a value outside every band gets none."""
    label = F.lit(None).cast("string")
    for name, first, last in reversed(bands):
        inside = column >= first if last is None else column.between(first, last)
        label = F.when(inside, F.lit(name)).otherwise(label)
    return label


def with_segment(df: DataFrame, column: str, bands=HISTORY_BANDS) -> DataFrame:
    return df.withColumn("segment", segment_label(F.col(column), bands)).filter(
        F.col("segment").isNotNull()
    )


def ap_by_client(rows: DataFrame, models: Sequence[str], spec: PanelSpec, keep: Sequence[str] = ()) -> DataFrame:
    """One row per (entity, period, model) with its AP; no scores counts as 0.

    The models sit side by side in one row, so comparing them needs no join.
    """

    def ap_of(model: str) -> Column:
        listed = top_k(F.col(f"scores_{model}"), F.col("prev_bits"), spec.k)
        return micro(ap_at_k_bits(listed, F.col("add_bits"), spec.k))

    entries = F.array(
        *[F.struct(F.lit(m).alias("model"), ap_of(m).alias("ap_micro")) for m in models]
    )
    return rows.filter(F.col("add_bits") != 0).select("entity", "period", *keep, F.inline(entries))


def segment_winners(ap: DataFrame, keys: Sequence[str] = ("segment",)) -> DataFrame:
    """Per segment: entities, the model with the highest MAP (ties: first name) and that MAP."""
    means = mean_ap(ap, *keys, "model")
    ranked = F.min(F.struct((-F.col("ap_sum")).alias("s"), "model", "map", "clients"))
    return means.groupBy(*keys).agg(ranked.alias("best")).select(
        *keys, F.col("best.clients").alias("clients"),
        F.col("best.model").alias("winner"), F.col("best.map").alias("map"),
    )


def route(ap: DataFrame, measured: int) -> DataFrame:
    """Per segment on t: the model the rule of t-1 picks, and its MAP there.

    Segments unseen on t-1 fall back to the best single model of t-1.
    """
    decided = ap.filter(F.col("period") == measured - 1)
    rule = segment_winners(decided).select("segment", F.col("winner").alias("rule"))
    overall = segment_winners(decided.withColumn("all", F.lit(1)), ("all",)).select(
        "all", F.col("winner").alias("fallback")
    )
    means = mean_ap(ap.filter(F.col("period") == measured), "segment", "model")
    return (
        means.join(F.broadcast(rule), "segment", "left")
        .withColumn("all", F.lit(1))
        .join(F.broadcast(overall), "all", "left")
        .withColumn("chosen", F.coalesce("rule", "fallback"))
        .filter(F.col("model") == F.col("chosen"))
        .select("segment", "clients", "chosen", "ap_sum", "map")
    )


def routing_gain(ap: DataFrame, measured: int) -> DataFrame:
    """Client-weighted MAP of the routed base against the best single model on t."""
    routed = route(ap, measured).agg(
        F.sum("ap_sum").alias("routed_sum"), F.sum("clients").alias("clients")
    ).withColumn("one", F.lit(1))
    single = mean_ap(ap.filter(F.col("period") == measured), "model").agg(
        F.max("map").alias("map_best"),
        F.min(F.struct((-F.col("ap_sum")).alias("s"), "model"))["model"].alias("best_model"),
    ).withColumn("one", F.lit(1))
    routed_map = F.col("routed_sum") / (F.col("clients") * F.lit(MICRO))
    return routed.join(F.broadcast(single), "one").select(
        "clients", routed_map.alias("map_routed"), "map_best", "best_model",
        (100 * (routed_map - F.col("map_best")) / F.greatest("map_best", F.lit(1e-9))).alias("gain_pct"),
    )


def rule_stability(ap: DataFrame, measured: int) -> DataFrame:
    """How many segments have another winner on t than on t-1."""
    winners = segment_winners(
        ap.filter(F.col("period").isin(measured - 1, measured)), ("segment", "period")
    )
    before = winners.filter(F.col("period") == measured - 1).select("segment", F.col("winner").alias("before"))
    after = winners.filter(F.col("period") == measured).select("segment", F.col("winner").alias("after"))
    return after.join(F.broadcast(before), "segment", "left").agg(
        F.count("*").alias("segments"),
        F.count_if(~F.col("before").eqNullSafe(F.col("after"))).alias("changed"),
    )


def history_distribution(rows: DataFrame) -> DataFrame:
    """Evaluable entities by history length, with running share; the table is calendar-sized."""
    counts = rows.filter(F.col("add_bits") != 0).groupBy("history").agg(F.count("*").alias("clients"))
    running = Window.orderBy("history").rowsBetween(Window.unboundedPreceding, 0)
    return counts.select(
        "history", "clients",
        (100 * F.col("clients") / F.sum("clients").over(Window.partitionBy())).alias("pct"),
        (100 * F.sum("clients").over(running) / F.sum("clients").over(Window.partitionBy())).alias("cumulative_pct"),
    )
