"""Between one row per (entity, period) and one row per item."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions import has_item, held_names, item_numbers, pseudo_random, tenure_of
from panelspark.spec import PanelSpec

KEYS = ("entity", "period")


def actual_items(features: DataFrame, spec: PanelSpec) -> DataFrame:
    """Items taken up, for entities that took up at least one."""
    return features.filter(F.col("add_bits") != 0).select(
        *KEYS, held_names(F.col("add_bits"), spec.items).alias("actual")
    )


def held_items(features: DataFrame, spec: PanelSpec) -> DataFrame:
    return features.select(*KEYS, held_names(F.col("prev_bits"), spec.items).alias("held"))


def explode_bits(df: DataFrame, bits, spec: PanelSpec) -> DataFrame:
    """One row per item of the set, as ``idx``.

    The constant catalogue is exploded and filtered by its bit: both stay in generated
    code, where filtering an array first would not.
    """
    return df.select("*", F.explode(F.lit(list(range(spec.n)))).alias("idx")).filter(
        has_item(bits, F.col("idx")) == 1
    )


def _item_name(spec: PanelSpec):
    return F.get(F.array(*[F.lit(x) for x in spec.items]), F.col("idx")).alias("item")


def explode_adds(features: DataFrame, spec: PanelSpec, keep: Sequence[str] = KEYS) -> DataFrame:
    """One row per add."""
    carried = list(dict.fromkeys([*keep, "add_bits"]))
    rows = features.filter(F.col("add_bits") != 0).select(*carried)
    return explode_bits(rows, F.col("add_bits"), spec).select(*keep, "idx", _item_name(spec))


def explode_held(features: DataFrame, spec: PanelSpec, keep: Sequence[str] = KEYS) -> DataFrame:
    """One row per held item with its drop label and tenure.

    Only the kept columns and three set columns enter the explode, and only held items
    come out of it.
    """
    carried = list(dict.fromkeys([*keep, "prev_bits", "drop_bits", "recent_states"]))
    return explode_bits(features.select(*carried), F.col("prev_bits"), spec).select(
        *keep, "idx", _item_name(spec),
        has_item(F.col("drop_bits"), F.col("idx")).alias("label"),
        tenure_of(F.col("recent_states"), F.col("idx")).alias("tenure"),
    )


def explode_open(features: DataFrame, spec: PanelSpec, keep: Sequence[str] = KEYS) -> DataFrame:
    """One row per item not held, labelled 1 if it was taken up."""
    carried = list(dict.fromkeys([*keep, "prev_bits", "add_bits"]))
    missing = F.bitwise_not(F.col("prev_bits"))
    return explode_bits(features.select(*carried), missing, spec).select(
        *keep, "idx", _item_name(spec), has_item(F.col("add_bits"), F.col("idx")).alias("label")
    )


def group_candidates(spec: PanelSpec, negatives: int) -> Column:
    """Every add and up to ``negatives`` sampled open items of a row."""
    idle = F.bitwise_not(F.col("prev_bits").bitwiseOR(F.col("add_bits")))
    drawn = F.array_sort(
        F.transform(
            item_numbers(idle, spec.n),
            lambda i: F.struct(
                pseudo_random(F.col("entity"), F.col("period"), i).alias("r"), i.alias("i")
            ),
        )
    )
    sampled = F.transform(F.slice(drawn, 1, negatives), lambda x: x["i"])
    return F.concat(item_numbers(F.col("add_bits"), spec.n), sampled)


def ranking_groups(
    features: DataFrame, spec: PanelSpec, negatives: int = 6, keep: Sequence[str] = KEYS
) -> DataFrame:
    """Every add plus up to ``negatives`` sampled open items, for rows with at least one add.

    A group is one row's catalogue, so the sample is drawn inside the row: the open items
    are ordered by a repeatable hash and the first few kept.  No window, no shuffle.
    """
    carried = list(dict.fromkeys([*keep, "entity", "period", "prev_bits", "add_bits"]))
    candidates = group_candidates(spec, negatives)
    return (
        features.filter(F.col("add_bits") != 0)
        .select(*carried)
        .select("*", F.explode(candidates).alias("idx"))
        .select(*keep, "idx", _item_name(spec), has_item(F.col("add_bits"), F.col("idx")).alias("label"))
    )


def score_candidates(features: DataFrame, spec: PanelSpec, keep: Sequence[str] = KEYS) -> DataFrame:
    """The whole catalogue for every row, with the held flag; a per-row explode, not a join."""
    carried = list(dict.fromkeys([*keep, "prev_bits"]))
    return (
        features.select(*carried)
        .select("*", F.explode(F.lit(list(range(spec.n)))).alias("idx"))
        .select(*keep, "idx", _item_name(spec), has_item(F.col("prev_bits"), F.col("idx")).alias("held"))
    )


def interaction_counts(features: DataFrame, spec: PanelSpec, signal: str = "held") -> DataFrame:
    """(entity, idx, rating): in how many periods the entity held (or took up) the item.

    Counts are summed as one array per entity before rows per item appear.
    """
    bits = {"held": "prev_bits", "add": "add_bits"}[signal]
    totals = features.groupBy("entity").agg(
        *[F.sum(has_item(F.col(bits), i)).alias(f"c{i}") for i in range(spec.n)]
    )
    counts = F.array(*[F.col(f"c{i}") for i in range(spec.n)])
    return (
        totals.select("entity", F.posexplode(counts).alias("idx", "rating"))
        .filter(F.col("rating") > 0)
    )


def sample_rows(df: DataFrame, per_mille: int, seed: int = 0) -> DataFrame:
    """Keep about per_mille/1000 of the (entity, period) rows, the same ones on every run."""
    key = pseudo_random(F.col("entity"), F.col("period"), seed=seed)
    return df.filter(F.pmod(key, F.lit(1000)) < per_mille)


def random_split(df: DataFrame, per_mille: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    key = F.pmod(pseudo_random(F.col("entity"), F.col("period"), seed=seed), F.lit(1000))
    return df.filter(key < per_mille), df.filter(key >= per_mille)


def sampled_negatives_window(long: DataFrame, negatives: int, seed: int = 0) -> DataFrame:
    """The same draw for a table that is already long: positives plus N per group by hash rank."""
    order = Window.partitionBy(*KEYS, "label").orderBy(
        pseudo_random(F.col("entity"), F.col("period"), F.col("idx"), seed), "idx"
    )
    return (
        long.withColumn("place", F.row_number().over(order))
        .filter((F.col("label") == 1) | (F.col("place") <= negatives))
        .drop("place")
    )
