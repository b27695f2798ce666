"""Panel features: what was true at t-1, and what changed at t.

Every window here partitions by entity and orders by period, so one exchange and one
sort serve all of them.  Panel columns are ``entity, period, held, activity``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions import TENURE_PERIODS, has_item, tenure_of
from panelspark.spec import PanelSpec

RECENT_PERIODS = 3


def _by_entity():
    return Window.partitionBy("entity").orderBy("period")


def with_previous(panel: DataFrame, attributes: Sequence[str] = ("activity",)) -> DataFrame:
    """State and attributes of the entity's previous observed row."""
    w = _by_entity()
    return panel.withColumns(
        {
            "prev_period": F.lag("period").over(w),
            "prev_bits": F.lag("held").over(w),
            **{f"prev_{a}": F.lag(a).over(w) for a in attributes},
        }
    )


def consecutive_only(df: DataFrame) -> DataFrame:
    """Drop an entity's first row and rows after a gap: t-1 must be the period before."""
    return df.filter(F.col("period") - F.col("prev_period") == 1)


def discard_audit(panel: DataFrame) -> DataFrame:
    """One row: how many rows are usable, first or behind a gap."""
    step = F.col("period") - F.col("prev_period")
    counted = with_previous(panel, ()).agg(
        F.count("*").alias("rows_in"),
        F.count_if(step == 1).alias("rows_out"),
        F.count_if(F.col("prev_period").isNull()).alias("first_rows"),
        F.count_if(step > 1).alias("gap_rows"),
    )
    return counted.withColumns(
        {
            "discarded": F.col("rows_in") - F.col("rows_out"),
            "pct_discarded": 100 * (F.col("rows_in") - F.col("rows_out")) / F.col("rows_in"),
        }
    )


def with_transitions(df: DataFrame) -> DataFrame:
    """Adds and drops as bit sets; an unknown state means "does not hold"."""
    now, before = F.coalesce("held", F.lit(0).cast("long")), F.coalesce("prev_bits", F.lit(0).cast("long"))
    return df.withColumns(
        {
            "prev_bits": before,
            "add_bits": now.bitwiseAND(F.bitwise_not(before)),
            "drop_bits": before.bitwiseAND(F.bitwise_not(now)),
        }
    )


def with_counts(df: DataFrame, spec: PanelSpec) -> DataFrame:
    return df.withColumns(
        {
            "n_prev": F.bit_count("prev_bits"),
            "n_adds": F.bit_count("add_bits"),
            "n_drops": F.bit_count("drop_bits"),
            "season": F.pmod("period", F.lit(spec.season_length)) + 1,
        }
    )


def with_tenure(df: DataFrame, periods: int = TENURE_PERIODS) -> DataFrame:
    """Previous states of the last periods; ``tenure_of`` reads one item's tenure off them.

    RANGE frame: a missing period counts as one not held, not as a longer reach back.
    """
    frame = _by_entity().rangeBetween(-(periods - 1), 0)
    return df.withColumn("recent_states", F.collect_list("prev_bits").over(frame))


def with_recent_activity(df: DataFrame, periods: int = RECENT_PERIODS) -> DataFrame:
    frame = _by_entity().rangeBetween(-periods, -1)
    return df.withColumns(
        {
            "adds_recent": F.coalesce(F.sum("n_adds").over(frame), F.lit(0)),
            "drops_recent": F.coalesce(F.sum("n_drops").over(frame), F.lit(0)),
        }
    )


def with_history_length(df: DataFrame) -> DataFrame:
    """Usable rows of the entity before this one."""
    frame = _by_entity().rangeBetween(Window.unboundedPreceding, -1)
    return df.withColumn("history", F.count("period").over(frame))


def build_features(panel: DataFrame, spec: PanelSpec) -> DataFrame:
    """The feature table.

    The consecutive filter runs before tenure, recent activity and history, so these
    count usable rows only: what an entity did just before a gap is not seen after it.
    """
    rows = with_counts(consecutive_only(with_transitions(with_previous(panel))), spec)
    return with_history_length(with_recent_activity(with_tenure(rows))).select(
        "entity", "period", "season", "prev_activity",
        "prev_bits", "add_bits", "drop_bits", "n_prev", "n_adds", "n_drops",
        "recent_states", "adds_recent", "drops_recent", "history",
    )


def widen(features: DataFrame, spec: PanelSpec) -> DataFrame:
    """One column per item for prev, tenure, add and drop; a projection, no shuffle."""
    per_item = [
        column
        for prefix, value in (
            ("prev", lambda i: has_item(F.col("prev_bits"), i)),
            ("tenure", lambda i: tenure_of(F.col("recent_states"), i)),
            ("add", lambda i: has_item(F.col("add_bits"), i)),
            ("drop", lambda i: has_item(F.col("drop_bits"), i)),
        )
        for column in (value(i).alias(f"{prefix}_{i}") for i in range(spec.n))
    ]
    kept = [c for c in features.columns if not c.endswith("_bits") and c != "recent_states"]
    return features.select(*kept, *per_item)


def panel_summary(features: DataFrame) -> DataFrame:
    """Adds, drops, distinct entities and periods, mean holdings.

    Distinct entities and periods are reduced inside each task before they are shuffled.
    """
    totals = features.agg(
        F.sum("n_adds").alias("adds"), F.sum("n_drops").alias("drops"),
        F.count_distinct("entity").alias("entities"),
        F.count_distinct("period").alias("periods"),
        F.sum("n_prev").alias("held"), F.count("*").alias("rows"),
    )
    return totals.select(
        "adds", "drops", "entities", "periods",
        (F.col("held") / F.col("rows")).alias("mean_held"), "rows",
    )


def item_counts(df: DataFrame, sets: dict[str, str], spec: PanelSpec, keys: Sequence[str] = ()) -> DataFrame:
    """Per item, in how many rows each bit set contains it.

    One pass with partial sums: the shuffle carries one row per key, never one per item.
    """
    totals = df.groupBy(*keys).agg(
        *[
            F.sum(has_item(F.col(bits), i)).alias(f"{name}_{i}")
            for name, bits in sets.items()
            for i in range(spec.n)
        ]
    )
    entries = F.array(
        *[
            F.struct(
                F.lit(i).alias("idx"), F.lit(item).alias("item"),
                *[F.coalesce(f"{name}_{i}", F.lit(0).cast("long")).alias(name) for name in sets],
            )
            for i, item in enumerate(spec.items)
        ]
    )
    return totals.select(*keys, F.inline(entries))


def transitions_by_item(features: DataFrame, spec: PanelSpec) -> DataFrame:
    """Adds and drops per item with the item's share of all adds and its rank."""
    counts = item_counts(features, {"adds": "add_bits", "drops": "drop_bits"}, spec)
    everything = Window.partitionBy()  # at most one row per catalogue item
    return counts.withColumns(
        {
            "rank": F.row_number().over(everything.orderBy(F.desc("adds"), "idx")),
            "share_pct": 100 * F.col("adds") / F.greatest(F.sum("adds").over(everything), F.lit(1)),
        }
    )


def check_panel(features: DataFrame, spec: PanelSpec) -> None:
    """Raise if a row has more transitions than the catalogue has items, or one both ways."""
    bad = features.filter(
        (F.col("n_adds") > spec.n)
        | (F.col("n_drops") > spec.n)
        | (F.col("add_bits").bitwiseAND(F.col("drop_bits")) != 0)
        | (F.col("add_bits").bitwiseAND(F.col("prev_bits")) != 0)
    )
    if not bad.isEmpty():
        raise ValueError("a row has impossible transitions: check the lags")
