"""Panel features and reshaping (W*, R*)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelspark.functions import bits_of, has_item, tenure_of
from panelspark.operators import features as feat
from panelspark.operators import reshape, trajectory
from panelspark.registry.core import Data, query
from panelspark.session import materialize


def joined(array: Column) -> Column:
    """Arrays are compared as text."""
    return F.array_join(array.cast("array<string>"), ",")


def per_item(spec, value) -> Column:
    return joined(F.transform(F.lit(list(range(spec.n))), value))


@query("w1_period_index", "ab")
def _(d: Data):
    return d.panel.select("entity", "period", "activity", "held")


@query("w2_previous_row", "ab")
def _(d: Data):
    return feat.with_previous(d.panel).select(
        "entity", "period", "prev_period", "prev_bits", "prev_activity"
    )


@query("w3_discard_audit", "ab")
def _(d: Data):
    return feat.discard_audit(d.panel)


@query("w3_consecutive_only", "ab")
def _(d: Data):
    return feat.consecutive_only(feat.with_previous(d.panel)).select("entity", "period", "held", "prev_bits")


@query("w4_transitions", "ab")
def _(d: Data):
    rows = feat.consecutive_only(feat.with_transitions(feat.with_previous(d.panel)))
    return rows.select("entity", "period", "prev_bits", "add_bits", "drop_bits")


@query("w5_row_counts", "ab")
def _(d: Data):
    rows = feat.consecutive_only(feat.with_transitions(feat.with_previous(d.panel)))
    return feat.with_counts(rows, d.spec).select(
        "entity", "period", "n_prev", "n_adds", "n_drops", "season"
    )


@query("w6_tenure", "ab")
def _(d: Data):
    return d.features.select(
        "entity", "period", "recent_states", F.explode(F.lit(list(range(d.spec.n)))).alias("idx")
    ).select("entity", "period", "idx", tenure_of(F.col("recent_states"), F.col("idx")).alias("tenure"))


@query("w7_recent_activity", "ab")
def _(d: Data):
    return d.features.select("entity", "period", "adds_recent", "drops_recent")


@query("w8_history_length", "ab")
def _(d: Data):
    return d.features.select("entity", "period", "history")


@query("w9_feature_table", "ab")
def _(d: Data):
    def flags(bits: str) -> Column:
        return per_item(d.spec, lambda i: has_item(F.col(bits), i))

    return d.features.select(
        "entity", "period", "season", "prev_activity", "n_prev", "n_adds", "n_drops",
        "adds_recent", "drops_recent", "history",
        flags("prev_bits").alias("prev"), flags("add_bits").alias("added"),
        flags("drop_bits").alias("dropped"),
        per_item(d.spec, lambda i: tenure_of(F.col("recent_states"), i)).alias("tenures"),
    )


@query("w10_panel_summary", "ab")
def _(d: Data):
    return feat.panel_summary(d.features)


@query("w11_transitions_by_item", "ab")
def _(d: Data):
    return feat.transitions_by_item(d.features, d.spec)


@query("w13_pack_bits", "ab")
def _(d: Data):
    wide = feat.widen(d.features, d.spec)
    return wide.select(
        "entity", "period",
        *[
            bits_of([F.col(f"{prefix}_{i}") for i in range(d.spec.n)]).alias(f"{prefix}_bits")
            for prefix in ("prev", "add", "drop")
        ],
    )


@query("w14_trajectories", "ab")
def _(d: Data):
    return trajectory.trajectories(d.features).select(
        "entity", "period",
        joined(F.col("steps.prev_bits")).alias("states"),
        joined(F.col("steps.add_bits")).alias("adds"),
        joined(F.col("steps.drop_bits")).alias("drops"),
    )


@query("w15_trim_trajectory", "ab")
def _(d: Data):
    trimmed = trajectory.trim_trajectory(trajectory.trajectories(d.features), 5)
    return trimmed.select(
        "entity", "period", "real_length", joined(F.col("steps.prev_bits")).alias("states"),
        joined(F.col("steps.add_bits")).alias("adds"),
    )


@query("w16_flatten_trajectory", "ab")
def _(d: Data):
    trimmed = trajectory.trim_trajectory(trajectory.trajectories(d.features), trajectory.LENGTH)
    flat = trajectory.flatten_trajectory(trimmed, d.spec)
    return flat.select("entity", "period", "real_length", joined(F.col("flags")).alias("flags"))


@query("w17_position_examples", "ab")
def _(d: Data):
    return trajectory.position_examples(trajectory.trajectories(d.features), d.spec)


@query("r1_actual_items", "ab")
def _(d: Data):
    rows = reshape.actual_items(d.features, d.spec)
    return rows.select("entity", "period", F.array_join("actual", ",").alias("actual"))


@query("r2_held_items", "ab")
def _(d: Data):
    rows = reshape.held_items(d.features, d.spec)
    return rows.select("entity", "period", F.array_join("held", ",").alias("held"))


@query("r3_explode_adds", "ab")
def _(d: Data):
    return reshape.explode_adds(d.features, d.spec)


@query("r4_explode_held", "ab")
def _(d: Data):
    return reshape.explode_held(d.features, d.spec)


@query("r5_ranking_groups", "ab")
def _(d: Data):
    return reshape.ranking_groups(d.features, d.spec, negatives=d.spec.negatives)


@query("r6_score_candidates", "ab")
def _(d: Data):
    return reshape.score_candidates(d.features, d.spec)


@query("r7_interaction_counts", "ab")
def _(d: Data):
    return reshape.interaction_counts(d.features, d.spec, "held")


@query("r7_interaction_counts_adds", "ab")
def _(d: Data):
    return reshape.interaction_counts(d.features, d.spec, "add")


@query("r9_sample_rows", "ab")
def _(d: Data):
    return reshape.sample_rows(d.features, 200, seed=42).select("entity", "period")


@query("r9_random_split", "ab")
def _(d: Data):
    train, test = reshape.random_split(d.features, 800, seed=42)
    return (
        train.select("entity", "period", F.lit("train").alias("part"))
        .unionByName(test.select("entity", "period", F.lit("test").alias("part")))
    )


@query("w12_panel_guards", "ab")
def _(d: Data):
    """Rows that the guard accepts, and whether it refuses the same rows under a catalogue of one item."""
    rows = materialize(d.features)

    def refused(spec) -> bool:
        try:
            feat.check_panel(rows, spec)
        except ValueError:
            return True
        return False

    one = replace(d.spec, items=d.spec.items[:1])
    return rows.agg(F.count("*").alias("rows")).withColumns(
        {"accepted": F.lit(not refused(d.spec)), "refused": F.lit(refused(one))}
    )
