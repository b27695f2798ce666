from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from panelspark.functions import held_names, tenure_of
from panelspark.operators import features as feat
from panelspark.operators import reshape, split, trajectory
from panelspark.spec import PanelSpec


def names(df, bits, spec):
    return {
        (r.entity, r.period): "".join(r.x)
        for r in df.select("entity", "period", held_names(F.col(bits), spec.items).alias("x")).collect()
    }


def test_gap_first_row_and_late_joiner(make_panel, small):
    panel = make_panel({(1, 0): "a", (1, 1): "ab", (1, 3): "b", (1, 4): "", (2, 4): "c", (2, 5): "cd"})
    rows = feat.build_features(panel, small)
    assert set(names(rows, "prev_bits", small)) == {(1, 1), (1, 4), (2, 5)}
    audit = feat.discard_audit(panel).first()
    assert (audit.rows_in, audit.rows_out, audit.first_rows, audit.gap_rows) == (6, 3, 2, 1)


def test_unknown_state_means_not_held(make_panel, small):
    rows = feat.build_features(make_panel({(1, 0): "a", (1, 1): None, (1, 2): "a"}), small)
    assert names(rows, "drop_bits", small)[(1, 1)] == "a"
    assert names(rows, "add_bits", small)[(1, 2)] == "a"


def test_entity_holding_nothing(make_panel, small):
    rows = feat.build_features(make_panel({(1, 0): "", (1, 1): "", (1, 2): "d"}), small)
    assert names(rows, "add_bits", small) == {(1, 1): "", (1, 2): "d"}
    assert [r.n_prev for r in rows.collect()] == [0, 0]


def test_catalogue_guard():
    with pytest.raises(ValueError):
        PanelSpec("wide", tuple(str(i) for i in range(63)), 3, 5, 12)
    with pytest.raises(ValueError):
        PanelSpec("twice", ("a", "a"), 3, 5, 12)


def brute_force(states, spec):
    """The feature definitions, straight from one entity's rows at a time."""
    out = {}
    for entity in {e for e, _ in states}:
        usable = {}
        seen = sorted(p for e, p in states if e == entity)
        for before, now in zip(seen, seen[1:]):
            if now - before == 1:
                prev, cur = set(states[entity, before]), set(states[entity, now])
                usable[now] = (prev, cur - prev, prev - cur)
        for p, (prev, adds, drops) in usable.items():
            recent = [usable[q] for q in usable if p - 3 <= q <= p - 1]
            out[entity, p] = (
                "".join(x for x in spec.items if x in prev),
                "".join(x for x in spec.items if x in adds),
                "".join(x for x in spec.items if x in drops),
                tuple(sum(x in usable[q][0] for q in usable if p - 5 <= q <= p) for x in spec.items),
                sum(len(r[1]) for r in recent),
                sum(len(r[2]) for r in recent),
                sum(q < p for q in usable),
            )
    return out


def spark_features(panel, spec):
    rows = feat.build_features(panel, spec)
    tenures = F.array(*[tenure_of(F.col("recent_states"), i) for i in range(spec.n)])
    return {
        (r.entity, r.period): (
            "".join(r.prev), "".join(r.adds), "".join(r.drops), tuple(r.tenures),
            r.adds_recent, r.drops_recent, r.history,
        )
        for r in rows.select(
            "*", tenures.alias("tenures"),
            *[held_names(F.col(f"{x}_bits"), spec.items).alias(y) for x, y in (("prev", "prev"), ("add", "adds"), ("drop", "drops"))],
        ).collect()
    }


@pytest.mark.parametrize("seed", [1, 2])
def test_features_against_brute_force(make_panel, small, seed):
    rng = random.Random(seed)
    states = {
        (e, p): "".join(x for x in small.items if rng.random() < 0.5)
        for e in range(12) for p in range(14) if rng.random() < 0.85
    }
    assert spark_features(make_panel(states), small) == brute_force(states, small)


def test_no_feature_of_t_reads_t(make_panel, small):
    rng = random.Random(7)
    states = {(e, p): "".join(x for x in small.items if rng.random() < 0.5) for e in range(8) for p in range(8)}
    changed = {k: ("abcd" if k[1] == 7 else v) for k, v in states.items()}
    inputs = ["entity", "period", "prev_bits", "n_prev", "recent_states", "adds_recent", "drops_recent", "history"]

    def at_seven(source):
        rows = trajectory.trajectories(feat.build_features(make_panel(source), small), 4)
        return sorted(map(str, rows.filter("period = 7").select(*inputs, "steps").collect()))

    assert at_seven(states) == at_seven(changed)


def test_transition_guard(make_panel, small):
    rows = feat.build_features(make_panel({(1, 0): "ab", (1, 1): "bc"}), small)
    feat.check_panel(rows, small)
    with pytest.raises(ValueError):
        feat.check_panel(rows.withColumn("add_bits", F.col("drop_bits")), small)


def test_one_exchange_serves_all_windows(make_panel, small):
    plan = feat.build_features(make_panel({(1, 0): "a", (1, 1): "b"}), small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(entity") == 1
    assert plan.count("Sort [entity") == 1


def test_widen_matches_bits(make_panel, small):
    wide = feat.widen(feat.build_features(make_panel({(1, 0): "ad", (1, 1): "ab"}), small), small).first()
    assert [wide[f"prev_{i}"] for i in range(4)] == [1, 0, 0, 1]
    assert [wide[f"add_{i}"] for i in range(4)] == [0, 1, 0, 0]
    assert [wide[f"drop_{i}"] for i in range(4)] == [0, 0, 0, 1]
    assert [wide[f"tenure_{i}"] for i in range(4)] == [1, 0, 0, 1]


def test_ranking_groups_equal_the_long_draw(make_panel, small):
    rng = random.Random(3)
    states = {(e, p): "".join(x for x in small.items if rng.random() < 0.4) for e in range(20) for p in range(6)}
    rows = feat.build_features(make_panel(states), small)
    inside = reshape.ranking_groups(rows, small, negatives=1)
    long = reshape.explode_open(rows.filter(F.col("add_bits") != 0), small)
    windowed = reshape.sampled_negatives_window(long, negatives=1)
    columns = ["entity", "period", "idx", "label"]
    assert sorted(inside.select(columns).collect()) == sorted(windowed.select(columns).collect())


def test_rolling_windows_never_hold_the_evaluated_period(make_panel, small):
    rows = feat.build_features(make_panel({(1, p): "a" for p in range(8)}), small)
    windows = split.rolling_windows(rows, [5, 6], 3).collect()
    assert {(r.evaluated, r.period) for r in windows} == {(5, 2), (5, 3), (5, 4), (6, 3), (6, 4), (6, 5)}


def test_three_way_split(make_panel, small):
    rows = feat.build_features(make_panel({(1, p): "a" for p in range(7)}), small)
    parts = split.split_three(rows, 5, lookback=2)
    periods = [sorted(r.period for r in df.collect()) for df in (parts.train, parts.decision, parts.measured)]
    assert periods == [[2, 3], [4], [5]]


def test_position_examples(make_panel, small):
    rows = feat.build_features(make_panel({(1, 0): "a", (1, 1): "ab", (1, 2): "abc", (1, 3): "abc"}), small)
    examples = trajectory.position_examples(trajectory.trajectories(rows), small).filter("period = 3").collect()
    # step 0 is period 1 (held a); c is added at the next step
    assert sorted((r.step, r.idx, r.label) for r in examples) == [(0, 1, 0), (0, 2, 1), (0, 3, 0)]


def test_sampling_keys_mix_items_and_seeds(spark):
    from panelspark.functions import pseudo_random

    rows = spark.range(4000).select(F.col("id").alias("entity"), (F.col("id") % 7).alias("period"))
    item = F.explode(F.sequence(F.lit(0), F.lit(24))).alias("item")
    keyed = rows.select("*", item).select("*", pseudo_random(F.col("entity"), F.col("period"), F.col("item")).alias("r"))
    drawn = keyed.groupBy("entity").agg(F.slice(F.array_sort(F.collect_list(F.struct("r", "item"))), 1, 6).alias("six"))
    counts = [r["count"] for r in drawn.select(F.explode("six").alias("x")).groupBy("x.item").count().collect()]
    assert len(counts) == 25 and max(abs(c - 960) for c in counts) < 96 * 1.5
    keep = [F.pmod(pseudo_random(F.col("entity"), F.col("period"), seed=s), F.lit(1000)) < 400 for s in (1, 2)]
    both = rows.agg(F.sum((keep[0] & keep[1]).cast("int")), F.sum(keep[0].cast("int"))).first()
    assert abs(both[0] / both[1] - 0.4) < 0.03


def test_open_top_band_and_unknown_items(spark):
    from pyspark.errors import PySparkException

    from panelspark.functions.bits import known_mask
    from panelspark.operators.fusion import HOLDING_BANDS, with_segment

    long = spark.createDataFrame([(1200,), (0,)], "history int")
    assert {r.history: r.segment for r in with_segment(long, "history").collect()} == {1200: "12+", 0: "1"}
    assert with_segment(long, "history", HOLDING_BANDS).count() == 2
    items = spark.createDataFrame([("a",), (None,)], "item string")
    assert [r[0] for r in items.select(known_mask(F.col("item"), ("a", "b"))).collect()] == [1, None]
    with pytest.raises(PySparkException, match="outside the catalogue"):
        items.select(known_mask(F.col("item"), ("b",))).collect()
