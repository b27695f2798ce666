from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from panelspark.functions import ap_at_k, ap_at_k_bits, best_open, full_order, top_k
from panelspark.operators import fusion, metrics, split
from panelspark.operators import features as feat
from panelspark.operators import recommend as rec

CASES = [  # list, taken up, depth, and the value worked out
    (["pen", "ink", "cap"], ["ink", "cap"], 7, (1 / 2 + 2 / 3) / 2),  # hits at 2 and 3
    (["pen", "ink", "cap", "nib"], ["nib", "pen"], 3, (1 / 1) / 2),  # the second hit lies below the cut
    (["pen", "ink"], ["cap", "nib", "box"], 7, 0.0),  # nothing found
    (["box", "pen", "ink", "cap", "nib"], list(reversed(["box", "pen", "ink", "cap", "nib"])), 5, 1.0),  # all, in any order
    (["pen", "ink", "cap"], ["cap", "cap", "cap"], 3, 1 / 3),  # a repeated item counts once
    (["pen"], [], 4, 0.0),
    ([], ["pen"], 4, 0.0),
    (["pen", "ink"], ["pen", "ink", *(f"other{i}" for i in range(9))], 4, 2 / 4),  # at most the depth can be found
]


@pytest.mark.parametrize("predicted,actual,depth,expected", CASES)
def test_ap_by_hand(spark, predicted, actual, depth, expected):
    df = spark.createDataFrame([(predicted, actual)], "p array<string>, a array<string>")
    assert df.select(ap_at_k(F.col("p"), F.col("a"), depth)).first()[0] == pytest.approx(expected)


def test_ap_on_bits_and_missing_list(spark):
    df = spark.createDataFrame([([0, 3, 1], 0b11), (None, 0b1)], "p array<int>, bits long")
    values = [r[0] for r in df.select(ap_at_k_bits(F.col("p"), F.col("bits"), 7)).collect()]
    assert values == [pytest.approx(5 / 6), 0.0]


def test_order_ties_and_mask(spark):
    df = spark.createDataFrame([([0.2, 0.5, 0.5, 0.1], 0b0010)], "s array<double>, held long")
    row = df.select(
        full_order(F.col("s")).alias("all"), top_k(F.col("s"), F.col("held"), 2).alias("top"),
        best_open(F.col("s"), F.col("held")).alias("best"), best_open(F.col("s"), F.lit(0b1111)).alias("none"),
    ).first()
    assert (row.all, row.top, row.best, row.none) == ([1, 2, 0, 3], [2, 0], 0.5, None)


def test_popularity_lists_and_map(make_panel, small):
    states = {(e, p): "" for e in range(4) for p in range(6)}
    states.update({(0, 2): "b", (0, 3): "b", (1, 3): "b", (2, 3): "c", (3, 5): "c", (0, 4): "b", (0, 5): "bc"})
    rows = feat.build_features(make_panel(states), small)
    train, measured = split.split_two(rows, small.measured)
    assert [r.item for r in rec.popularity(train, small).orderBy("rank").collect()] == ["b", "c", "a", "d"]
    lists = rec.recommend_popular(measured, train, small)
    by_entity = {r.entity: r.recommended for r in lists.collect()}
    assert by_entity == {0: [2, 0], 1: [1, 2], 2: [1, 2], 3: [1, 2]}
    score = metrics.map_at_k(rec.with_ap(lists, small)).first()
    assert (score.clients, score.map) == (2, 0.75)
    assert metrics.map_full_base(rec.with_ap(lists, small), lists).first().map_full_base == 0.375


def test_masked_renormalise(spark):
    df = spark.createDataFrame([([0.2, 0.3, 0.5], 0b100), ([0.0, 0.0, 1.0], 0b100)], "scores array<double>, prev_bits long")
    first, second = [r.scores for r in rec.masked_renormalise(df).collect()]
    assert first == [pytest.approx(0.4), pytest.approx(0.6), 0.0]
    assert second == [0.0, 0.0, 0.0]


def test_reciprocal_ranks_start_at_one_sixtieth(spark):
    df = spark.createDataFrame([([0.1, 0.9, 0.5],)], "s array<double>")
    assert df.select(fusion.reciprocal_ranks(F.col("s"))).first()[0] == [1 / 62, 1 / 60, 1 / 61]


def test_simplex_grid():
    assert len(fusion.simplex_grid(3)) == 66
    assert all(sum(w) == 10 for w in fusion.simplex_grid(4))


def test_weight_search_finds_the_useful_model(spark, small):
    rows = spark.createDataFrame(
        [(1, 4, 0, 0b1, [1.0, 0.0, 0.0, 0.0], [0.0, 0.0, 0.0, 1.0]), (2, 4, 0, 0b1, [1.0, 0.0, 0.0, 0.0], [0.0, 0.0, 0.0, 1.0])],
        "entity long, period int, prev_bits long, add_bits long, scores_x array<double>, scores_y array<double>",
    )
    chosen = fusion.search_weights(fusion.with_rank_arrays(rows, ("x", "y")), ("x", "y"), small)
    best = chosen.filter("place = 1").first()
    assert best.map == 1.0
    assert chosen.filter("w_x = 0").first().map == 0.5


AP = [  # entity, period, model, segment, ap
    (1, 4, "m", "s", 900000), (1, 4, "n", "s", 100000), (2, 4, "m", "r", 100000), (2, 4, "n", "r", 300000),
    (1, 5, "m", "s", 200000), (1, 5, "n", "s", 700000), (2, 5, "m", "r", 0), (2, 5, "n", "r", 400000),
    (3, 5, "m", "new", 500000), (3, 5, "n", "new", 0),
]


def test_routing_applies_the_rule_of_the_period_before(spark):
    ap = spark.createDataFrame(AP, "entity long, period int, model string, segment string, ap_micro long")
    routed = {r.segment: (r.chosen, r.map) for r in fusion.route(ap, 5).collect()}
    # s keeps m although n wins at t; the unseen segment takes the best model of t-1
    assert routed == {"s": ("m", 0.2), "r": ("n", 0.4), "new": ("m", 0.5)}
    stability = fusion.rule_stability(ap, 5).first()
    assert (stability.segments, stability.changed) == (3, 2)
    gain = fusion.routing_gain(ap, 5).first()
    assert gain.map_routed == pytest.approx(1.1 / 3) and gain.best_model == "n"


def test_selection_and_noise(spark):
    rows = [("x", 4, 500000), ("x", 5, 100000), ("y", 4, 400000), ("y", 5, 900000)]
    ap = spark.createDataFrame(rows, "candidate string, period int, ap_micro long")
    picked = split.select_on_holdout(ap, 5).first()
    assert (picked.candidate, picked.map_decision, picked.map_measured, picked.candidates) == ("x", 0.5, 0.1, 2)
    reruns = spark.createDataFrame([(1, 400000), (2, 600000)], "seed int, ap_micro long")
    noise = split.noise_report(reruns, gain=0.05).first()
    assert noise.mean_map == pytest.approx(0.5) and noise.std_map == pytest.approx(0.1)
    assert not noise.gain_above_noise


def test_coverage_gap_warns(spark):
    ids = lambda *v: spark.createDataFrame([(x,) for x in v], "entity long")
    row = rec.coverage_gap(ids(1, 1, 2), ids(1, 2, 3, 4), ids(1, 2)).first()
    assert (row.train_pct, row.serve_pct, row.gap, row.warn) == (100.0, 50.0, 50.0, True)


def test_old_holdings_count_as_covered(make_panel, small):
    """Everyone who ever held something in train has a signal, however long ago."""
    from panelspark.operators import reshape

    states = {(e, p): "" for e in range(3) for p in range(6)}
    states.update({(0, 0): "a", (1, 1): "b", (1, 2): "b", (2, 5): "c"})  # 2 takes up its first item in period 5
    parts = split.split_three(feat.build_features(make_panel(states), small), small.measured)
    known = reshape.interaction_counts(parts.train, small, "held")
    row = rec.coverage_gap(parts.train.filter("n_adds > 0"), parts.measured, known).first()
    assert (row.train_ids, row.train_covered, row.serve_ids, row.serve_covered) == (1, 1, 3, 2)
