from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from panelspark.operators import business, metrics


def brute_auc(rows):
    wins = total = 0.0
    for s, y in rows:
        for r, z in rows:
            if y == 1 and z == 0:
                total += 1
                wins += 1.0 if s > r else 0.5 if s == r else 0.0
    return wins / total


def brute_ap(rows):
    positives = sum(y for _, y in rows)
    area = 0.0
    for level in {s for s, _ in rows}:
        called = [y for s, y in rows if s >= level]
        area += sum(y for s, y in rows if s == level) / positives * sum(called) / len(called)
    return area


def scored(spark, rows):
    return spark.createDataFrame(rows, "p double, label int")


@pytest.mark.parametrize("ranges", [1, 7])
def test_areas_of_every_key_against_brute_force(spark, ranges):
    rng = random.Random(8)
    rows = [(k, round(rng.random() ** (k + 1), 4), int(rng.random() < 0.3)) for k in range(12) for _ in range(3 if k == 5 else 80)]
    rows += [(20, 0.5, 1), (20, 0.7, 1), (21, None, 0)]
    df = spark.createDataFrame(rows, "k int, p double, label int")
    counted = metrics.cumulative_by(df, ("k",), "p", "label", ranges)
    aucs = {r.k: r.auc for r in metrics.roc_auc(counted, ("k",)).collect()}
    areas = {r.k: r.pr_auc for r in metrics.pr_auc(counted, ("k",)).collect()}
    assert set(aucs) == {*range(12), 20} and aucs[20] is None
    for k in range(12):
        mine = [(p, y) for key, p, y in rows if key == k]
        if {y for _, y in mine} == {0, 1}:
            assert aucs[k] == pytest.approx(brute_auc(mine), abs=1e-12)
            assert areas[k] == pytest.approx(brute_ap(mine), abs=1e-4)


def test_keyed_areas_have_no_window_over_a_key_alone(spark):
    df = spark.createDataFrame([(1, 0.5, 1)], "k int, p double, label int")
    plan = metrics.auc_by(df, ("k",), "p", "label")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "windowspecdefinition" in line]
    assert windows and all("range#" in line.split("windowspecdefinition")[1] for line in windows)


@pytest.mark.parametrize("digits", [1, 2, 6])
@pytest.mark.parametrize("ranges", [1, 5, 64])
def test_areas_against_brute_force(spark, digits, ranges):
    rng = random.Random(digits)
    rows = [(round(rng.random() ** 3, digits), int(rng.random() < 0.3)) for _ in range(300)]
    curve = metrics.cumulative_histogram(scored(spark, rows), "p", "label", ranges)
    assert metrics.roc_auc(curve).first().auc == pytest.approx(brute_auc(rows), abs=1e-12)
    assert metrics.pr_auc(curve).first().pr_auc == pytest.approx(brute_ap(rows), abs=1e-5)


def test_one_score_holding_a_third_of_the_rows(spark):
    rng = random.Random(5)
    rows = [(0.0, int(rng.random() < 0.1)) for _ in range(200)]
    rows += [(round(rng.random(), 4), int(rng.random() < 0.4)) for _ in range(400)]
    curve = metrics.cumulative_histogram(scored(spark, rows), "p", "label")
    assert metrics.roc_auc(curve).first().auc == pytest.approx(brute_auc(rows), abs=1e-12)
    assert sum(r.n for r in curve.collect()) == 600


def test_auc_without_positives_is_null(spark):
    curve = metrics.cumulative_histogram(scored(spark, [(0.1, 0), (0.2, 0)]), "p", "label")
    assert metrics.roc_auc(curve).first().auc is None


def test_exact_cuts_are_discrete_percentiles(spark):
    rng = random.Random(1)
    values = [rng.randrange(50) for _ in range(97)]
    df = spark.createDataFrame([(float(v), 0) for v in values], "p double, label int")
    row = metrics.exact_cuts(metrics.cumulative_histogram(df, "p", "label"), [500, 800, 990]).first()
    ordered = sorted(values)
    for q in (500, 800, 990):
        place = next(i for i in range(97) if (i + 1) * 1000 >= 97 * q)
        assert row[f"cut_{q}"].score == ordered[place]
        assert row[f"cut_{q}"].rows_from == sum(v >= ordered[place] for v in values)


def test_reliability_closes_the_last_bin(spark):
    bins = {r.bin: (r.rows, r.observed) for r in metrics.reliability(scored(spark, [(1.0, 1), (0.95, 0), (0.0, 0)]), "p").collect()}
    assert bins == {9: (2, 0.5), 0: (1, 0.0)}


def test_brier_by_hand(spark):
    row = metrics.brier(scored(spark, [(0.5, 1), (0.0, 0)]).withColumn("q", F.lit(1.0)), "p", "q").first()
    assert (row.brier_p, row.brier_q) == (0.125, 0.5)
    assert row.improvement_pct_q == -300.0


def test_sweep_by_hand(spark):
    rows = [(0.155, 1), (0.9, 1), (0.9, 0), (0.02, 0)]
    curve = {r.threshold_pct: r for r in metrics.threshold_sweep(scored(spark, rows), "p").collect()}
    assert len(curve) == 99
    assert (curve[16].contacts, curve[16].hits, curve[16].value) == (3, 2, 57.0)  # 0.155 counts as 0.16
    assert (curve[17].contacts, curve[1].contacts, curve[91].contacts) == (2, 4, 0)
    assert [r.threshold_pct for r in curve.values() if r.best] == [3]


def test_sweep_when_every_call_loses(spark):
    curve = metrics.threshold_sweep(scored(spark, [(0.9, 0), (0.4, 0)]), "p").collect()
    best = next(r for r in curve if r.best)
    assert (best.contacts, best.value, best.threshold_pct) == (0, 0.0, 91)


def test_capture_keeps_ties(spark):
    rows = [(1.0, 1)] * 3 + [(0.5, 0)] * 7
    curve = {r.pct_base: r for r in business.capture_curve(scored(spark, rows), "p", "label").collect()}
    assert (curve[1.0].contacted, curve[1.0].hits, curve[1.0].pct_captured) == (3, 3, 100.0)
    assert curve[50.0].contacted == 10


def test_quadrants_and_missing_risk(spark):
    buy = spark.createDataFrame([(1, 0.9), (2, 0.9), (3, 0.1), (4, 0.1)], "entity long, prob_buy double")
    risk = spark.createDataFrame([(2, 0.8), (3, 0.8)], "entity long, prob_drop double")
    rows = business.with_risk(buy, risk)
    assert {r.entity: r.prob_drop for r in rows.collect()} == {1: 0.0, 2: 0.8, 3: 0.8, 4: 0.0}
    cuts = spark.createDataFrame([(0.5, 0.5)], "cut_prob_buy double, cut_prob_drop double")
    named = business.with_action(business.with_quadrant(rows, cuts))
    assert {r.entity: r.quadrant for r in named.collect()} == {
        1: business.SELL, 2: business.RETAIN_FIRST, 3: business.RETAIN, 4: business.LEAVE,
    }
    assert sum(r.pct for r in business.quadrants(named).collect()) == pytest.approx(100)


def test_call_list_skips_entities_with_nothing_to_offer(spark):
    rows = spark.createDataFrame(
        [(1, 0.9, []), (2, 0.5, [1]), (3, 0.5, [2]), (4, 0.1, [1])], "entity long, prob_buy double, recommended array<int>"
    )
    assert [r.entity for r in business.call_list(rows, 2).collect()] == [2, 3]


def test_regression_error(spark):
    df = spark.createDataFrame([(1.0, 2.0), (5.0, 2.0)], "y double, m double")
    row = metrics.regression_error(df, "y", "m").first()
    assert row.rmse == pytest.approx(5 ** 0.5) and row.mae == 2.0
