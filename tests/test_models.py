"""Direction and structure of the learnt models, on a panel with a planted signal."""

from __future__ import annotations

import random

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from panelspark.operators import drop, encode, features as feat, metrics, rankers, reshape, split
from panelspark.operators import recommend as rec
from panelspark.operators.encode import Predictors
from panelspark.plans.drop import run_drop
from panelspark.plans.purchase import run_purchase
from panelspark.plans.sequence import run_sequence
from panelspark.session import materialize
from panelspark.sources import exports
from panelspark.spec import PanelSpec

SPEC = PanelSpec("planted", ("a", "b", "c", "d", "e", "f"), k=2, measured=9, season_length=12)


@pytest.fixture(scope="module")
def panel(spark):
    """Whoever holds a takes up c next, whoever holds b takes up d; items are lost at random."""
    rng = random.Random(11)
    rows = []
    for entity in range(240):
        held = {"a"} if entity % 2 else {"b"}
        for period in range(10):
            mask = sum(1 << SPEC.items.index(x) for x in held)
            rows.append((entity, period, mask, len(held)))
            follows = "c" if "a" in held else "d"
            held = {x for x in held if x in "ab" or rng.random() < 0.6}
            if rng.random() < 0.5:
                held.add(follows)
            if rng.random() < 0.15:
                held.add(rng.choice("ef"))
    return spark.createDataFrame(rows, "entity long, period int, held long, activity long")


@pytest.fixture(scope="module")
def table(panel):
    return materialize(encode.held_flags(feat.build_features(panel, SPEC), SPEC))


@pytest.fixture(scope="module")
def parts(table):
    return split.split_three(table, SPEC.measured)


@pytest.fixture(scope="module")
def inputs():
    return Predictors(extra=encode.held_names_of(SPEC))


def map_of(lists):
    return metrics.map_at_k(rec.with_ap(lists, SPEC)).first().map


@pytest.fixture(scope="module")
def popular_map(parts):
    return map_of(rec.recommend_popular(parts.measured, parts.train, SPEC))


@pytest.mark.parametrize("kind,size", [("forest", dict(trees=20, depth=5)), ("logistic", {}), ("boosted", dict(trees=5, depth=3))])
def test_multiclass_beats_popularity(parts, inputs, popular_map, kind, size):
    fitted = rankers.fit_multiclass(parts.train, inputs, SPEC, kind, **size)
    scored = rankers.score_multiclass(fitted, parts.measured, SPEC)
    assert scored.select(F.size("scores")).distinct().collect()[0][0] == SPEC.n
    assert map_of(rec.with_recommendation(scored, SPEC)) > popular_map


def test_ranker_beats_popularity(parts, popular_map):
    ranker = rankers.fit_ranker(parts.train, SPEC, context=encode.held_names_of(SPEC))
    lists = rec.with_recommendation(rankers.score_ranker(ranker, parts.measured), SPEC)
    assert map_of(lists) > popular_map


def test_pairs_stay_linear_in_the_group(parts):
    pairs = rankers.preference_pairs(parts.train, SPEC, negatives=3)
    per_row = pairs.groupBy("entity", "period").count()
    assert per_row.agg(F.max("count")).first()[0] <= 3
    bad = pairs.filter(
        (F.getbit("add_bits", F.col("better")) != 1)
        | (F.getbit("add_bits", F.col("worse")) == 1) | (F.getbit("prev_bits", F.col("worse")) == 1)
    )
    assert bad.isEmpty()


def test_als_lists_and_unseen_entity(spark, parts):
    model = rankers.fit_als(reshape.interaction_counts(parts.train.filter("entity != 0"), SPEC), rank=4)
    lists = rankers.recommend_als(model, parts.measured, SPEC)
    rows = {r.entity: r for r in lists.collect()}
    assert rows[0].recommended == []
    assert all(not (r.prev_bits >> i & 1) for r in rows.values() for i in r.recommended)
    theirs = model.model.recommendForUserSubset(parts.measured.select("entity"), SPEC.n).collect()
    for r in theirs:  # equal ratings may come in any order there, so ratings are compared
        rating = {x.idx: x.rating for x in r.recommendations}
        best = sorted((v for i, v in rating.items() if not rows[r.entity].prev_bits >> i & 1), reverse=True)
        assert [rating[i] for i in rows[r.entity].recommended] == pytest.approx(best[: SPEC.k], abs=1e-5)
    factors = rankers.user_factors(model, 4)
    assert factors.columns == ["entity", "als_0", "als_1", "als_2", "als_3"] and factors.count() == 239


def test_als_of_any_entity_id(spark, parts):
    base = reshape.interaction_counts(parts.train, SPEC)
    kinds = {
        "small": F.col("entity"), "large": F.col("entity") + (1 << 40), "text": F.format_string("id-%06d", "entity"),
    }
    found = {}
    for name, entity in kinds.items():
        model = rankers.fit_als(base.withColumn("entity", entity), rank=3)
        assert (model.ids is None) == (name == "small")
        assert rankers.user_factors(model, 3).schema["entity"].dataType == base.withColumn("e", entity).schema["e"].dataType
        rows = parts.measured.withColumn("entity", entity)
        lists = rankers.recommend_als(model, rows, SPEC).select("entity", "recommended", "scores").collect()
        found[name] = [(r.recommended, r.scores) for r in sorted(lists, key=lambda r: r.entity)]
    assert found["large"] == found["text"]
    for (a, x), (b, y) in zip(found["small"], found["large"], strict=True):
        assert a == b and x == pytest.approx(y, abs=1e-4)


def test_dense_ids(spark):
    from panelspark.operators.keys import dense_ids

    df = spark.createDataFrame([(i % 700 * 10**12,) for i in range(2000)] + [(None,), (-5,)], "id long").repartition(5)
    rows = dense_ids(df, "id").collect()
    assert [r.number for r in sorted(rows, key=lambda r: r.id)] == list(range(701))
    assert dense_ids(df.limit(0), "id").collect() == []


def test_hybrid_takes_missing_vectors(parts, inputs):
    model = rankers.fit_als(reshape.interaction_counts(parts.train.filter("entity % 5 != 0"), SPEC), rank=2)
    joined = [df.join(rankers.user_factors(model, 2), "entity", "left") for df in (parts.train, parts.measured)]
    more = inputs.plus(numeric=rankers.factor_names(2))
    fitted = rankers.fit_multiclass(joined[0], more, SPEC, "forest", trees=5, depth=4)
    assert rankers.score_multiclass(fitted, joined[1], SPEC).count() == parts.measured.count()


def test_sequence_plan_scores_the_whole_base(table, parts, popular_map):
    portfolio = run_sequence(table, SPEC, length=4, iterations=30)
    assert portfolio.count() == parts.measured.count()
    joined = parts.measured.join(portfolio.select("entity", "recommended", "scores", "prob_buy"), "entity")
    assert map_of(joined) > popular_map
    sums = [sum(r.scores) for r in portfolio.collect()]
    assert all(s == pytest.approx(1.0) for s in sums)


def test_calibration_is_monotone_and_bounded(spark):
    rng = random.Random(2)
    rows = [(p, int(rng.random() < p * p)) for p in (rng.random() for _ in range(800))]
    df = spark.createDataFrame(rows, "p_raw double, label int")
    out = drop.calibrate(df.filter("p_raw < 2"), df).orderBy("p_raw").collect()
    values = [r.p for r in out]
    assert values == sorted(values) and 0 <= values[0] and values[-1] <= 1
    scores = metrics.brier(spark.createDataFrame(out), "p_raw", "p").first()
    assert scores.brier_p < scores.brier_p_raw


def brute_isotonic(points):
    """Largest over starts of the least over ends of the mean rate."""
    out = []
    for x in range(len(points)):
        out.append(max(
            min(sum(p for _, _, p in points[a : b + 1]) / sum(n for _, n, _ in points[a : b + 1]) for b in range(x, len(points)))
            for a in range(x + 1)
        ))
    return out


@pytest.mark.parametrize("seed,ranges,fan", [(1, 64, 8), (2, 5, 2), (3, 1, 8)])
def test_isotonic_against_the_min_max_formula(spark, monkeypatch, seed, ranges, fan):
    from panelspark.operators import calibration as cal

    monkeypatch.setattr(cal, "RANGES", ranges)
    monkeypatch.setattr(cal, "FAN", fan)
    rng = random.Random(seed)
    points = sorted({rng.randrange(0, cal.SCORE_GRID + 1) for _ in range(60)})
    rows = [(g, n := rng.randrange(1, 9), min(n, int(n * g / cal.SCORE_GRID + 2 * rng.random()))) for g in points]
    df = spark.createDataFrame(rows, "point long, n long, pos long").repartition(4)
    found = {r.point: r.p for r in cal.calibration_map(cal.isotonic_blocks(df)).collect()}
    assert len(found) == cal.SCORE_GRID + 1
    want = brute_isotonic(rows)
    assert [found[g] for g in points] == want
    assert found[0] == want[0] and found[cal.SCORE_GRID] == want[-1]
    i = next(i for i in range(len(want) - 1) if want[i] < want[i + 1] and points[i + 1] - points[i] > 1)
    middle = (points[i] + points[i + 1]) // 2
    assert want[i] < found[middle] < want[i + 1]


def test_calibration_without_rows_or_scores(spark):
    df = spark.createDataFrame([(0.2, 1), (None, 0)], "p_raw double, label int")
    assert sorted(str(r.p) for r in drop.calibrate(df, df).collect()) == ["1.0", "None"]
    assert {r.p for r in drop.calibrate(df.limit(0), df).collect()} == {None}


def test_drop_plan(table):
    plan = run_drop(table, SPEC, trees=5)
    assert plan.scores.columns == ["entity", "item", "prob_drop", "prob_drop_raw"]
    assert plan.ranking.first().lift > 1.0
    assert plan.sweep.filter("best").count() == 1


def test_purchase_plan(panel):
    plan = run_purchase(panel, SPEC)
    assert plan.weights.count() == 66
    assert 0 < plan.map_at_k.first().map <= 1
    assert plan.capture.count() == 6
    assert sum(r.clients for r in plan.quadrants.collect()) == plan.portfolio.count()


def test_leakage_control_finds_the_answer(table, panel, inputs):
    rows = {r["item"]: r for r in drop.leakage_control(table, panel, SPEC, inputs, SPEC.measured, trees=5).collect()}
    assert rows["c"].auc_leaked > 0.99 and rows["c"].verdict == "clean"
    assert rows["d"].auc_leaked > rows["d"].auc_clean and rows["d"].positives > 0
    # nobody ever takes up a or b: one class, so there is nothing to judge
    assert all(rows[i].verdict is None and rows[i].auc_clean is None for i in "ab" if i in rows)


@pytest.mark.parametrize(
    "clean,leaked,verdict", [(0.94, 1.0, "clean"), (0.5, 0.95, "clean"), (0.5, 0.75, "attention"), (0.5, 0.55, "review"), (1.0, 1.0, "clean")]
)
def test_leakage_verdict(spark, clean, leaked, verdict):
    aucs = spark.createDataFrame([(clean, leaked)], "auc_clean double, auc_leaked double")
    assert drop.leakage_verdict(aucs).first().verdict == verdict


@pytest.fixture(scope="module")
def incomes(spark):
    rng = random.Random(4)
    rows = []
    for i in range(600):
        group, age = rng.choice("xyz"), float(rng.randrange(20, 80))
        income = None if (group == "x" and rng.random() < 0.8) else {"x": 10, "y": 20, "z": 30}[group] * 100 + age
        rows.append((i, 0, group, age, None if i % 97 == 0 else float(i % 7), income))
    return spark.createDataFrame(rows, "entity long, period int, grp string, age double, noise double, income double")


STUDY = Predictors(numeric=("age", "noise"), categorical=("grp",))


def test_missingness_study(incomes):
    summary, importance = drop.missingness_model(incomes, "income", STUDY, trees=5)
    assert summary.first().verdict == "not at random"
    weights = {r.source: r.importance for r in importance.collect()}
    assert set(weights) == {"grp_onehot", "age", "noise"}
    assert sum(weights.values()) == pytest.approx(1.0) and max(weights, key=weights.get) == "grp_onehot"


def test_imputation_study(incomes):
    rows = {r.estimate: r for r in drop.compare_imputation(incomes, "income", STUDY, trees=5).collect()}
    assert rows["model"].mae < rows["median"].mae
    assert rows["model"].rows == rows["median"].rows and rows["model"].skipped > 0


def test_skip_and_keep_assembly(incomes):
    prepared = encode.ready(incomes, STUDY)
    kept = Pipeline(stages=encode.preprocess_stages(STUDY)).fit(prepared).transform(prepared)
    assert kept.count() == 600
    assert kept.select(F.exists(vector_to_array("features"), lambda v: F.isnan(v)).alias("bad")).filter("bad").isEmpty()
    skipped = Pipeline(stages=encode.preprocess_stages(STUDY, "skip", True, False)).fit(prepared).transform(prepared)
    assert skipped.count() == incomes.filter("noise is not null").count()


def test_unseen_category_gets_its_own_index(spark, incomes):
    fitted = encode.index_categories(["grp"]).fit(incomes)
    unseen = spark.createDataFrame([("new",), ("x",)], "grp string")
    indexed = {r.grp: r.grp_index for r in fitted.transform(unseen).collect()}
    assert indexed["new"] == 3.0 and indexed["x"] < 3.0


def test_drift_curve_and_summary(spark, table, inputs):
    long = reshape.explode_held(table, SPEC, ("entity", "period", *inputs.numeric, *inputs.extra))
    more = inputs.plus(numeric=("tenure",), categorical=("item",))
    curve = drop.drift_curve(long, more, split.first_periods(long), window=3, horizon=2, trees=2, depth=3)
    assert [r.periods_ahead for r in curve.orderBy("period").collect()] == [1, 2]
    planted = spark.createDataFrame(
        [(5, 1, 0.80, 0.801, 0.001), (6, 2, 0.78, 0.80, 0.02)],
        "period int, periods_ahead int, auc_frozen double, auc_refit double, cost double",
    )
    summary = drop.drift_summary(planted).first()
    assert summary.refit_after == 2 and summary.auc_loss == pytest.approx(0.02)


def test_model_round_trip(parts, inputs, tmp_path):
    fitted = rankers.fit_multiclass(parts.train, inputs, SPEC, "forest", trees=3, depth=3)
    path = str(tmp_path / "model")
    exports.save_model(fitted.model, path)
    again = rankers.Multiclass(exports.load_model(path), fitted.predictors, fitted.kind)
    before, after = [
        sorted(map(str, rankers.score_multiclass(m, parts.measured, SPEC).select("entity", "scores").collect()))
        for m in (fitted, again)
    ]
    assert before == after


@pytest.mark.parametrize("suffix", ["", "_b"])
def test_learnt_keys_use_the_sizes_of_their_operators(spark, monkeypatch, suffix):
    from unittest.mock import MagicMock

    from panelspark import registry
    from panelspark.operators.trajectory import LENGTH
    from panelspark.registry import models

    keys = registry.queries()
    names = ("model_table", "materialize", "parts", "als_of", "list_report", "clean", "split", "rankers", "drop")
    fake = {n: MagicMock() for n in names}
    for name, mock in fake.items():
        monkeypatch.setattr(models, name, mock)
    monkeypatch.setattr(models, "drop_table", lambda d: (None, None))
    folder = "/root/testdata/sf0.001"
    for key in ("p8_boosted_model", "p9_hybrid_model", "p15_sequence_model", "b3_leakage_control_model", "b7_drift_curve_model"):
        keys[key + suffix](spark, folder)
    assert "b2_calibrated_drop_model" + suffix in keys
    for call in fake["rankers"].fit_multiclass.call_args_list:
        assert call.args[3] == "boosted" and not call.kwargs
    assert fake["rankers"].fit_multiclass.call_count == 2
    assert fake["rankers"].sequence_inputs.call_args.args[2] == fake["rankers"].fit_sequence.call_args.args[2] == LENGTH
    assert not {"trees", "depth", "horizon"} & set(fake["drop"].drift_curve.call_args.kwargs)
