"""Boosted trees: gradients against plain loops, trees against exhaustive splits, planted interactions."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import boosting, encode, features as feat, metrics, rankers, split
from panelspark.operators import recommend as rec
from panelspark.operators.boosting import Binning, Growth
from panelspark.operators.encode import Predictors
from panelspark.session import materialize
from panelspark.spec import PanelSpec

SPEC = PanelSpec("crossed", ("a", "b", "c", "d", "e", "f"), k=2, measured=9, season_length=12, negatives=3)


@pytest.fixture(scope="module")
def parts(spark):
    """c follows if exactly one of a and b is held, d if both or none: no single item tells."""
    rng = random.Random(5)
    rows = []
    for entity in range(300):
        fixed = {x for x in "ab" if rng.random() < 0.5}
        held = set(fixed)
        for period in range(10):
            rows.append((entity, period, sum(1 << SPEC.items.index(x) for x in held), len(held)))
            follows = "c" if len(fixed) == 1 else "d"
            held = fixed | {x for x in sorted(held - fixed) if rng.random() < 0.3}
            if rng.random() < 0.5:
                held.add(follows)
            if rng.random() < 0.15:
                held.add("e" if entity % 3 else "f")
    panel = spark.createDataFrame(rows, "entity long, period int, held long, activity long")
    return split.split_three(materialize(encode.held_flags(feat.build_features(panel, SPEC), SPEC)), SPEC.measured)


INPUTS = Predictors(numeric=("n_prev",), extra=encode.held_names_of(SPEC))


def map_of(scored):
    return metrics.map_at_k(rec.with_ap(rec.with_recommendation(scored, SPEC), SPEC)).first().map


def test_softmax_trees_are_not_below_one_vs_rest(parts):
    told = parts.measured.filter(F.col("add_bits").isin(0b100, 0b1000))  # e and f follow nothing
    found = {}
    for kind in ("boosted", "one_vs_rest"):
        fitted = rankers.fit_multiclass(parts.train, INPUTS, SPEC, kind, trees=20, depth=4)
        found[kind] = map_of(rankers.score_multiclass(fitted, told, SPEC))
    assert found["boosted"] >= found["one_vs_rest"] and found["boosted"] > 0.95


def test_listwise_beats_the_linear_ranker(parts):
    linear = rankers.fit_ranker(parts.train, SPEC, context=encode.held_names_of(SPEC))
    listwise = rankers.fit_listwise(parts.train, INPUTS, SPEC, trees=15, depth=4, least=0.1)
    scores = rankers.score_listwise(listwise, parts.measured, SPEC)
    assert scores.columns[:-1] == parts.measured.columns
    assert map_of(scores) > map_of(rankers.score_ranker(linear, parts.measured)) + 0.03


def plain_lambdas(scores, labels):
    rank = {i: r + 1 for r, i in enumerate(sorted(range(len(scores)), key=lambda i: (-scores[i], i)))}
    ideal = sum(1 / np.log2(1 + r) for r in range(1, sum(labels) + 1))
    first, second = [0] * len(scores), [0] * len(scores)
    for i in range(len(scores)):
        for j in range(len(scores)):
            if labels[i] > labels[j]:
                swap = abs(1 / np.log2(1 + rank[i]) - 1 / np.log2(1 + rank[j])) / ideal
                wrong = 1 / (1 + np.exp(scores[i] - scores[j]))
                pull, bend = int(np.floor(wrong * swap * 1e6 + 0.5)), int(np.floor(wrong * (1 - wrong) * swap * 1e6 + 0.5))
                first[i] -= pull
                first[j] += pull
                second[i] += bend
                second[j] += bend
    return first, second


def test_lambdas_equal_a_plain_loop():
    draw = np.random.default_rng(3)
    sizes = np.array([1, 5, 2, 9, 3, 4])
    labels = np.array([1, 0, 1, 0, 1, 0, 0, 1] + [1, 0, 0, 0, 1, 1, 0, 0, 0] + [0, 0, 0] + [1, 1, 1, 1])[: sizes.sum()]
    scores = draw.integers(-2, 3, len(labels)).astype(float)  # with ties
    first, second = boosting.ndcg_gradients(scores[:, None], labels, sizes)
    at = 0
    for n in sizes:
        want = plain_lambdas(scores[at : at + n], labels[at : at + n])
        assert first[at : at + n, 0].tolist() == want[0] and second[at : at + n, 0].tolist() == want[1]
        at += n


def test_binning():
    binning = Binning(((0.0, 1.0, 5.0), ()))
    x = np.array([[-1, 3], [0, 3], [0.5, 3], [1, 3], [5, 3], [6, np.nan], [np.nan, 0]])
    assert binning(x).tolist() == [[0, 0], [0, 0], [1, 0], [1, 0], [2, 0], [3, 0], [3, 0]]
    assert binning.bins == 4


def test_cuts_at_quantiles(spark):
    df = spark.range(1000).select(F.array(F.col("id") % 2, F.col("id") * 1.0, F.lit(None).cast("double")).alias("x"))
    cuts = boosting.fit_binning(df, "x", 3, bins=8).cuts
    assert cuts[0] == (0.0,) and cuts[2] == ()
    assert len(cuts[1]) == 7 and all(abs(c - 125 * (i + 1)) < 40 for i, c in enumerate(cuts[1]))
    with pytest.raises(ValueError):
        boosting.fit_binning(df, "x", 3, bins=300)


def packed(spark, x, y, partitions):
    rows = [(i, 0, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "entity long, period int, x array<double>, idx int").repartition(partitions)
    binning = Binning(((0.0, 1.0, 2.0),) * x.shape[1])
    return boosting.examples(df, binning, "x", F.array("idx"), outputs=3), binning


@pytest.fixture(scope="module")
def plain():
    draw = np.random.default_rng(9)
    x = draw.integers(0, 4, (400, 5))
    return x, (x[:, 0] + (x[:, 1] > 1) * x[:, 2]) % 3


GROWTH = Growth(rounds=3, depth=3, subsample=1.1, columns=1.0)


def test_first_split_is_the_best_of_all(spark, plain):
    x, y = plain
    rows, binning = packed(spark, x, y, 3)
    trees = boosting.boost(rows, binning, 3, boosting.softmax_gradients, GROWTH).rounds[0]
    first, second = boosting.softmax_gradients(np.zeros((len(y), 3)), y, None)
    for k in range(3):
        g, h = first[:, k] / 1e6, second[:, k] / 1e6
        worth = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
        gains = {
            (f, c): worth(x[:, f] <= c) + worth(x[:, f] > c) - worth(x[:, f] >= 0)
            for f in range(5) for c in range(3)
        }
        best = max(gains.values())
        assert gains[trees.feature[k, 0], trees.cut[k, 0]] == pytest.approx(best)


def test_trees_do_not_depend_on_partitions(spark, plain, monkeypatch):
    x, y = plain
    found = []
    for partitions, direct in ((1, 64), (5, 64), (7, 2)):
        monkeypatch.setattr(boosting, "DIRECT", direct)
        rows, binning = packed(spark, x, y, partitions)
        found.append(boosting.boost(rows, binning, 3, boosting.softmax_gradients, GROWTH).margins(binning(x)))
    assert (found[0] == found[1]).all() and (found[0] == found[2]).all()
    assert (found[0].argmax(1) == y).mean() > 0.8


def test_subsample_and_columns(spark, plain):
    x, y = plain
    rows, binning = packed(spark, x, y, 2)
    model = boosting.boost(rows, binning, 3, boosting.softmax_gradients, Growth(rounds=8, depth=4))
    assert (model.margins(binning(x)).argmax(1) == y).mean() > 0.75
    share = boosting.drawn(np.arange(100_000), Growth(), 3).mean()
    assert share == pytest.approx(0.8, abs=0.01)


def test_one_example_and_one_class(spark):
    x, y = np.array([[1, 2]]), np.array([0])
    rows, binning = packed(spark, x, y, 1)
    model = boosting.boost(rows, binning, 3, boosting.softmax_gradients, GROWTH)
    assert model.margins(binning(x)).argmax() == 0


@pytest.mark.parametrize("nodes", [1, 5])
def test_sums_by_node_equal_a_plain_loop(nodes):
    draw = np.random.default_rng(4)
    cells = boosting.Cells((2, 1, 7, 2, 3))
    bins = np.column_stack([draw.integers(0, w, 200) for w in cells.widths]).astype(np.uint8)
    node, grads = draw.integers(0, nodes, 200), draw.integers(-1_000_000, 1_000_000, (200, 2)).astype(float)
    want = np.zeros((nodes, 2, sum(cells.widths)))
    for row, at, both in zip(bins, node, grads, strict=True):
        for f, b in enumerate(row):
            want[at, :, cells.starts[f] + b] += both
    assert (boosting.node_sums(bins, node, nodes, grads, cells) == want).all()
    spread = cells.spread(want, 7)
    assert spread.shape == (nodes, 2, 5, 7) and spread.sum() == want.sum() and (spread[:, :, 2] == want[:, :, 3:10]).all()


def test_sums_of_a_task_are_handed_on_once_and_hold_only_bins_that_occur(spark, plain, monkeypatch):
    x, y = plain
    monkeypatch.setattr(boosting, "PACK", 50)
    monkeypatch.setattr(boosting, "CHUNK", 60)
    rows, binning = packed(spark, x, y, 1)
    cells = boosting.cells_of(boosting.Binning((*binning.cuts[:4], (0.0,))))
    blocks = boosting.blocked(rows, 3)
    sums = boosting.gradient_sums(blocks, boosting.Round(3, 2), 0, cells, boosting.softmax_gradients, GROWTH, 0).collect()
    assert blocks.count() > 1 and sorted((r.tree, r.node) for r in sums) == [(0, 0), (1, 0), (2, 0)]
    assert all(len(r.sums) == 2 * 8 * (4 * 4 + 2) for r in sums)


def test_few_files_are_dealt_over_all_cores(spark, plain, monkeypatch):
    x, y = plain
    monkeypatch.setattr(boosting, "CHUNK", 10)  # 400 examples are more than a chunk for every core
    monkeypatch.setattr(boosting, "MOST", 400)
    seen = []
    grow = boosting.grow
    monkeypatch.setattr(boosting, "grow", lambda *a: (seen.append(a[-1]), grow(*a))[1])
    rows, binning = packed(spark, x, y, 1)
    boosting.boost(rows, binning, 3, boosting.softmax_gradients, Growth(rounds=1, depth=1))
    assert seen[0] > 1


def test_root_sums_equal_a_plain_loop(spark, plain):
    x, y = plain
    rows, binning = packed(spark, x, y, 3)
    first, second = boosting.softmax_gradients(np.zeros((len(y), 3)), y, None)
    want = {
        (k, f, b): (int(first[x[:, f] == b, k].sum()), int(second[x[:, f] == b, k].sum()))
        for k in range(3) for f in range(5) for b in range(4)
    }
    found = boosting.root_sums(rows, binning, 3, boosting.softmax_gradients).collect()
    assert {(r.tree, r.feature, r.bin): (r.gradient, r.hessian) for r in found} == want


@pytest.mark.parametrize("growth", [GROWTH, Growth(rounds=3, depth=5, least=3.0)])
def test_a_task_alone_grows_the_same_trees(spark, plain, monkeypatch, growth):
    x, y = plain
    rows, binning = packed(spark, x, y, 3)
    found, grow, jobs = [], boosting.grow_alone, []
    monkeypatch.setattr(boosting, "grow_alone", lambda *a: (jobs.append(a[-1]), grow(*a))[1])
    for limits in ((8, 80), (0, 0)):
        monkeypatch.setattr(boosting, "ALONE", limits)
        found.append(boosting.boost(rows, binning, 3, boosting.softmax_gradients, growth))
    assert jobs == [0, 1, 2]  # one job a round
    for one, two in zip(*[m.rounds for m in found], strict=True):
        assert (one.feature == two.feature).all() and (one.cut == two.cut).all() and (one.value == two.value).all()


def test_a_row_of_several_classes_is_as_many_examples(spark, plain, monkeypatch):
    x, y = plain
    also = (y + x[:, 3] % 2) % 3
    wide = [(i, 0, [float(v) for v in r], sorted({int(a), int(b)})) for i, (r, a, b) in enumerate(zip(x, y, also, strict=True))]
    together = spark.createDataFrame(wide, "entity long, period int, x array<double>, idx array<int>")
    binning = Binning(((0.0, 1.0, 2.0),) * x.shape[1])
    found = []
    for df, labels in ((together, F.col("idx")), (together.withColumn("idx", F.explode("idx")), F.array("idx"))):
        rows = boosting.examples(df, binning, "x", labels, outputs=3)
        assert rows.select(F.sum(F.length("margins"))).first()[0] == 24 * df.count()
        for limits in ((8, 80), (0, 0)):
            monkeypatch.setattr(boosting, "ALONE", limits)
            found.append(boosting.boost(rows, binning, 3, boosting.softmax_gradients, Growth(rounds=2, depth=4)).margins(binning(x)))
    assert all((found[0] == f).all() for f in found[1:])


def test_sketches_of_many_values_keep_their_ranks():
    values = np.random.default_rng(2).lognormal(size=300_000)
    kept, weights = boosting.thinned(values, np.ones(len(values)))
    assert len(kept) == boosting.POINTS and weights.sum() == len(values)
    for share in (0.01, 0.5, 0.99):
        at = np.searchsorted(weights.cumsum(), share * len(values))
        assert (values <= kept[at]).mean() == pytest.approx(share, abs=0.0005)


def test_cuts_count_a_row_by_its_weight(spark):
    df = spark.range(1000).select(F.array(F.col("id") * 1.0).alias("x"), F.when(F.col("id") < 500, 3).otherwise(1).alias("n")).repartition(4)
    cuts = boosting.fit_binning(df, "x", 1, bins=4, weight=F.col("n")).cuts
    assert cuts == ((166.0, 333.0, 499.0),)
