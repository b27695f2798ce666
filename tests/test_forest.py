"""Forests: splits against exhaustive ones, the same trees however they are grown, draws, planted sets."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import forest
from panelspark.operators.boosting import Binning
from panelspark.operators.forest import Growth, Layout, Plan

CUTS = (tuple(float(i) for i in range(5)), (0.0,), tuple(float(i) for i in range(3)), tuple(float(i) for i in range(11)))
NOMINAL = (False, False, True, True)
GROWTH = Growth(trees=6, depth=4)


@pytest.fixture(scope="module")
def plain():
    draw = np.random.default_rng(3)
    x = np.column_stack([draw.integers(0, w, 900) for w in (6, 2, 4, 12)])
    y = np.where(np.isin(x[:, 2], (0, 3)), 0, np.where(x[:, 3] % 2 == 0, 1, 2))
    return x, [sorted({int(c), int(draw.integers(0, 3))}) for c in y]


def rows_of(spark, x, labels, partitions):
    rows = [(i, 0, [float(v) for v in r], y) for i, (r, y) in enumerate(zip(x, labels, strict=True))]
    return spark.createDataFrame(rows, "entity long, period int, x array<double>, labels array<int>").repartition(partitions)


def gini_gain(sides):
    def worth(c):
        return (c**2).sum() / max(c.sum(), 1)
    return worth(sides[0]) + worth(sides[1]) - worth(sides[0] + sides[1])


def test_root_split_is_the_best_of_all(plain):
    x, labels = plain
    layout = Layout(np.array([len(c) + 1 for c in CUTS]), np.array(NOMINAL), 3)
    sizes = np.array([len(y) for y in labels])
    flat = np.array([c for y in labels for c in y])
    block = forest.Block(x.astype(np.uint8), sizes, flat, np.ones(len(flat), np.int64), np.arange(len(x)))
    for tree in range(4):
        plan = Plan.of(np.array([0]), tree, layout, GROWTH)
        weights = next(block.drawn(GROWTH, [tree]))[1]
        sums = np.zeros(plan.room(3))
        forest.count(block, np.zeros(len(x), np.int64), weights, plan, 3, sums)
        found = forest.best_splits(sums, plan, layout)
        gains = []
        for f in plan.features[0]:
            hist = np.zeros((layout.widths[f], 3))
            np.add.at(hist, (x[block.row, f], flat), weights)
            if not NOMINAL[f]:
                gains += [gini_gain((hist[:c].sum(0), hist[c:].sum(0))) for c in range(1, len(hist))]
            elif len(hist) <= forest.UNORDERED:
                for n in range(1, len(hist)):
                    for some in itertools.combinations(range(len(hist)), n):
                        inside = np.isin(np.arange(len(hist)), some)
                        gains.append(gini_gain((hist[inside].sum(0), hist[~inside].sum(0))))
        if layout.widths[found.feature[0]] <= forest.UNORDERED:
            assert gini_gain((found.left[0], found.rest[0])) == pytest.approx(max(gains))
        assert gini_gain((found.left[0], found.rest[0])) >= max(gains) - 1e-6
        goes = found.right[0].astype(bool)[x[block.row, found.feature[0]]]
        assert (np.bincount(flat[goes], weights[goes], 3) == found.rest[0]).all()


@pytest.mark.parametrize("cells", [0, 2**22])
def test_trees_do_not_depend_on_how_they_are_grown(spark, plain, monkeypatch, cells):
    """By row or by cell: alone, by level, in several jobs a level, with two steps of sums, from other partitions."""
    x, labels = plain
    monkeypatch.setattr(forest, "CELLS", cells)
    found = []
    for alone, held, direct, most, partitions in ((10**6, 2**25, 64, 500_000, 1), (0, 2**25, 64, 500_000, 4), (0, 100, 2, 10, 3)):
        for name, value in (("ALONE", alone), ("HELD", held), ("DIRECT", direct), ("MOST", most), ("STRIP", 100)):
            monkeypatch.setattr(forest, name, value)
        model = forest.fit_forest(rows_of(spark, x, labels, partitions), Binning(CUTS), NOMINAL, 3, GROWTH)
        found.append(model.shares(x.astype(np.uint8)))
    assert (found[0] == found[1]).all() and (found[0] == found[2]).all()
    assert found[0].sum(1) == pytest.approx(1)
    told = np.isin(x[:, 2], (0, 3))
    assert (found[0][told].argmax(1) == 0).mean() > 0.95


def test_classes_of_a_row_share_it_and_cells_are_counted(spark, plain, monkeypatch):
    """Work grows with rows and cells, not with adds."""
    x, labels = plain
    seen, blocked = [], forest.blocked
    monkeypatch.setattr(forest, "blocked", lambda rows: (seen.append(rows.count()), blocked(rows))[1])
    for cells in (0, 2**22):
        monkeypatch.setattr(forest, "CELLS", cells)
        forest.fit_forest(rows_of(spark, x, labels, 2), Binning(CUTS), NOMINAL, 3, Growth(trees=1, depth=1))
    assert seen == [len(x), len(np.unique(x, axis=0))] and sum(map(len, labels)) > 1.2 * len(x)


def test_draws_are_poisson():
    n = 40_000
    for counts in (np.ones(n, np.int64), np.full(n, 5)):
        block = forest.Block(np.zeros((n, 1), np.uint8), np.ones(n, np.int64), np.zeros(n, np.int64), counts, np.arange(n))
        drawn = dict(block.drawn(Growth(), [1, 2, 9]))
        assert dict(block.drawn(Growth(), [9]))[9].tolist() == drawn[9].tolist()
        for times in drawn.values():
            assert times.mean() == pytest.approx(0.7 * counts[0], rel=0.03) and times.var() == pytest.approx(0.7 * counts[0], rel=0.04)
        assert abs(np.corrcoef(drawn[1], drawn[2])[0, 1]) < 0.03 and abs(np.corrcoef(drawn[1], drawn[9])[0, 1]) < 0.03


def test_no_rows_and_too_many_bins(spark, plain):
    rows = rows_of(spark, *plain, 1)
    with pytest.raises(ValueError, match="at least one row"):
        forest.fit_forest(rows.filter(F.lit(False)), Binning(CUTS), NOMINAL, 3, GROWTH)
    with pytest.raises(ValueError, match="256"):
        forest.fit_forest(rows, Binning((tuple(map(float, range(300))), *CUTS[1:])), NOMINAL, 3, GROWTH)
