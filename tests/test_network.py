"""The trajectory net against finite differences and against Spark ML's own net."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from panelspark.operators import network, rankers
from panelspark.operators.trajectory import flatten_trajectory, trajectories, trim_trajectory
from panelspark.spec import PanelSpec

SPEC = PanelSpec("net", ("a", "b", "c", "d", "e"), k=2, measured=9, season_length=4)
LENGTH = 4


@pytest.fixture(scope="module")
def features(spark):
    """One add of the newest step's dropped item in most rows; histories of 0 to 8 steps."""
    rng = random.Random(8)
    rows = []
    for entity in range(40):
        for period in range(rng.randint(1, 9)):
            add = 1 << rng.randrange(5) | (rng.random() < 0.3) << rng.randrange(5)
            rows.append((entity, period, rng.randrange(32), add if rng.random() < 0.8 else 0, rng.randrange(32), rng.random()))
    return spark.createDataFrame(rows, "entity long, period int, prev_bits long, add_bits long, drop_bits long, history double")


def test_gradient_equals_finite_differences():
    shape = network.Shape(3, 5, 2, 4)
    draw = np.random.default_rng(1)
    sets = draw.integers(0, 32, (30, 3, 3))
    sets[:10, 0], sets[:5, 1], sets[:2] = 0, 0, 0
    block, _ = network.Block.of(sets, draw.normal(size=(30, 2)), draw.integers(0, 32, 30), shape)
    again = network.Block.read(block.stored(), 0, shape)
    flat = draw.normal(size=shape.weights)
    _, _, grad = network.block_sums(again, flat, shape)
    for at in draw.choice(shape.weights, 40, replace=False):
        ends = []
        for move in (1e-6, -1e-6):
            near = flat.copy()
            near[at] += move
            ends.append(network.block_sums(again, near, shape)[1])
        assert grad[at] == pytest.approx((ends[0] - ends[1]) / 2e-6, abs=1e-4)


def test_same_scores_as_the_net_of_spark_ml(spark, features):
    """One block of that net: it weighs a part block like a full one, so its loss depends on partitions else."""
    rows = rankers.sequence_inputs(features, SPEC, LENGTH).cache()
    fitted = rankers.fit_sequence(rows, SPEC, LENGTH, ("history",), hidden=6, iterations=8)
    ours = {(r.entity, r.period): r.scores for r in rankers.score_sequence(fitted, rows, SPEC).collect()}
    flat = flatten_trajectory(trim_trajectory(trajectories(features, LENGTH), LENGTH), SPEC)
    values = F.concat(F.transform("flags", lambda v: v.cast("double")), F.array("history"))
    table = flat.select("entity", "period", "add_bits", array_to_vector(values).alias("features"))
    adds = table.select("*", F.explode(F.lit(list(range(5)))).alias("idx")).filter(F.getbit("add_bits", F.col("idx")) == 1)
    net = MultilayerPerceptronClassifier(layers=[61, 6, 5], maxIter=8, blockSize=10_000, seed=rankers.SEED)
    theirs = net.fit(adds.withColumn("label", F.col("idx").cast("double")).coalesce(1)).transform(table)
    found = theirs.select("entity", "period", vector_to_array("probability").alias("p")).collect()
    assert len(found) == len(ours) == features.count()
    for r in found:
        assert ours[r.entity, r.period] == pytest.approx(r.p, abs=1e-6)


def test_a_long_trajectory_stays_bit_sets(spark, features):
    """A dense vector of 16 steps of 62 items took 23,808 bytes a row and add."""
    wide = PanelSpec("wide", tuple(f"i{i}" for i in range(62)), k=2, measured=9, season_length=4)
    rows = rankers.sequence_inputs(features, wide, 16)
    assert rows.schema["sequence"].dataType.simpleString() == "array<bigint>"
    blocks = network.packed(rows, "sequence", ("history",), "add_bits", network.Shape(16, 62, 1, 4))
    size = blocks.select(F.sum(F.length("flags") + F.length("sizes") + F.length("static") + F.length("targets"))).first()[0]
    assert size <= features.count() * (9 * 24 + 20)


def test_without_adds_the_first_weights_stay(spark, features):
    rows = rankers.sequence_inputs(features, SPEC, LENGTH)
    fitted = rankers.fit_sequence(rows.filter("add_bits = 0"), SPEC, LENGTH, ("history",), hidden=6, iterations=3)
    scored = rankers.score_sequence(fitted, rows.limit(5), SPEC).collect()
    assert all(sum(r.scores) == pytest.approx(1.0) for r in scored)
