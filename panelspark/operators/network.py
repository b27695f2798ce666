"""A feed-forward net on trajectories of item sets, fitted by whole-table gradients that Spark adds up.

The inputs are 0/1 flags that stay bit sets until a task multiplies them: a stored row is a block of
about ROWS examples, longest trajectory first, so the real steps of each place are its first rows and
padding costs nothing.  A row with several adds is one example with several targets, which is the same
loss as one example per add.  An iteration is one scan: a task adds up its blocks' loss and gradient, a shuffle
sums the tasks' arrays slice by slice, and as many numbers as the net has weights reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from panelspark.session import SMALL, even_parts, materialize

ROWS = 2_048  # examples of a block; a task holds one block's flags
SLICE = 16_384  # numbers of a sum that one group of the shuffle adds up
MEMORY = 10  # steps that the curvature is estimated from
TOLERANCE = 1e-6  # of the first loss, over PATIENCE steps
PATIENCE = 20

BLOCKS = "sizes binary, flags binary, static binary, targets binary"


@dataclass(frozen=True)
class Shape:
    """Sizes of a net over ``length`` steps of three sets of ``items`` and ``static`` further numbers."""

    length: int
    items: int
    static: int
    hidden: int

    @property
    def step(self) -> int:
        return 3 * self.items

    @property
    def layers(self) -> list[int]:
        return [self.length * self.step + self.static, self.hidden, self.items]

    @property
    def weights(self) -> int:
        inputs, hidden, outputs = self.layers
        return (inputs + 1) * hidden + (hidden + 1) * outputs

    def parts(self, flat: np.ndarray) -> tuple[np.ndarray, ...]:
        """Views of the flat weights: by step and flag, of the static inputs, hidden bias, output, output bias."""
        inputs, hidden, outputs = self.layers
        cuts = np.cumsum([self.length * self.step * hidden, self.static * hidden, hidden, hidden * outputs])
        steps, static, first, out, last = np.split(flat, cuts)
        return (
            steps.reshape(self.length, self.step, hidden), static.reshape(self.static, hidden), first,
            out.reshape(hidden, outputs), last,
        )


@dataclass(frozen=True)
class Block:
    """Examples in falling order of their real steps; ``flags`` holds the real steps, oldest place first."""

    sizes: np.ndarray
    flags: np.ndarray
    static: np.ndarray
    targets: np.ndarray

    @staticmethod
    def of(sets: np.ndarray, static: np.ndarray, targets: np.ndarray, shape: Shape) -> tuple[Block, np.ndarray]:
        """Packed examples and the order they are in; ``sets`` is (rows, steps, three sets)."""
        there = sets.any(2)
        sizes = np.where(there.any(1), shape.length - there.argmax(1), 0)
        order = np.argsort(-sizes, kind="stable")
        sets, sizes = sets[order], sizes[order]
        packed = []
        for place in range(shape.length):
            here = np.ascontiguousarray(sets[: np.count_nonzero(sizes >= shape.length - place), place])
            bits = np.unpackbits(here.view(np.uint8).reshape(-1, 3, 8), axis=2, bitorder="little")
            packed.append(np.packbits(bits[:, :, : shape.items].reshape(-1, shape.step), axis=1))
        return Block(sizes.astype(np.int32), np.concatenate(packed), static[order], targets[order]), order

    def stored(self) -> pa.RecordBatch:
        """One row of BLOCKS."""
        arrays = (self.sizes, self.flags, self.static, self.targets)
        return pa.RecordBatch.from_arrays(
            [pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for a in arrays], ["sizes", "flags", "static", "targets"]
        )

    @staticmethod
    def read(batch: pa.RecordBatch, row: int, shape: Shape) -> Block:
        sizes, flags, static, targets = (batch.column(c)[row].as_buffer() for c in ("sizes", "flags", "static", "targets"))
        sizes = np.frombuffer(sizes, np.int32)
        return Block(
            sizes, np.frombuffer(flags, np.uint8).reshape(-1, -(-shape.step // 8)),
            np.frombuffer(static, float).reshape(len(sizes), shape.static), np.frombuffer(targets, np.int64),
        )

    def steps(self, shape: Shape) -> list[np.ndarray]:
        """0/1 flags of each place, of its real rows only."""
        out, at = [], 0
        for place in range(shape.length):
            rows = np.count_nonzero(self.sizes >= shape.length - place)
            out.append(np.unpackbits(self.flags[at : at + rows], axis=1, count=shape.step).astype(float))
            at += rows
        return out

    def wanted(self, shape: Shape) -> np.ndarray:
        """0/1 targets in catalogue order."""
        return (self.targets[:, None] >> np.arange(shape.items) & 1).astype(float)


def forward(block: Block, steps: list[np.ndarray], flat: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Hidden values and the ln chance of every item."""
    by_step, by_static, first, out, last = shape.parts(flat)
    z = block.static @ by_static + first
    for flags, weights in zip(steps, by_step, strict=True):
        if len(flags):
            z[: len(flags)] += flags @ weights
    hidden = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
    logit = hidden @ out + last
    logit -= logit.max(1, keepdims=True)
    return hidden, logit - np.log(np.exp(logit).sum(1, keepdims=True))


def block_sums(block: Block, flat: np.ndarray, shape: Shape) -> tuple[int, float, np.ndarray]:
    """Targets, summed loss and summed gradient of a block."""
    steps, wanted = block.steps(shape), block.wanted(shape)
    hidden, chance = forward(block, steps, flat, shape)
    _, _, _, out, _ = shape.parts(flat)
    many = wanted.sum(1, keepdims=True)
    back = many * np.exp(chance) - wanted
    inner = back @ out.T * hidden * (1 - hidden)
    grad = np.zeros(shape.weights)
    by_step, by_static, first, to_out, last = shape.parts(grad)
    for flags, into in zip(steps, by_step, strict=True):
        if len(flags):
            into += flags.T @ inner[: len(flags)]
    by_static += block.static.T @ inner
    first += inner.sum(0)
    to_out += hidden.T @ back
    last += back.sum(0)
    return int(many.sum()), -float((wanted * chance).sum()), grad


def packed(rows: DataFrame, sequence: str, static: Sequence[str], targets: str, shape: Shape) -> DataFrame:
    """BLOCKS of the rows; ``sequence`` holds three sets a step, oldest first."""
    chosen = rows.select(
        F.col(sequence).alias("sets"), F.array(*[F.col(c).cast("double") for c in static]).alias("static"), F.col(targets).alias("targets")
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(at, ROWS) for at in range(0, whole.num_rows, ROWS)):
                sets, numbers = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("sets", "static"))
                yield Block.of(
                    sets.reshape(-1, shape.length, 3), numbers.reshape(-1, shape.static), batch.column("targets").to_numpy(), shape
                )[0].stored()

    return chosen.mapInArrow(pack, BLOCKS)


def whole_cost(blocks: DataFrame, shape: Shape) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
    """Mean loss and its gradient over all targets, as a function of the weights; each call is one scan."""
    context = blocks.sparkSession.sparkContext

    def cost(flat: np.ndarray) -> tuple[float, np.ndarray]:
        shared = context.broadcast(flat)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            total = np.zeros(shape.weights + 2)
            for batch in batches:
                for row in range(batch.num_rows):
                    many, loss, grad = block_sums(Block.read(batch, row, shape), shared.value, shape)
                    total[0] += many
                    total[1] += loss
                    total[2:] += grad
            slices = range(0, len(total), SLICE)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(len(slices)), pa.int32()), pa.array([TaskContext.get().partitionId()] * len(slices), pa.int32()),
                    pa.array([total[at : at + SLICE].tobytes() for at in slices], pa.binary()),
                ],
                ["slice", "task", "sums"],
            )

        def summed(group: pd.DataFrame) -> pd.DataFrame:
            total = 0
            for sums in group.sort_values("task")["sums"]:
                total = total + np.frombuffer(sums)
            return pd.DataFrame({"slice": group["slice"].iloc[:1], "sums": [total.tobytes()]})

        tasks = blocks.mapInArrow(add, "slice int, task int, sums binary")
        found = tasks.groupBy("slice").applyInPandas(summed, "slice int, sums binary").collect()  # as many numbers as weights
        shared.destroy()
        if not found:
            return 0.0, np.zeros(shape.weights)
        total = np.concatenate([np.frombuffer(r["sums"]) for r in sorted(found, key=lambda r: r["slice"])])
        many = max(total[0], 1.0)
        return total[1] / many, total[2:] / many

    return cost


# --- limited-memory BFGS -------------------------------------------------------------------

Cost = Callable[[np.ndarray], tuple[float, np.ndarray]]


def direction(grad: np.ndarray, moves: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Downhill by the curvature that the last moves (of weights and of gradients) show."""
    out, kept = grad.copy(), []
    for s, y in reversed(moves):
        share = (s @ out) / (s @ y)
        out -= share * y
        kept.append(share)
    if moves:
        s, y = moves[-1]
        out *= (s @ y) / (y @ y)
    for (s, y), share in zip(moves, reversed(kept), strict=True):
        out += (share - (y @ out) / (s @ y)) * s
    return -out


def searched(
    cost: Cost, at: np.ndarray, way: np.ndarray, value: float, grad: np.ndarray, length: float
) -> tuple[np.ndarray, float, np.ndarray] | None:
    """A point on the way that meets the strong Wolfe conditions (1e-4, 0.9), with its value and gradient, or None."""
    slope = grad @ way

    def probe(t: float):
        x = at + t * way
        f, g = cost(x)
        return t, f, g @ way, x, g

    def between(a, b) -> float:
        """Least point of the cubic through both ends, a tenth of their distance away from them at least."""
        (l, fl, dl), (r, fr, dr) = sorted([a[:3], b[:3]])
        d1 = dl + dr - 3 * (fl - fr) / (l - r)
        d2 = np.sqrt(max(d1 * d1 - dl * dr, 0.0))
        low, high = l + 0.1 * (r - l), l + 0.9 * (r - l)
        bottom = dr - dl + 2 * d2
        t = r - (r - l) * (dr + d2 - d1) / bottom if bottom else (low + high) / 2
        return float(np.clip(t, low, high)) if np.isfinite(t) else (low + high) / 2

    low, high, t = (0.0, value, slope, at, grad), None, length
    for tried in range(20):
        if high is not None:
            t = between(low, high)
        now = probe(t)
        if high is None and not np.isfinite(now[1]):
            t /= 2
        elif not np.isfinite(now[1]) or now[1] > value + 1e-4 * t * slope or (now[1] >= low[1] and tried):
            high = now
        elif abs(now[2]) <= 0.9 * abs(slope):
            return now[3], now[1], now[4]
        elif high is None:
            low, high, t = (low, None, t * 1.5) if now[2] < 0 else (now, low, t)
            low = now
        else:
            if now[2] * (high[0] - low[0]) >= 0:
                high = low
            low = now
    return None


def minimised(cost: Cost, start: np.ndarray, iterations: int) -> np.ndarray:
    """Weights after at most ``iterations`` steps of limited-memory BFGS; fewer if the loss no longer falls."""
    x, (value, grad) = start, cost(start)
    first, seen, moves = value, [np.inf, value], []
    for _ in range(iterations):
        if np.linalg.norm(grad) <= max(TOLERANCE * abs(value), 1e-8):
            break
        way = direction(grad, moves)
        found = searched(cost, x, way, value, grad, 1.0 if moves else 1 / np.linalg.norm(way))
        if found is None and moves:  # the curvature misled: once more, straight downhill
            moves = []
            found = searched(cost, x, -grad, value, grad, 1 / np.linalg.norm(grad))
        if found is None:
            break
        moves = [*moves, (found[0] - x, found[2] - grad)][-MEMORY:]
        x, value, grad = found
        seen = [*seen, value][-PATIENCE:]
        if max(seen) - value <= TOLERANCE * first:
            break
    return x


def first_weights(spark: SparkSession, shape: Shape, seed: int) -> np.ndarray:
    """The weights that Spark ML's net of these layers starts from."""
    row = spark.createDataFrame([(0.0, Vectors.sparse(shape.layers[0], {}))], ["label", "features"])
    net = MultilayerPerceptronClassifier(layers=shape.layers, maxIter=0, seed=seed)
    return net.fit(row).weights.toArray()


def fit_net(
    rows: DataFrame, sequence: str, static: Sequence[str], targets: str, shape: Shape, iterations: int, seed: int
) -> np.ndarray:
    """Weights of the net that tells a row's targets from its trajectory and static columns."""
    spark = rows.sparkSession
    examples = rows.filter(F.col(targets) != 0)
    count = examples.count()
    blocks = packed(examples, sequence, static, targets, shape)
    if count > SMALL:  # dealt evenly, because every iteration waits for the longest task
        blocks = blocks.repartition(even_parts(spark, count))
    return minimised(whole_cost(materialize(blocks, "net-blocks"), shape), first_weights(spark, shape, seed), iterations)


def net_scores(rows: DataFrame, flat: np.ndarray, sequence: str, static: Sequence[str], shape: Shape) -> DataFrame:
    """Rows with ``scores``, the chance of each item in catalogue order."""
    shared = rows.sparkSession.sparkContext.broadcast(flat)

    @pandas_udf("array<double>")
    def scores(sets: pd.Series, numbers: pd.Series) -> pd.Series:
        out = []
        for at in range(0, len(sets), ROWS):
            there = np.stack(sets.iloc[at : at + ROWS].to_list()).reshape(-1, shape.length, 3)
            values = np.stack(numbers.iloc[at : at + ROWS].to_list()).astype(float)
            block, order = Block.of(there, values, np.zeros(len(there), np.int64), shape)
            chance = np.empty((len(there), shape.items))
            chance[order] = np.exp(forward(block, block.steps(shape), shared.value, shape)[1])
            out.extend(chance)
        return pd.Series(out)

    numbers = F.array(*[F.col(c).cast("double") for c in static])
    return rows.select(*rows.columns, scores(F.col(sequence), numbers).alias("scores"))
