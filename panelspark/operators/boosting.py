"""Boosted trees on binned predictors, grown from gradient sums that Spark adds up.

All trees of a round grow level by level in one scan per level: a task turns its rows into
gradients, adds them up by (tree, node, predictor, bin), and hands one packed array per (tree,
node) to a shuffle that sums the tasks' arrays and picks each node's best split.  Only the
splits come to the driver, at most two to the power of the level for each tree.  Gradients are whole millionths, so
the sums, and with them the trees, do not depend on partitions or re-run tasks.

Of a small table every task reads all rows and grows some of the round's trees, level after level, in one job.

Margins are written after every round to one of two folders in turn: a level reads one round's
margins and applies the unfinished trees only, and the disk holds two copies of the table.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.fixedpoint import MICRO
from panelspark.session import new_shared_folder

CHUNK = 50_000  # examples whose gradients a task holds at once
PACK = 5_000  # examples of a stored row
MOST = 500_000  # examples of a task, chunk after chunk
ALONE = 8, 80  # chunks of examples, and of their margins, of a table that one task holds whole
DIRECT = 64  # tasks whose arrays one sum takes; more are summed in two steps


@dataclass(frozen=True)
class Binning:
    """Ascending cuts per predictor; the bin of a value is the number of cuts below it.

    A missing value falls behind the last cut.
    """

    cuts: tuple[tuple[float, ...], ...]

    @property
    def bins(self) -> int:
        return max((len(c) for c in self.cuts), default=0) + 1

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(x.shape, np.uint8)
        for f, cuts in enumerate(self.cuts):
            out[:, f] = np.searchsorted(cuts, x[:, f], side="left")
        return out


POINTS = 4_096  # values by which a sketch knows a predictor; fewer distinct ones are all kept
BUFFER = 65_536  # values that are sorted at once


def thinned(values: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values with their weights; beyond POINTS those at even ranks, with the weight up to them."""
    values, place = np.unique(values, return_inverse=True)
    running = np.bincount(place, weights, len(values)).cumsum()
    if len(values) > POINTS:
        kept = np.unique(np.searchsorted(running, running[-1] * np.arange(1, POINTS + 1) / POINTS - 1e-6).clip(max=len(values) - 1))
        values, running = values[kept], running[kept]
    return values, np.diff(running, prepend=0)


def fit_binning(df: DataFrame, vector: str, width: int, bins: int = 64, weight: Column | None = None) -> Binning:
    """Cuts at quantiles of each predictor, a row counting ``weight`` times, from mergeable sketches in one pass."""
    if not 1 < bins <= 256:
        raise ValueError(f"2..256 bins, got {bins}")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(width)]
        waiting: list[tuple[np.ndarray, np.ndarray]] = []

        def taken_in() -> None:
            x, w = (np.concatenate(parts) for parts in zip(*waiting, strict=True))
            waiting.clear()
            for f, known in enumerate(held):
                there = ~np.isnan(x[:, f])
                known.append(thinned(x[there, f], w[there]))
                if sum(len(v) for v, _ in known) > 16 * POINTS or len(known) > 16:
                    known[:] = [thinned(*(np.concatenate(c) for c in zip(*known, strict=True)))]

        for batch in batches:
            if batch.num_rows:
                flat = batch.column("x").flatten().to_numpy(zero_copy_only=False)
                waiting.append((flat.reshape(batch.num_rows, -1)[:, :width], batch.column("w").to_numpy(zero_copy_only=False)))
                if sum(len(w) for _, w in waiting) >= BUFFER:
                    taken_in()
        if waiting:
            taken_in()
        for f, known in enumerate(held):
            if known:
                values, weights = thinned(*(np.concatenate(c) for c in zip(*known, strict=True)))
                arrays = [pa.array([f], pa.int32()), *[pa.array([a.tobytes()], pa.binary()) for a in (values, weights)]]
                yield pa.RecordBatch.from_arrays(arrays, ["f", "points", "weights"])

    def cut(group: pd.DataFrame) -> pd.DataFrame:
        values = np.concatenate([np.frombuffer(v, float) for v in group["points"]])
        weights = np.concatenate([np.frombuffer(v, float) for v in group["weights"]])
        order = np.argsort(values, kind="stable")
        values, running = values[order], weights[order].cumsum()
        found: list[float] = []
        if len(values):
            at = np.searchsorted(running, running[-1] * np.arange(1, bins) / bins - 1e-6).clip(max=len(values) - 1)
            found = sorted({float(v) for v in values[at] if v < values[-1]})
        return pd.DataFrame({"f": [int(group["f"].iloc[0])], "cuts": [found]})

    counted = df.select(F.col(vector).alias("x"), (F.lit(1) if weight is None else weight).cast("double").alias("w"))
    sketches = counted.mapInArrow(sketch, "f int, points binary, weights binary")
    made = {r["f"]: tuple(r["cuts"]) for r in sketches.groupBy("f").applyInPandas(cut, "f int, cuts array<double>").collect()}
    return Binning(tuple(made.get(f, ()) for f in range(width)))


@dataclass(frozen=True)
class Growth:
    """Size and brakes of the trees; fixed values: those of the usual defaults."""

    rounds: int = 80
    depth: int = 8
    step: float = 0.1
    subsample: float = 0.8
    columns: float = 0.8
    ridge: float = 1.0
    least: float = 1.0  # sum of second derivatives in a child at least
    seed: int = 42


@dataclass
class Round:
    """One tree per output as heaps: children of node i are 2 i + 1 and 2 i + 2."""

    outputs: int
    depth: int
    feature: np.ndarray = field(init=False)
    cut: np.ndarray = field(init=False)
    value: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        shape = (self.outputs, 2 ** (self.depth + 1) - 1)
        self.feature, self.cut, self.value = np.full(shape, -1, np.int16), np.zeros(shape, np.uint8), np.zeros(shape)

    def places(self, x: np.ndarray, levels: int | None = None) -> np.ndarray:
        """Node of every example (row) in every tree (column)."""
        flat, row = np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1]
        out = np.zeros((self.outputs, len(x)), np.int32)
        for k in range(self.outputs):
            node, feature, cut = out[k], np.maximum(self.feature[k], 0), self.cut[k]
            inner = self.feature[k] >= 0
            for level in range(self.depth if levels is None else levels):
                open_ = inner[2**level - 1 : 2 ** (level + 1) - 1]
                if not open_.any():
                    break
                right = flat.take(row + feature.take(node)) > cut.take(node)
                below = 2 * node + 1 + right
                node = below if open_.all() else np.where(inner.take(node), below, node)
            out[k] = node
        return out.T

    def margins(self, x: np.ndarray) -> np.ndarray:
        return self.value[np.arange(self.outputs)[None, :], self.places(x)]


@dataclass(frozen=True)
class BoostedTrees:
    binning: Binning
    rounds: tuple[Round, ...]
    outputs: int

    def margins(self, bins: np.ndarray) -> np.ndarray:
        total = np.zeros((len(bins), self.outputs))
        for trees in self.rounds:
            total += trees.margins(bins)
        return total


# --- gradients -----------------------------------------------------------------------------

def micros(values: np.ndarray) -> np.ndarray:
    return np.floor(values * MICRO + 0.5).astype(np.int64)


def softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def softmax_gradients(margins: np.ndarray, labels: np.ndarray, sizes: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """First and twice the second derivatives of the multiclass log loss, in millionths.

    A row stands for ``sizes`` examples, one of each of its labels; without sizes each row has one.
    """
    p = softmax(margins)
    times = np.ones(len(p), np.int64) if sizes is None else sizes
    first = micros(p) * times[:, None]
    np.subtract.at(first, (np.repeat(np.arange(len(p)), times), labels), MICRO)
    return first, micros(2 * p * (1 - p)) * times[:, None]


def ndcg_gradients(margins: np.ndarray, labels: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairwise logistic derivatives within a group, weighted by the NDCG that a swap would change.

    Groups are the consecutive ``sizes`` examples, at most a catalogue each; equal scores
    rank in the order given.
    """
    first, second = np.zeros(len(margins), np.int64), np.zeros(len(margins), np.int64)
    ends = np.cumsum(sizes)
    for at in range(0, len(sizes), 2_000):
        size, end = sizes[at : at + 2_000], ends[at : at + 2_000]
        place = (end - size)[:, None] + np.arange(size.max(initial=0))[None, :]
        there = place < end[:, None]
        place = np.where(there, place, 0)
        score = np.where(there, margins[place, 0], -np.inf)
        good = there & (labels[place] == 1)
        order = np.argsort(-score, axis=1, kind="stable")
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(order.shape[1])[None, :] + 1, axis=1)
        gain = 1 / np.log2(1 + rank)
        ideal = np.concatenate([[0.0], np.cumsum(1 / np.log2(2 + np.arange(order.shape[1])))])[good.sum(1)]
        g, i, j = np.nonzero(good[:, :, None] & (there & ~good)[:, None, :])
        swap = np.abs(gain[g, i] - gain[g, j]) / ideal[g]
        wrong = 1 / (1 + np.exp(score[g, i] - score[g, j]))
        pull, bend = micros(wrong * swap), micros(wrong * (1 - wrong) * swap)
        np.add.at(first, place[g, i], -pull)
        np.add.at(first, place[g, j], pull)
        np.add.at(second, place[g, i], bend)
        np.add.at(second, place[g, j], bend)
    return first[:, None], second[:, None]


Gradients = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


# --- examples ------------------------------------------------------------------------------

EXAMPLES = "seed long, x binary, items array<int>, labels array<int>, margins binary"


def examples(df: DataFrame, binning: Binning, vector: str, labels: Column, items: Column | None = None, outputs: int = 1, start: Column | None = None) -> DataFrame:
    """Packed rows: bins of the row's predictors, its candidate items, their labels and margins.

    Without ``items`` a row is an example of each of the classes in ``labels``, all with the row's margins.
    ``start`` are first margins in the order of the items.
    """
    none = F.lit(None).cast("array<int>")
    chosen = df.select(
        F.xxhash64("entity", "period").alias("seed"), F.col(vector).alias("x"),
        (none if items is None else items).alias("items"), labels.alias("labels"),
        (F.lit(None) if start is None else start).cast("array<double>").alias("start"),
    )

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                bins = binning(np.array(frame["x"].to_list(), float))
                first = [
                    (np.zeros((1 if c is None else len(c), outputs)) if s is None else np.asarray(s, float)).tobytes()
                    for c, s in zip(frame["items"], frame["start"], strict=True)
                ]
                yield pd.DataFrame({
                    "seed": frame["seed"], "x": [b.tobytes() for b in bins], "items": frame["items"],
                    "labels": frame["labels"], "margins": first,
                })

    return chosen.mapInPandas(pack, EXAMPLES)


PARTS = ("bins", "labels", "sizes", "margins", "seeds")
BLOCKS = ", ".join(f"{p} binary" for p in PARTS)


@dataclass(frozen=True)
class Block:
    """Rows of packed examples; ``bins`` and ``margins`` have a row per candidate, or per row without candidates."""

    bins: np.ndarray
    labels: np.ndarray
    sizes: np.ndarray
    margins: np.ndarray
    seeds: np.ndarray

    @staticmethod
    def of(table: pa.Table, outputs: int) -> Block:
        """From Arrow columns as they come: lists and bytes of a whole table are read in one piece."""
        labels, items = (table.column(c).combine_chunks() for c in ("labels", "items"))
        sizes = pc.list_value_length(labels).to_numpy(zero_copy_only=False).astype(np.int64)
        bins = np.frombuffer(b"".join(table.column("x").to_pylist()), np.uint8).reshape(len(sizes), -1)
        if not items.null_count:
            bins = np.repeat(bins, sizes, axis=0) if (sizes != 1).any() else bins
            bins = np.column_stack([bins, items.flatten().to_numpy(zero_copy_only=False).astype(np.uint8)])
        return Block(
            bins, labels.flatten().to_numpy(zero_copy_only=False).astype(np.int64), sizes,
            np.frombuffer(b"".join(table.column("margins").to_pylist()), float).reshape(-1, outputs), table.column("seed").to_numpy(),
        )


    def stored(self) -> pa.RecordBatch:
        """One row of BLOCKS."""
        arrays = (self.bins, self.labels.astype(np.int32), self.sizes.astype(np.int32), self.margins, self.seeds)
        return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for a in arrays], list(PARTS))

    @staticmethod
    def read(row: dict[str, bytes], outputs: int) -> Block:
        margins = np.frombuffer(row["margins"], float).reshape(-1, outputs)
        return Block(
            np.frombuffer(row["bins"], np.uint8).reshape(len(margins), -1), np.frombuffer(row["labels"], np.int32).astype(np.int64),
            np.frombuffer(row["sizes"], np.int32).astype(np.int64), margins, np.frombuffer(row["seeds"], np.int64),
        )

    def where(self, rows: np.ndarray) -> Block:
        """The rows of a mask."""
        labels = np.repeat(rows, self.sizes)
        inside = labels if len(self.bins) == len(labels) else rows
        return Block(self.bins[inside], self.labels[labels], self.sizes[rows], self.margins[inside], self.seeds[rows])

    @staticmethod
    def joined(blocks: list[Block]) -> Block:
        return blocks[0] if len(blocks) == 1 else Block(*[np.concatenate([getattr(b, p) for b in blocks]) for p in PARTS])


def blocked(rows: DataFrame, outputs: int) -> DataFrame:
    """Packed examples as rows of about PACK examples, so that a level's scan copies bytes and reads no single rows."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                block = Block.of(pa.Table.from_batches([batch]), outputs)
                ends, at = np.cumsum(block.sizes), 0
                candidates = len(block.bins) == len(block.labels)
                while at < len(ends):
                    start = ends[at - 1] if at else 0
                    to = max(int(np.searchsorted(ends, start + PACK, side="right")), at + 1)
                    part, row = slice(start, ends[to - 1]), slice(at, to)
                    inside = part if candidates else row
                    yield Block(block.bins[inside], block.labels[part], block.sizes[row], block.margins[inside], block.seeds[row]).stored()
                    at = to

    return rows.mapInArrow(pack, BLOCKS)


def chunks(batches: Iterator[pa.RecordBatch], outputs: int) -> Iterator[Block]:
    """Blocks of about CHUNK examples across the batches of a task."""
    waiting, size = [], 0
    for batch in batches:
        for i in range(batch.num_rows):
            block = Block.read({p: batch.column(p)[i].as_buffer() for p in PARTS}, outputs)
            waiting.append(block)
            size += len(block.bins)
            if size >= CHUNK:
                yield Block.joined(waiting)
                waiting, size = [], 0
    if waiting:
        yield Block.joined(waiting)


def drawn(seeds: np.ndarray, growth: Growth, number: int) -> np.ndarray:
    """Which rows a round learns from: a repeatable draw by row and round."""
    mixed = seeds.astype(np.int64).view(np.uint64) ^ np.uint64((growth.seed * 1_000_003 + number) * 0x9E3779B97F4A7C15 % 2**64)
    for shift in (33, 29):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(0xFF51AFD7ED558CCD)
    return (mixed >> np.uint64(11)).astype(float) / 2.0**53 < growth.subsample


# --- growing -------------------------------------------------------------------------------

SUMS = "tree int, node int, part int, sums binary"
HELD = 2**25  # cells of sums that a task keeps before it hands them on


@dataclass(frozen=True)
class Cells:
    """Where a predictor's bins lie in a packed row of sums, which has no room for bins that no value has."""

    widths: tuple[int, ...]

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.widths)])

    @property
    def bins(self) -> int:
        return max(self.widths, default=1)

    def spread(self, packed: np.ndarray, bins: int) -> np.ndarray:
        """Sums of (..., cells) as (..., predictors, bins), missing bins being 0."""
        out = np.zeros((*packed.shape[:-1], len(self.widths), bins), packed.dtype)
        for f, (at, width) in enumerate(zip(self.starts, self.widths, strict=False)):
            out[..., f, :width] = packed[..., at : at + width]
        return out


def cells_of(binning: Binning, items: int = 0) -> Cells:
    return Cells((*[len(c) + 1 for c in binning.cuts], *([items] if items else [])))


def node_sums(bins: np.ndarray, node: np.ndarray, nodes: int, grads: np.ndarray, cells: Cells) -> np.ndarray:
    """(nodes, 2, cells) sums of the (rows, 2) ``grads`` by node, predictor and bin.

    Whole numbers far below 2^53 are added, so doubles are exact.  A flag's bin 0 is what its bin 1
    leaves of the node's total, and all flags' bins 1 are one product of matrices per node.
    """
    starts, widths = cells.starts, np.array(cells.widths)
    size = int(starts[-1])
    out = np.zeros((nodes, 2, size))
    order = np.argsort(node.astype(np.uint16), kind="stable") if nodes > 1 else np.arange(len(node))
    node, bins, grads = node[order], bins.take(order, axis=0) if nodes > 1 else bins, np.ascontiguousarray(grads[order].T)
    ends = np.searchsorted(node, np.arange(nodes + 1))
    flags, wide = np.flatnonzero(widths <= 2), np.flatnonzero(widths > 2)
    upper = flags[widths[flags] == 2]
    seen = bins.take(upper, axis=1).astype(float) if len(upper) else None
    for i, (low, high) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        all_ = grads[:, low:high].sum(1)
        out[i][:, starts[flags]] = all_[:, None]
        if seen is not None and high > low:
            out[i][:, starts[upper] + 1] = grads[:, low:high] @ seen[low:high]
            out[i][:, starts[upper]] -= out[i][:, starts[upper] + 1]
    base = node.astype(np.int64)
    for f in wide:
        width = int(widths[f])
        index = base * width + bins[:, f]
        for side in range(2):
            found = np.bincount(index, grads[side], nodes * width)
            out[:, side, starts[f] : starts[f] + width] = found.reshape(nodes, width)
    return out


def packed_sums(trees, nodes, parts, sums) -> pa.RecordBatch:
    whole = [pa.array(np.asarray(c, np.int32)) for c in (trees, nodes, parts)]
    return pa.RecordBatch.from_arrays([*whole, pa.array([s.tobytes() for s in sums], pa.binary())], ["tree", "node", "part", "sums"])


def gradient_sums(rows: DataFrame, trees: Round, level: int, cells: Cells, gradients: Gradients, growth: Growth, number: int) -> DataFrame:
    """(tree, node, part, sums): int64 arrays (2, cells) of a level's open nodes, per task."""
    first_node, size = 2**level - 1, int(cells.starts[-1])
    level_nodes = np.arange(first_node, 2 * first_node + 1)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def handed_on() -> Iterator[pa.RecordBatch]:
            for k, (open_, sums) in held.items():
                packed = sums.astype(np.int64)
                yield packed_sums(np.full(len(open_), k), open_ + first_node, np.full(len(open_), part), packed)
            held.clear()

        for block in chunks(batches, trees.outputs):
            block = block.where(drawn(block.seeds, growth, number))
            bins, grads = block.bins, np.stack(gradients(block.margins, block.labels, block.sizes), axis=2).astype(float)
            node = trees.places(bins, level)
            for k in range(trees.outputs):
                local = node[:, k] - first_node
                counts = np.bincount(local[local >= 0], minlength=len(level_nodes))
                open_ = np.flatnonzero((counts > 0) & (trees.value[k, level_nodes] != CLOSED))
                if not len(open_):
                    continue
                number_of = np.full(len(level_nodes) + 1, -1)  # the last one for rows in leaves above
                number_of[open_] = np.arange(len(open_))
                place = number_of[np.maximum(local, -1)]
                if (place >= 0).all():
                    made = node_sums(bins, place, len(open_), grads[:, k], cells)
                else:
                    at = np.flatnonzero(place >= 0)
                    made = node_sums(bins[at], place[at], len(open_), grads[at, k], cells)
                if k not in held:
                    held[k] = open_, made
                elif np.array_equal(held[k][0], open_):
                    held[k][1][:] += made
                else:
                    every = np.union1d(held[k][0], open_)
                    sums = np.zeros((len(every), 2, size))
                    sums[np.searchsorted(every, held[k][0])] = held[k][1]
                    sums[np.searchsorted(every, open_)] += made
                    held[k] = every, sums
            if sum(sums.size for _, sums in held.values()) > HELD:
                yield from handed_on()
        yield from handed_on()

    return rows.mapInArrow(add_up, SUMS)


CLOSED = np.inf  # mark of a node that cannot be split, before it gets its value


def total(arrays: pd.Series) -> np.ndarray:
    out = np.frombuffer(arrays.iloc[0], np.int64).copy()
    for more in arrays.iloc[1:]:
        out += np.frombuffer(more, np.int64)
    return out


def totals(batches: Iterator[pa.RecordBatch]) -> dict[tuple[int, int, int], np.ndarray]:
    """Sums by (tree, node, part) of a task that has all rows of its keys."""
    found: dict[tuple[int, int, int], np.ndarray] = {}
    for batch in batches:
        for *key, sums in zip(*[batch.column(c).to_pylist() for c in ("tree", "node", "part", "sums")], strict=True):
            key, more = tuple(key), np.frombuffer(sums, np.int64)
            if key in found:
                found[key] += more
            else:
                found[key] = more.copy()
    return found


def summed(sums: DataFrame, parts: int) -> DataFrame:
    """With many tasks, first sums of about the root of their number."""
    if parts <= DIRECT:
        return sums
    groups = math.isqrt(parts)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = totals(batches)
        if found:
            yield packed_sums(*zip(*found, strict=True), found.values())

    dealt = sums.withColumn("part", (F.col("part") % groups).cast("int"))
    return dealt.repartition("tree", "node", "part").mapInArrow(add, SUMS)


SPLITS = "tree int, node int, feature int, cut int, gain double, left_first double, left_second double, first double, second double"


def chosen_splits(found: dict[tuple[int, int, int], np.ndarray], cells: Cells, growth: Growth, number: int) -> Iterator[list[tuple]]:
    """Rows of SPLITS, 64 nodes at once; ties go to the earlier predictor, then the lower cut."""
    bins, width = cells.bins, len(cells.widths)

    def worth(a, b):
        return a * a / (b + growth.ridge)

    keys, left_out = list(found), {}
    for at in range(0, len(keys), 64):
        some = keys[at : at + 64]
        both = np.stack([found[key] for key in some]).reshape(len(some), 2, -1)
        first, second = np.moveaxis(cells.spread(both, bins) / MICRO, 1, 0)
        left, weight = first.cumsum(2)[:, :, :-1], second.cumsum(2)[:, :, :-1]
        all_first, all_second = (np.array([node[0].sum() for node in side]) for side in (first, second))
        whole_first, whole_second = all_first[:, None, None], all_second[:, None, None]
        gain = worth(left, weight) + worth(whole_first - left, whole_second - weight) - worth(whole_first, whole_second)
        gain = np.where((weight >= growth.least) & (whole_second - weight >= growth.least), gain, -np.inf)
        rows = []
        for i, (tree, node, _) in enumerate(some):
            if growth.columns < 1:
                if tree not in left_out:
                    draw = np.random.default_rng((growth.seed, number, tree))
                    left_out[tree] = draw.permutation(width)[max(1, math.ceil(growth.columns * width)) :]
                gain[i, left_out[tree]] = -np.inf
            feature, cut = divmod(int(gain[i].argmax()), bins - 1) if gain[i].size else (0, 0)
            top = float(gain[i].max(initial=-np.inf))
            good = top > 1e-6
            chosen = (left[i, feature, cut], weight[i, feature, cut]) if good else (0.0, 0.0)
            rows.append((tree, node, feature if good else -1, cut, top if good else 0.0, *chosen, all_first[i], all_second[i]))
        yield rows


def best_splits(sums: DataFrame, cells: Cells, growth: Growth, number: int) -> DataFrame:
    """The best split of every node."""
    names = [c.split()[0] for c in SPLITS.split(", ")]
    kinds = [{"int": pa.int32(), "double": pa.float64()}[c.split()[1]] for c in SPLITS.split(", ")]

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in chosen_splits(totals(batches), cells, growth, number):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    one = sums.withColumn("part", F.lit(0))
    return one.repartition("tree", "node").mapInArrow(choose, SPLITS)


def settled(trees: Round, splits: Sequence[dict], closed: dict[tuple[int, int], float], growth: Growth) -> bool:
    """Take over a level's splits; whether any child can be split."""
    def leaf(first: float, second: float) -> float:
        return -growth.step * first / (second + growth.ridge)

    any_open = False
    for s in splits:
        k, node = s["tree"], s["node"]
        if s["feature"] < 0:
            trees.value[k, node] = leaf(s["first"], s["second"])
            continue
        trees.feature[k, node], trees.cut[k, node] = s["feature"], s["cut"]
        for side, first, second in (
            (1, s["left_first"], s["left_second"]),
            (2, s["first"] - s["left_first"], s["second"] - s["left_second"]),
        ):
            child = 2 * node + side
            trees.value[k, child] = leaf(first, second)
            if second < 2 * growth.least:
                closed[k, child], trees.value[k, child] = trees.value[k, child], CLOSED
            else:
                any_open = True
    return any_open


def grow(rows: DataFrame, outputs: int, cells: Cells, gradients: Gradients, growth: Growth, number: int, parts: int) -> Round:
    """The trees of one round: one job per level."""
    trees = Round(outputs, growth.depth)
    closed: dict[tuple[int, int], float] = {}
    for level in range(growth.depth):
        sums = gradient_sums(rows, trees, level, cells, gradients, growth, number)
        splits = best_splits(summed(sums, parts), cells, growth, number).collect()
        if not settled(trees, splits, closed, growth):
            break
    for (k, node), value in closed.items():
        trees.value[k, node] = value
    return trees


def grown_alone(bins: np.ndarray, grads: np.ndarray, tree: int, cells: Cells, growth: Growth, number: int) -> Round:
    """One tree from rows that lie in memory, as ``grow`` makes it.

    Only the smaller child of a split is added up: the other one is what it leaves of its parent, exactly.
    """
    names = [c.split()[0] for c in SPLITS.split(", ")]
    out, closed, known = Round(1, growth.depth), {}, {}
    place, size = np.zeros(len(bins), np.int64), int(cells.starts[-1])
    for level in range(growth.depth):
        first_node = 2**level - 1
        counts = np.bincount(np.maximum(place - first_node, -1) + 1, minlength=2**level + 1)[1:]
        open_ = [n for n in (np.flatnonzero(counts) + first_node).tolist() if out.value[0, n] != CLOSED]
        if not open_:
            break
        alone = [n for n in open_ if not (level and n + (1 if n % 2 else -1) in open_ and (counts[n - first_node], n) > (counts[n - first_node + (1 if n % 2 else -1)], n + (1 if n % 2 else -1)))]
        number_of = np.full(2 ** (level + 1), -1)
        number_of[alone] = np.arange(len(alone))
        at = np.flatnonzero(number_of[place] >= 0) if level else np.arange(len(bins))
        made = node_sums(bins[at], number_of[place[at]], len(alone), grads[at], cells).astype(np.int64)
        sums = dict(zip(alone, made, strict=True))
        for n in open_:
            if n not in sums:
                sums[n] = known[(n - 1) // 2] - sums[n + (1 if n % 2 else -1)]
        keyed = {(tree, n, 0): sums[n].reshape(2 * size) for n in open_}
        splits = [dict(zip(names, row, strict=True)) | {"tree": 0} for rows in chosen_splits(keyed, cells, growth, number) for row in rows]
        known = sums
        if not settled(out, splits, closed, growth):
            break
        feature = out.feature[0].astype(np.int64)[place]
        right = bins.ravel().take(np.arange(len(bins)) * bins.shape[1] + np.maximum(feature, 0)) > out.cut[0][place]
        place = np.where(feature >= 0, 2 * place + 1 + right, place)
    for (k, node), value in closed.items():
        out.value[k, node] = value
    return out


def grow_alone(rows: DataFrame, outputs: int, cells: Cells, gradients: Gradients, growth: Growth, number: int) -> Round:
    """The trees of one round in one job: every task reads all rows and grows some of the trees."""
    spark = rows.sparkSession
    tasks = min(outputs, spark.sparkContext.defaultParallelism)

    def grow_some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, group = [], None
        for batch in batches:
            for i in range(batch.num_rows):
                group = batch.column("group")[i].as_py()
                block = Block.read({p: batch.column(p)[i].as_buffer() for p in PARTS}, outputs)
                blocks.append(block.where(drawn(block.seeds, growth, number)))
        if group is None:
            return
        every = Block.joined(blocks)
        first, second = gradients(every.margins, every.labels, every.sizes)
        for k in range(group, outputs, tasks):
            made = grown_alone(every.bins, np.stack([first[:, k], second[:, k]], axis=1).astype(float), k, cells, growth, number)
            arrays = [pa.array([k], pa.int32()), *[pa.array([a.tobytes()], pa.binary()) for a in (made.feature, made.cut, made.value)]]
            yield pa.RecordBatch.from_arrays(arrays, ["tree", "feature", "cut", "value"])

    groups = spark.range(0, tasks, 1, tasks).select(F.col("id").alias("group"))
    grown = groups.crossJoin(rows.coalesce(1).hint("shuffle_replicate_nl")).mapInArrow(grow_some, "tree int, feature binary, cut binary, value binary")
    trees = Round(outputs, growth.depth)
    for row in grown.collect():
        for to, name in ((trees.feature, "feature"), (trees.cut, "cut"), (trees.value, "value")):
            to[row["tree"]] = np.frombuffer(row[name], to.dtype)
    return trees


def advanced(rows: DataFrame, trees: Round, path: str) -> DataFrame:
    """The rows with the round's margins added, written to ``path``."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block.read({p: batch.column(p)[i].as_buffer() for p in PARTS}, trees.outputs)
                yield replace(block, margins=block.margins + trees.margins(block.bins)).stored()

    return stored(rows.mapInArrow(add, BLOCKS), path)


def stored(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def boost(rows: DataFrame, binning: Binning, outputs: int, gradients: Gradients, growth: Growth, items: int = 0) -> BoostedTrees:
    """Fit on packed examples; ``items`` is the catalogue's size if candidates are a predictor."""
    spark = rows.sparkSession
    folders = [new_shared_folder(spark, f"boosting-{i}") for i in range(2)]
    now = stored(rows, folders[0])
    size, cores = now.count(), spark.sparkContext.defaultParallelism
    # few files would leave cores idle in every level, many would idle themselves
    tasks = min(cores, -(-size * outputs // (CHUNK // 2))) if size <= CHUNK * cores else cores * -(-size // (MOST * cores))
    now = stored(blocked(now.repartition(max(tasks, 1), "seed"), outputs), folders[1])
    folders.reverse()
    parts = now.select(F.spark_partition_id()).distinct().count()
    margins = (now.agg(F.sum(F.length("margins"))).first()[0] or 0) // 8
    alone = margins <= ALONE[0] * CHUNK * outputs and margins <= ALONE[1] * CHUNK
    cells, done = cells_of(binning, items), []
    for number in range(growth.rounds):
        if alone:
            trees = grow_alone(now, outputs, cells, gradients, growth, number)
        else:
            trees = grow(now, outputs, cells, gradients, growth, number, parts)
        done.append(trees)
        if number + 1 < growth.rounds:
            now = advanced(now, trees, folders[(number + 1) % 2])
    return BoostedTrees(binning, tuple(done), outputs)


def root_sums(rows: DataFrame, binning: Binning, outputs: int, gradients: Gradients, items: int = 0) -> DataFrame:
    """(tree, feature, bin, gradient, hessian) in millionths over all rows, before any split."""
    places = cells_of(binning, items)
    every = Growth(subsample=1.1)
    sums = gradient_sums(blocked(rows, outputs), Round(outputs, 1), 0, places, gradients, every, 0)

    def cells(group: pd.DataFrame) -> pd.DataFrame:
        first, second = places.spread(total(group["sums"]).reshape(2, -1), places.bins)
        feature, at = np.nonzero((first != 0) | (second != 0))
        return pd.DataFrame({
            "tree": group["tree"].iloc[0], "feature": feature, "bin": at,
            "gradient": first[feature, at], "hessian": second[feature, at],
        })

    parts = rows.select(F.spark_partition_id()).distinct().count()
    return summed(sums, parts).groupBy("tree").applyInPandas(cells, "tree int, feature int, bin int, gradient long, hessian long")


def listed_gradients(lists: DataFrame) -> DataFrame:
    """(entity, period, idx, label, gradient, hessian) of the candidates of each list, from its ``start`` scores."""
    def derive(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                sizes = frame["labels"].map(len).to_numpy()
                labels = np.concatenate(frame["labels"].to_list())
                first, second = ndcg_gradients(np.concatenate(frame["start"].to_list())[:, None], labels, sizes)
                yield pd.DataFrame({
                    "entity": np.repeat(frame["entity"], sizes), "period": np.repeat(frame["period"], sizes),
                    "idx": np.concatenate(frame["items"].to_list()), "label": labels,
                    "gradient": first[:, 0], "hessian": second[:, 0],
                })

    kinds = "entity long, period int, idx int, label int, gradient long, hessian long"
    return lists.select("entity", "period", "items", "labels", "start").mapInPandas(derive, kinds)


# --- scoring -------------------------------------------------------------------------------

def class_scores(model: BoostedTrees, rows: DataFrame, vector: str) -> DataFrame:
    """Rows with ``scores``: the probability of every class."""
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(list(softmax(model.margins(model.binning(np.array(x.to_list(), float))))))

    return scored(rows, vector, score)


def candidate_scores(model: BoostedTrees, rows: DataFrame, vector: str, items: Sequence[int]) -> DataFrame:
    """Rows with ``scores``: the margin of every item as a candidate of the row."""
    def score(x: pd.Series) -> pd.Series:
        bins = model.binning(np.array(x.to_list(), float))
        tried = np.tile(np.array(items, np.uint8), len(bins))
        margins = model.margins(np.column_stack([np.repeat(bins, len(items), axis=0), tried]))
        return pd.Series(list(margins.reshape(len(bins), len(items))))

    return scored(rows, vector, score)


def scored(rows: DataFrame, vector: str, score: Callable[[pd.Series], pd.Series]) -> DataFrame:
    udf = F.pandas_udf(score, "array<double>")
    return rows.withColumn("scores", udf(F.col(vector)))

