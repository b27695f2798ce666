"""Random forests on binned predictors: bootstrapped Gini trees that look at a few predictors a node.

A stored row is one vector of bins with the classes it occurs with and how often, so the classes of
one (entity, period) share a row; predictors whose bins can only meet in a few million ways are
counted by cell.  The number of times a tree sees n equal examples is Poisson(rate * n), which is
what n single draws add up to, so packing changes no tree's distribution.  A draw is a digest of row, class
and tree and a node's predictors are one of tree and node: trees do not depend on partitions or re-run tasks.

Small tables: each task reads the whole table and grows its trees alone, one job for the forest.
Larger ones: one scan per level, in which tasks count (node, predictor, bin, class) for all trees, a
shuffle sums the tasks' counts and picks the splits, and only splits reach the driver.
"""

from __future__ import annotations

import base64
import io
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.operators.boosting import Binning
from panelspark.session import materialize

ROWS = 32_768  # rows of a stored block
STRIP = 8_192  # rows that are counted at once
ALONE = 250_000  # rows of a table that one task holds whole
MOST = 500_000  # rows of a task in a larger table
CELLS = 2**22  # ways for bins to meet, up to which rows are counted by cell
HELD = 2**25  # counts that a task holds at once
DIRECT = 64  # tasks whose counts one sum takes; more are summed in two steps
UNORDERED = 8  # categories up to which every set is tried; more are tried in order of impurity


@dataclass(frozen=True)
class Growth:
    trees: int = 80
    depth: int = 8
    rate: float = 0.7
    seed: int = 42


@dataclass(frozen=True)
class Layout:
    """Bins and kind of every predictor, and the number of classes."""

    widths: np.ndarray
    nominal: np.ndarray
    classes: int

    @property
    def tried(self) -> int:
        """Predictors a node looks at."""
        return math.ceil(math.sqrt(len(self.widths)))


def mix(values: np.ndarray) -> np.ndarray:
    for shift in (33, 29):
        values = (values ^ (values >> np.uint64(shift))) * np.uint64(0xFF51AFD7ED558CCD)
    return values ^ (values >> np.uint64(32))


def salt(*numbers: int) -> np.uint64:
    out = 0
    for n in numbers:
        out = (out * 1_000_003 + n + 1) * 0x9E3779B97F4A7C15 % 2**64
    return np.uint64(out)


def poisson_table(rate: float) -> np.ndarray:
    """Poisson counts by the upper end of a sixteen-bit draw."""
    shares, term, k = [], math.exp(-rate), 0
    while k < 40:
        shares.append(term)
        k += 1
        term *= rate / k
    return np.searchsorted(np.cumsum(shares), (np.arange(2**16) + 0.5) / 2**16, side="right").astype(np.uint8)


# --- stored rows ---------------------------------------------------------------------------

PARTS = ("bins", "sizes", "labels", "counts", "seeds")
BLOCKS = ", ".join(f"{p} binary" for p in PARTS)


@dataclass
class Block:
    """Bins (rows, predictors); ``sizes`` classes of each row with their ``counts``, row after row."""

    bins: np.ndarray
    sizes: np.ndarray
    labels: np.ndarray
    counts: np.ndarray
    seeds: np.ndarray

    def __post_init__(self) -> None:
        self.row = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.single = bool((self.counts == 1).all())
        self.digest = mix(self.seeds.view(np.uint64)[self.row] + self.labels.astype(np.uint64) * salt(7))

    @staticmethod
    def read(row: dict, width: int) -> Block:
        bins, sizes, labels, counts, seeds = (
            np.frombuffer(row[p], t) for p, t in zip(PARTS, (np.uint8, np.int32, np.uint8, np.int64, np.int64), strict=True)
        )
        return Block(bins.reshape(-1, width), sizes.astype(np.int64), labels.astype(np.int64), counts, seeds)

    def drawn(self, growth: Growth, trees: Sequence[int]) -> Iterator[tuple[int, np.ndarray]]:
        """How often each of ``trees`` sees each class of each row."""
        four, table = None, poisson_table(growth.rate)
        for tree in trees:
            if not self.single:
                first = int(self.digest[0]) if len(self.digest) else 0
                yield tree, np.random.default_rng((growth.seed, tree, first)).poisson(growth.rate * self.counts)
                continue
            if four is None or four[0] != tree // 4:
                mixed = mix(self.digest ^ salt(growth.seed, tree // 4))
                four = tree // 4, mixed.view(np.uint16).reshape(-1, 4)
            yield tree, table.take(four[1][:, tree % 4])


def binned(vectors: DataFrame, binning: Binning, vector: str) -> DataFrame:
    """(seed, x, labels): bins of a row's predictors and its classes."""
    def bin_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = binning(batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
                size = made.shape[1]
                whole = np.ascontiguousarray(made).tobytes()
                rows = pa.array([whole[at : at + size] for at in range(0, len(whole), size)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("seed"), rows, batch.column("labels")], ["seed", "x", "labels"])

    chosen = vectors.select(F.xxhash64("entity", "period").alias("seed"), F.col(vector).alias("x"), F.col("labels").cast("array<int>").alias("labels"))
    return chosen.mapInArrow(bin_, "seed long, x binary, labels array<int>")


def by_cell(rows: DataFrame) -> DataFrame:
    """One row for all that have the same bins."""
    counted = rows.select("x", F.explode("labels").alias("label")).groupBy("x", "label").agg(F.count("*").alias("n"))
    cells = counted.groupBy("x").agg(F.array_sort(F.collect_list(F.struct("label", "n"))).alias("found"))
    return cells.select(F.xxhash64("x").alias("seed"), "x", F.col("found.label").alias("labels"), F.col("found.n").alias("counts"))


def blocked(rows: DataFrame) -> DataFrame:
    """(seed, x, labels, counts) as rows of up to ROWS of them."""
    def stored(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches).combine_chunks()
        labels, counts = (table.column(c).combine_chunks() for c in ("labels", "counts"))
        arrays = (
            b"".join(table.column("x").to_pylist()), pc.list_value_length(labels).to_numpy().astype(np.int32).tobytes(),
            labels.flatten().to_numpy().astype(np.uint8).tobytes(), counts.flatten().to_numpy().astype(np.int64).tobytes(),
            table.column("seed").to_numpy().astype(np.int64).tobytes(),
        )
        return pa.RecordBatch.from_arrays([pa.array([a], pa.binary()) for a in arrays], list(PARTS))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, ROWS - size)
                waiting.append(part)
                size, batch = size + part.num_rows, batch.slice(part.num_rows)
                if size == ROWS:
                    yield stored(waiting)
                    waiting, size = [], 0
        if size:
            yield stored(waiting)

    return rows.mapInArrow(pack, BLOCKS)


def blocks_of(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[Block]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Block.read({p: batch.column(p)[i].as_buffer() for p in PARTS}, width)


# --- trees ---------------------------------------------------------------------------------

@dataclass
class Trees:
    """Heaps: children of node i are 2 i + 1 and 2 i + 2; ``right`` says which bins of a node's predictor go right."""

    number: int
    depth: int
    layout: Layout
    feature: np.ndarray = field(init=False)
    right: np.ndarray = field(init=False)
    counts: np.ndarray = field(init=False)
    open_: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        inner, nodes = 2**self.depth - 1, 2 ** (self.depth + 1) - 1
        self.feature = np.full((self.number, inner), -1, np.int16)
        self.right = np.zeros((self.number, inner, int(self.layout.widths.max(initial=1))), np.uint8)
        self.counts = np.zeros((self.number, nodes, self.layout.classes))
        self.open_ = np.zeros((self.number, nodes), bool)
        self.open_[:, 0] = True

    def stepped(self, tree: int, bins: np.ndarray, node: np.ndarray) -> np.ndarray:
        """One step down for rows in a node that is split."""
        feature = self.feature[tree].take(node, mode="clip")
        bin_ = bins.ravel().take(np.arange(len(bins)) * bins.shape[1] + np.maximum(feature, 0))
        below = 2 * node + 1 + self.right[tree].ravel().take(node * self.right.shape[2] + bin_, mode="clip")
        return np.where((feature >= 0) & (node < self.feature.shape[1]), below, node)

    def places(self, tree: int, bins: np.ndarray, levels: int) -> np.ndarray:
        node = np.zeros(len(bins), np.int64)
        for _ in range(levels):
            node = self.stepped(tree, bins, node)
        return node

    def split(self, tree: int, level: int, found: Splits) -> None:
        """Take over what was found for a level's open nodes."""
        nodes = self.nodes(tree, level)
        if level == 0:
            self.counts[tree, 0] = found.left[0] + found.rest[0]
        good = np.flatnonzero(found.feature >= 0)
        inner = nodes[good]
        self.feature[tree, inner], self.right[tree, inner] = found.feature[good], found.right[good]
        self.open_[tree, nodes] = False
        for side, counts in ((1, found.left[good]), (2, found.rest[good])):
            child = 2 * inner + side
            self.counts[tree, child] = counts
            self.open_[tree, child] = (level + 1 < self.depth) & (counts.max(1, initial=0) < counts.sum(1))

    def nodes(self, tree: int, level: int) -> np.ndarray:
        """Open nodes of a level."""
        first = 2**level - 1
        return first + np.flatnonzero(self.open_[tree, first : 2 * first + 1])

    def shares(self) -> np.ndarray:
        """Share of each class in each node."""
        return self.counts / np.maximum(self.counts.sum(2, keepdims=True), 1)


@dataclass
class Plan:
    """Where a tree's counts of a level lie: for open node i its j-th tried predictor begins at ``starts[i, j]``."""

    nodes: np.ndarray
    features: np.ndarray
    widths: np.ndarray
    starts: np.ndarray
    size: int

    def room(self, classes: int) -> int:
        return (self.size + len(self.nodes)) * classes

    @staticmethod
    def of(nodes: np.ndarray, tree: int, layout: Layout, growth: Growth) -> Plan:
        every = np.arange(len(layout.widths), dtype=np.uint64)
        keys = mix(mix(salt(growth.seed, tree, 3) + nodes.astype(np.uint64) * salt(11))[:, None] + every[None, :] * salt(13))
        features = np.sort(np.argsort(keys, axis=1, kind="stable")[:, : layout.tried], axis=1)
        widths = layout.widths[features]
        ends = np.cumsum(widths.ravel())
        return Plan(nodes, features, widths, (ends - widths.ravel()).reshape(widths.shape), int(ends[-1]) if len(ends) else 0)


def count(block: Block, place: np.ndarray, drawn: np.ndarray, plan: Plan, classes: int, sums: np.ndarray) -> None:
    """Add one tree's counts to ``sums``: (cells + open nodes) x classes, first by (node, predictor, bin) but for bin 0, then by node.

    ``place`` is the number of a row's open node, or -1.  Bin 0 is what the others leave of the node.
    A few thousand rows at once keep the arrays in the processor's cache.
    """
    starts, by_node, by_cell_ = block.starts, sums[plan.size * classes :], sums[: plan.size * classes]
    width, tried = block.bins.shape[1], plan.features.shape[1]
    for low in range(0, len(place), STRIP):
        high = min(low + STRIP, len(place))
        first, last = starts[low], starts[high]
        times = drawn[first:last]
        there = place[low:high]
        live = times > 0
        if (there < 0).any():
            live &= (there >= 0).take(block.row[first:last] - low)
        seen = np.flatnonzero(live)
        row, label, times = block.row[first:last].take(seen) - low, block.labels[first:last].take(seen), times.take(seen).astype(float)
        np.add.at(by_node, there.take(row) * classes + label, times)
        size = np.bincount(row, minlength=high - low)
        begin = np.cumsum(size) - size
        rows = np.flatnonzero(size)
        at = there.take(rows)
        bins = block.bins[low:high].ravel().take(rows[:, None] * width + plan.features.take(at, axis=0)).ravel()
        pairs = np.flatnonzero(bins != 0)
        of = pairs // tried
        cell = (plan.starts.take(at, axis=0).ravel().take(pairs) + bins.take(pairs)) * classes
        rows = rows.take(of)
        size = size.take(rows)
        ends = np.cumsum(size)
        pair = np.repeat(np.arange(len(pairs)), size)
        entry = (begin.take(rows) - (ends - size)).take(pair)
        entry += np.arange(len(pair))
        np.add.at(by_cell_, cell.take(pair) + label.take(entry), times.take(entry))


@dataclass
class Splits:
    """Of a level's open nodes: predictor or -1, bins that go right, and the classes on both sides."""

    feature: np.ndarray
    right: np.ndarray
    left: np.ndarray
    rest: np.ndarray


def sets_of(width: int) -> np.ndarray:
    """Every way to cut categories in two, the first one staying left."""
    numbers = np.arange(2 ** (width - 1) - 1)
    return np.column_stack([np.ones(len(numbers)), *[(numbers >> i) & 1 for i in range(width - 1)]])


def purity(counts: np.ndarray) -> np.ndarray:
    """Rows times the chance that two of them agree; the higher, the purer."""
    return np.square(counts).sum(-1) / np.maximum(counts.sum(-1), 1)


def best_splits(sums: np.ndarray, plan: Plan, layout: Layout) -> Splits:
    """The split of every node that lowers Gini impurity most; ties go to the earlier predictor, then the earlier cut."""
    classes, nodes, tried = layout.classes, len(plan.nodes), plan.features.shape[1]
    cells, whole = sums[: plan.size * classes].reshape(-1, classes).astype(float), sums[plan.size * classes :].reshape(-1, classes).astype(float)
    starts, widths, features = plan.starts.ravel(), plan.widths.ravel(), plan.features.ravel()
    cells[starts] = np.repeat(whole, tried, axis=0) - np.add.reduceat(cells, starts, axis=0)
    segment = np.repeat(np.arange(len(starts)), widths)
    position = np.arange(len(cells)) - starts[segment]
    nominal, listed = layout.nominal[features], layout.nominal[features] & (widths <= UNORDERED)
    size = cells.sum(1)
    impurity = np.where(size > 0, 1 - purity(cells) / np.maximum(size, 1), np.inf)
    order = np.lexsort((position, np.where(nominal[segment], impurity, position), segment))
    running = cells[order].cumsum(0)
    left = running - (running[starts] - cells[order][starts])[segment]
    rest = whole[segment // tried] - left
    before = purity(whole)
    gain = purity(left) + purity(rest) - before[segment // tried]
    allowed = (left.sum(1) >= 1) & (rest.sum(1) >= 1) & (position < widths[segment] - 1) & ~listed[segment]
    gain = np.where(allowed, gain, -np.inf)
    best = np.maximum.reduceat(gain, starts)
    chosen_set = np.zeros(len(starts), np.int64)
    for width in np.unique(widths[listed & (widths > 1)]):
        some = np.flatnonzero(listed & (widths == width))
        sets = sets_of(int(width))
        sides = np.matmul(sets, cells[starts[some][:, None] + np.arange(width)[None, :]])
        others = whole[some // tried][:, None, :] - sides
        won = purity(sides) + purity(others) - before[some // tried][:, None]
        won = np.where((sides.sum(2) >= 1) & (others.sum(2) >= 1), won, -np.inf)
        chosen_set[some], best[some] = won.argmax(1), won.max(1)
    best = best.reshape(nodes, tried)
    pick = best.argmax(1) if nodes else np.zeros(0, np.int64)
    out = Splits(np.full(nodes, -1, np.int16), np.zeros((nodes, int(layout.widths.max(initial=1))), np.uint8), np.zeros((nodes, classes)), whole.copy())
    for i in np.flatnonzero(best[np.arange(nodes), pick] > 1e-6):
        s = i * tried + pick[i]
        at, width = starts[s], widths[s]
        if listed[s]:
            goes = sets_of(int(width))[chosen_set[s]] == 0
        else:
            cut = int(gain[at : at + width].argmax())
            goes = np.ones(width, bool)
            goes[position[order[at : at + cut + 1]]] = False
        out.feature[i], out.right[i, :width] = features[s], goes
        out.right[i, width:] = 1
        out.left[i] = cells[at : at + width][~goes].sum(0)
        out.rest[i] = whole[i] - out.left[i]
    return out


# --- growing -------------------------------------------------------------------------------

def grown_alone(blocks: list[Block], tree: int, layout: Layout, growth: Growth) -> Trees:
    """One tree from blocks that lie in memory."""
    out = Trees(1, growth.depth, layout)
    drawn = [next(b.drawn(growth, [tree]))[1] for b in blocks]
    node = [np.zeros(len(b.sizes), np.int64) for b in blocks]
    for level in range(growth.depth):
        nodes = out.nodes(0, level)
        if not len(nodes):
            break
        plan = Plan.of(nodes, tree, layout, growth)
        number = numbers_of(nodes, growth.depth)
        sums = np.zeros(plan.room(layout.classes))
        for b, n, w in zip(blocks, node, drawn, strict=True):
            count(b, number[n], w, plan, layout.classes, sums)
        out.split(0, level, best_splits(sums, plan, layout))
        node = [out.stepped(0, b.bins, n) for b, n in zip(blocks, node, strict=True)]
    return out


def numbers_of(nodes: np.ndarray, depth: int) -> np.ndarray:
    """By node its place among ``nodes``, or -1."""
    number = np.full(2 ** (depth + 1) - 1, -1)
    number[nodes] = np.arange(len(nodes))
    return number


def forest_alone(stored: DataFrame, layout: Layout, growth: Growth) -> Trees:
    """Every task reads the table and grows some of the trees."""
    spark, width = stored.sparkSession, len(layout.widths)
    tasks = min(growth.trees, spark.sparkContext.defaultParallelism)

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, group = [], None
        for batch in batches:
            if batch.num_rows:
                group = batch.column("group")[0].as_py()
                blocks += blocks_of(iter([batch]), width)
        for tree in () if group is None else range(group, growth.trees, tasks):
            made = grown_alone(blocks, tree, layout, growth)
            arrays = [pa.array([tree], pa.int32()), *[pa.array([a.tobytes()], pa.binary()) for a in (made.feature, made.right, made.counts)]]
            yield pa.RecordBatch.from_arrays(arrays, ["tree", "feature", "goes", "counts"])

    groups = spark.range(0, tasks, 1, tasks).select(F.col("id").alias("group"))
    out = Trees(growth.trees, growth.depth, layout)
    for row in groups.crossJoin(stored.coalesce(1).hint("shuffle_replicate_nl")).mapInArrow(grow, "tree int, feature binary, goes binary, counts binary").collect():
        tree = row["tree"]
        for to, name in ((out.feature, "feature"), (out.right, "goes"), (out.counts, "counts")):
            to[tree] = np.frombuffer(row[name], to.dtype).reshape(to[tree].shape)
    return out


SUMS = "tree int, part int, sums binary"


def tree_sums(stored: DataFrame, trees: Trees, some: Sequence[int], level: int, growth: Growth) -> DataFrame:
    """Counts of a level for the trees in ``some``, per task."""
    layout, width = trees.layout, len(trees.layout.widths)
    nodes = {t: trees.nodes(t, level) for t in some}
    above = Trees(0, growth.depth, layout)
    inner = 2**level - 1
    above.feature, above.right = trees.feature[:, :inner].copy(), trees.right[:, :inner].copy()

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        plans = {t: Plan.of(nodes[t], t, layout, growth) for t in some}
        number = {t: numbers_of(nodes[t], growth.depth) for t in some}
        held: dict[int, np.ndarray] = {}
        for block in blocks_of(batches, width):
            for t, drawn in block.drawn(growth, some):
                place = number[t][above.places(t, block.bins, level)]
                if t not in held:
                    held[t] = np.zeros(plans[t].room(layout.classes))
                count(block, place, drawn, plans[t], layout.classes, held[t])
        part = TaskContext.get().partitionId()
        for t, sums in held.items():
            yield summed_batch(t, part, sums)

    return stored.mapInArrow(add_up, SUMS)


def summed_batch(tree: int, part: int, sums: np.ndarray) -> pa.RecordBatch:
    packed = sums.astype(np.int64).tobytes()
    return pa.RecordBatch.from_arrays([pa.array([tree], pa.int32()), pa.array([part], pa.int32()), pa.array([packed], pa.binary())], ["tree", "part", "sums"])


def totals(batches: Iterator[pa.RecordBatch], *keys: str) -> dict[tuple[int, ...], np.ndarray]:
    found: dict[tuple[int, ...], np.ndarray] = {}
    for batch in batches:
        for i in range(batch.num_rows):
            key = tuple(batch.column(k)[i].as_py() for k in keys)
            more = np.frombuffer(batch.column("sums")[i].as_buffer(), np.int64)
            if key in found:
                found[key] += more
            else:
                found[key] = more.copy()
    return found


def split_level(stored: DataFrame, trees: Trees, some: Sequence[int], level: int, growth: Growth, parts: int) -> None:
    """One job: the open nodes of a level of some trees."""
    layout = trees.layout
    nodes = {t: trees.nodes(t, level) for t in some}
    sums = tree_sums(stored, trees, some, level, growth)
    if parts > DIRECT:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for (tree, part), found in totals(batches, "tree", "part").items():
                yield summed_batch(tree, part, found)

        fewer = sums.withColumn("part", (F.col("part") % math.isqrt(parts)).cast("int"))
        sums = fewer.repartition(len(some) * 2, "tree", "part").mapInArrow(add, SUMS)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (tree,), found in totals(batches, "tree").items():
            made = best_splits(found, Plan.of(nodes[tree], tree, layout, growth), layout)
            arrays = [pa.array([tree], pa.int32()), *[pa.array([a.tobytes()], pa.binary()) for a in (made.feature, made.right, made.left, made.rest)]]
            yield pa.RecordBatch.from_arrays(arrays, ["tree", "feature", "goes", "sides", "rest"])

    chosen = sums.repartition(len(some), "tree").mapInArrow(choose, "tree int, feature binary, goes binary, sides binary, rest binary")
    for row in chosen.collect():
        n = len(nodes[row["tree"]])
        feature, right = np.frombuffer(row["feature"], np.int16), np.frombuffer(row["goes"], np.uint8).reshape(n, -1)
        left, rest = (np.frombuffer(row[c], float).reshape(n, -1) for c in ("sides", "rest"))
        trees.split(row["tree"], level, Splits(feature, right, left, rest))


def forest_by_level(stored: DataFrame, layout: Layout, growth: Growth) -> Trees:
    """One scan a level for as many trees as a task can hold counts of."""
    trees, parts = Trees(growth.trees, growth.depth, layout), stored.select(F.spark_partition_id()).distinct().count()
    for level in range(growth.depth):
        some, held = [], 0
        for t in range(growth.trees):
            size = Plan.of(trees.nodes(t, level), t, layout, growth).size * layout.classes
            if some and held + size > HELD:
                split_level(stored, trees, some, level, growth, parts)
                some, held = [], 0
            if size:
                some, held = [*some, t], held + size
        if some:
            split_level(stored, trees, some, level, growth, parts)
    return trees


@dataclass(frozen=True)
class Forest:
    binning: Binning
    trees: Trees

    def shares(self, bins: np.ndarray) -> np.ndarray:
        """Mean share of each class in the leaves of a row."""
        total, shares = np.zeros((len(bins), self.trees.layout.classes)), self.trees.shares()
        for t in range(self.trees.number):
            total += shares[t].take(self.trees.places(t, bins, self.trees.depth), axis=0)
        return total / self.trees.number


def fit_forest(vectors: DataFrame, binning: Binning, nominal: Sequence[bool], classes: int, growth: Growth, vector: str = "x") -> Forest:
    """Fit on rows of (entity, period, ``labels``, vector); a row is an example of each of its labels."""
    widths = np.array([len(c) + 1 for c in binning.cuts])
    if widths.max(initial=1) > 256:
        raise ValueError(f"at most 256 bins or categories, got {widths.max()}")
    layout, cores = Layout(widths, np.array(nominal, bool), classes), vectors.sparkSession.sparkContext.defaultParallelism
    rows = binned(vectors, binning, vector)
    if math.prod(int(w) for w in widths) <= CELLS:
        rows = materialize(by_cell(rows))
        size = rows.count()
        parts = -(-size // (ROWS // 2))  # blocks that do not depend on the number of cores
    else:
        rows = materialize(rows.withColumn("counts", F.transform("labels", lambda _: F.lit(1).cast("long"))))
        size = rows.count()
        parts = cores * -(-size // (MOST * cores))
    if not size:
        raise ValueError("a forest needs at least one row")
    stored = materialize(blocked(rows.repartition(parts, "seed").sortWithinPartitions("seed", "x")))
    trees = (forest_alone if size <= ALONE else forest_by_level)(stored, layout, growth)
    return Forest(binning, trees)


SHARES = "forest_shares"


class ForestScorer(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A pipeline's last stage, saved and loaded with it: SHARES of every class from the vector ``features``."""

    def __init__(self) -> None:
        super().__init__()
        self.packed = Param(self, "packed", "the forest's arrays", TypeConverters.toString)

    @staticmethod
    def of(model: Forest) -> ForestScorer:
        file, trees = io.BytesIO(), model.trees
        np.savez_compressed(
            file, cuts=np.concatenate([np.array(c, float) for c in model.binning.cuts]), sizes=[len(c) for c in model.binning.cuts],
            widths=trees.layout.widths, nominal=trees.layout.nominal, shape=(trees.number, trees.depth, trees.layout.classes),
            feature=trees.feature, right=trees.right, counts=trees.counts,
        )
        made = ForestScorer()
        made._set(packed=base64.b64encode(file.getvalue()).decode())
        return made

    def forest(self) -> Forest:
        read = np.load(io.BytesIO(base64.b64decode(self.getOrDefault(self.packed))))
        number, depth, classes = (int(n) for n in read["shape"])
        cuts = np.split(read["cuts"], np.cumsum(read["sizes"])[:-1])
        trees = Trees(number, depth, Layout(read["widths"], read["nominal"], classes))
        trees.feature, trees.right, trees.counts = read["feature"], read["right"], read["counts"]
        return Forest(Binning(tuple(tuple(c.tolist()) for c in cuts)), trees)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        model = self.forest()

        def score(x: pd.Series) -> pd.Series:
            return pd.Series(list(model.shares(model.binning(np.array(x.to_list(), float)))))

        return dataset.withColumn(SHARES, F.pandas_udf(score, "array<double>")(vector_to_array("features")))
