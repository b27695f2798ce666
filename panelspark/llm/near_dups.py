"""Near-duplicate groups by min-max hashing.

Every permutation of the shingle space gives two signature values, its minimum and its
maximum, so 2P values cost P hash evaluations. Bands of the signature propose pairs; each
link is confirmed on the full shingle sets. Documents with equal sets form a class first, and
only class representatives are compared:

1. every bucket proposes a star around its smallest member, no matter how large it is;
2. confirmed links give components; buckets that still span several components propose the
   pairs across components, so no link between different texts depends on the star's centre.

A link at the threshold 0.85 misses all 40 bands of 5 values with probability 7e-11.

Defined results: null and empty texts, and texts without words, have no shingles and link with
nothing; fewer words than a shingle are one shingle; repeated rows fall into one class; an id with
several texts is several nodes, told apart by their sets, each in its own component; the
component of a row without id is that of its class; texts are read whole; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm.common import Bounded, lowered, saved, with_columns, worker_cache

PERMUTATIONS = 100
ROWS = 5  # signature values in a band; 2 * PERMUTATIONS / ROWS bands
HASHES = 100_000  # words whose hash a worker keeps, some 13 MB
CHUNK = 4096  # shingles hashed at once, bounds memory for very long texts
IDS_BROADCAST = 100_000  # ids that are broadcast at most, some 6 MB
MIX = np.uint64(0x9E3779B97F4A7C15)  # fixed odd multiplier


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | None, k: int, hashes: dict) -> np.ndarray:
    """Distinct 64-bit hashes of the k-word shingles, sorted."""
    words = lowered(text).split()
    if not words:
        return np.zeros(0, np.uint64)
    of = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(k, len(of))
    out = of[: len(of) - k + 1].copy()
    for j in range(1, k):
        out = mixed(out) + of[j : len(of) - k + 1 + j]
    return np.unique(mixed(out))


def word_hashes() -> dict:
    return worker_cache("word-hashes", lambda: Bounded(xxhash.xxh64_intdigest, HASHES))


def permutations() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20)
    return tuple(draw.integers(1, 2**63, (PERMUTATIONS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in "ab")


def signature(shingles: np.ndarray, flip: np.ndarray, times: np.ndarray) -> np.ndarray:
    """All minima, then all maxima."""
    low, high = np.full(PERMUTATIONS, 2**64 - 1, np.uint64), np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(shingles), CHUNK):
        image = (shingles[at : at + CHUNK] ^ flip) * times
        np.minimum(low, image.min(1), out=low)
        np.maximum(high, image.max(1), out=high)
    return np.concatenate([low, high])


def bands_of(shingles: np.ndarray, flip: np.ndarray, times: np.ndarray) -> np.ndarray:
    values = signature(shingles, flip, times).reshape(-1, ROWS)
    key = np.arange(len(values), dtype=np.uint64) * MIX
    for j in range(ROWS):
        key = mixed(key) + values[:, j]
    return mixed(key).view(np.int64)


def with_signatures(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, text_key, n_shingles, set_key, bands) per row."""
    def per_batch(batch: pa.RecordBatch):
        hashes, (flip, times) = word_hashes(), permutations()
        sets = [shingle_set(t, k, hashes) for t in batch.column("text").to_pylist()]
        return (
            [len(s) for s in sets],
            [xxhash.xxh128_digest(s.tobytes()) if len(s) else None for s in sets],
            [bands_of(s, flip, times) if len(s) else None for s in sets],
        )

    kinds = {"n_shingles": T.LongType(), "set_key": T.BinaryType(), "bands": T.ArrayType(T.LongType())}
    return with_columns(docs.select("doc_id", text_key(), "text"), kinds, per_batch).drop("text")


def text_key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key")


def with_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(node, n, shingles) of the wanted nodes, each read from a row of its id whose set is the node's."""
    def per_batch(batch: pa.RecordBatch):
        hashes = word_hashes()
        sets = [shingle_set(t, k, hashes) for t in batch.column("text").to_pylist()]
        return [xxhash.xxh128_digest(s.tobytes()) if len(s) else None for s in sets], [s.view(np.int64) for s in sets]

    ids = wanted.select("id").distinct()
    involved = docs.select("doc_id", "text").join(bounded_side(ids, wanted), F.col("doc_id") == F.col("id"), "left_semi")
    made = with_columns(involved, {"set_key": T.BinaryType(), "shingles": T.ArrayType(T.LongType())}, per_batch)
    side = bounded_side(wanted.select("node", "id", "set_key"), wanted)
    met = made.join(side, (F.col("doc_id") == F.col("id")) & (made["set_key"] == wanted["set_key"]))
    return met.select("node", F.size("shingles").alias("n"), "shingles").dropDuplicates(["node"])


def bounded_side(side: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """Broadcast a small list, else leave the join to Spark; ``counted`` is a saved table of as many rows or more."""
    return F.broadcast(side) if (side if counted is None else counted).count() <= IDS_BROADCAST else side


def confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Of the pairs (a, b), those with 100 * intersection >= percent * union on full sets.

    A centre with many partners is copied to several parts of them, so no task joins a whole star.
    """
    pairs = saved(pairs.distinct(), "pairs")
    ends = saved(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "pair-nodes")
    wanted = saved(nodes.join(bounded_side(ends), "node", "left_semi"), "pair-sets-wanted")
    sets = saved(with_sets(docs, wanted, k), "pair-sets")
    cuts = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).cast("int").alias("cuts")).where("cuts > 1")
    cuts = saved(cuts, "large-stars")
    dealt = pairs.join(bounded_side(cuts), "a", "left").select(
        "a", "b", F.pmod(F.xxhash64("b"), F.coalesce("cuts", F.lit(1))).cast("int").alias("part")
    )
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("left")).join(bounded_side(cuts), "a", "left")
    left = left.select("a", "left", F.explode(F.sequence(F.lit(0), F.coalesce("cuts", F.lit(1)) - 1)).alias("part"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("right"))
    both = F.size(F.array_intersect("left", "right"))
    met = dealt.join(left, ["a", "part"]).join(right, "b")
    met = met.select("a", "b", both.alias("both"), (F.size("left") + F.size("right")).alias("sizes"))
    return met.where(100 * F.col("both") >= percent * (F.col("sizes") - F.col("both"))).select("a", "b")


def local_stars(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The components of one task's edges as stars around their smallest nodes."""
    frames = [f for f in frames if len(f)]
    if not frames:
        return
    edges = pd.concat(frames)
    names, at = np.unique(np.concatenate([edges["a"], edges["b"]]), return_inverse=True)
    a, b = at[: len(edges)], at[len(edges) :]
    label = np.arange(len(names))
    while True:  # the least label spreads along edges, and labels are followed to their ends
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new != (after := new[new])).any():
            new = after
        new = new[label]
        if (new == label).all():
            break
        label = new
    away = label != np.arange(len(names))
    yield pd.DataFrame({"a": names[away], "b": names[label[away]]})


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable.

    Tasks first shrink the components of at most about EDGES edges each to stars; if there is more
    than one task, alternating stars go on: each step links a node's neighbours to their
    smallest, which halves the depth, and the edges end as a star forest.
    """
    state, now = None, saved(edges.where("a != b").select("a", "b"), "edges")
    tasks = max(1, -(-now.count() // EDGES))
    now = saved(now.coalesce(tasks).mapInPandas(local_stars, "a long, b long"), "local-stars")
    while tasks > 1:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        # the least neighbour of a node hangs itself under the least of all
        large = saved(large.unionByName(now.join(low, "a").select("a", F.col("low").alias("b"))).where("a > b").distinct(), "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        now = saved(small.unionByName(least.select("a", F.col("low").alias("b"))).where("a > b").distinct(), "small-star")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def placed_rows(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, text_key, n_shingles, set_key, component_id, lead) per row of docs.

    ``lead`` marks the rows of the class that the component is named by.
    """
    signed = saved(with_signatures(docs, k), "signatures")
    classes = signed.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("id"))
    nodes = saved(numbered(classes.where("id is not null"), ["id", "set_key"], "node"), "nodes")
    side = bounded_side(nodes)
    own = (signed["doc_id"] == nodes["id"]) & (signed["set_key"] == nodes["set_key"])
    member = signed.join(side, own).select("node", F.col("n_shingles").alias("n"), "bands").dropDuplicates(["node"])
    member = saved(member.select("node", "n", F.explode("bands").alias("band")).distinct(), "members")
    buckets = member.groupBy("band").agg(F.min("node").alias("a"), F.count("*").alias("size")).where("size > 1")
    shared = saved(member.join(buckets.drop("size"), "band").select("band", "node", "n", "a"), "shared-buckets")
    pairs = shared.where("node != a").select("a", F.col("node").alias("b"))
    links = saved(confirmed(pairs, nodes, docs, k, percent), "links")
    root = components(links)
    more = saved(across(shared, root, nodes, docs, k, percent), "cross-links")
    if not more.isEmpty():
        root = components(links.unionByName(more))
    root = saved(nodes.join(root, "node", "left").select("set_key", "id", F.coalesce("root", "node").alias("root"), "node"), "roots")
    leads = root.where("node = root").select("root", F.col("id").alias("component_id"), F.col("set_key").alias("lead_key"))
    of = saved(root.join(leads, "root").select("set_key", "component_id", (F.col("set_key") == F.col("lead_key")).alias("lead_class")), "classes")
    met = signed.drop("bands").join(of, "set_key", "left")
    return met.select(
        "doc_id", "text_key", "n_shingles", "set_key", F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce(F.col("lead_class") & (F.col("doc_id") == F.col("component_id")), F.lit(False)).alias("lead"),
    )


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of docs."""
    return placed_rows(docs, k, percent).select(
        "doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept")
    )


def across(shared: DataFrame, root: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between different components of one bucket.

    All buckets of one star are a group. Its members outside the centre's component are
    compared with everyone of another component, block by block: a task holds two blocks, and
    gives at most one link per pair of components, never the pairs themselves.
    """
    placed = shared.join(bounded_side(root), "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_ = placed.groupBy("band").agg((F.min("root") != F.max("root")).alias("open")).where("open").select("band")
    placed = saved(placed.join(open_, "band", "left_semi").select("a", "node", "n", "root").distinct(), "open-stars")
    core = saved(placed.where("node = a").select("a", F.col("root").alias("core")), "cores")
    placed = placed.join(bounded_side(core), "a").withColumn("out", F.col("root") != F.col("core"))
    weight = F.col("n").cast("long")
    each = placed.groupBy("a").agg(
        F.ceil(F.sum(weight) / BLOCK).cast("int").alias("blocks"),
        F.ceil(F.sum(F.when(F.col("out"), weight)) / BLOCK).cast("int").alias("turns"),
    ).where("turns is not null")
    each = saved(each, "open-sizes")
    dealt = placed.join(bounded_side(each), "a")
    whole = dealt.select(
        "a", "node", "root", F.lit(0).alias("side"), F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("i"),
        F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("j"),
    )
    apart = dealt.where("out").select(
        "a", "node", "root", F.lit(1).alias("side"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"),
        F.pmod(F.xxhash64("node"), "turns").cast("int").alias("j"),
    )
    ends = saved(placed.select("node").distinct(), "open-nodes")
    wanted = saved(nodes.join(bounded_side(ends), "node", "left_semi"), "open-sets-wanted")
    sets = saved(with_sets(docs, wanted, k), "open-sets")
    rows = whole.unionByName(apart).join(sets, "node")
    return rows.groupBy("a", "i", "j").applyInPandas(lambda g: block_links(g, percent), "a long, b long").distinct()


STAR = 500  # partners of a centre in one part of a join
EDGES = 500_000  # edges whose components a task shrinks at once
BLOCK = 100_000  # shingles of a block, so that a task holds a few MB whatever the lengths
COLUMNS = 2048  # shingles counted at once


def block_links(group: pd.DataFrame, percent: int) -> pd.DataFrame:
    """One confirmed link for each pair of components between the two sides of a group."""
    left, right = (group[group["side"] == side].sort_values("node") for side in (0, 1))
    none = pd.DataFrame({"a": np.zeros(0, int), "b": np.zeros(0, int)})
    if left.empty or right.empty:
        return none
    owner, value = [], []
    for part in (left, right):
        owner.append(np.repeat(np.arange(len(part)), part["n"]))
        value.append(np.concatenate(part["shingles"].to_list()))
    common = np.intersect1d(*value)
    seen = [np.isin(v, common) for v in value]
    places = [np.searchsorted(common, v[s]) for v, s in zip(value, seen, strict=True)]
    owner = [o[s] for o, s in zip(owner, seen, strict=True)]
    both = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, len(common), COLUMNS):
        held = []
        for part, o, p in zip((left, right), owner, places, strict=True):
            here = (p >= at) & (p < at + COLUMNS)
            bits = np.zeros((len(part), COLUMNS), np.float32)
            bits[o[here], p[here] - at] = 1
            held.append(bits)
        both += held[0] @ held[1].T
    sizes = left["n"].to_numpy()[:, None] + right["n"].to_numpy()[None, :]
    apart = left["root"].to_numpy()[:, None] != right["root"].to_numpy()[None, :]
    x, y = np.nonzero(apart & (100 * both >= percent * (sizes - both)))
    if not len(x):
        return none
    found = pd.DataFrame({
        "a": left["node"].to_numpy()[x], "b": right["node"].to_numpy()[y],
        "r": left["root"].to_numpy()[x], "s": right["root"].to_numpy()[y],
    })
    return found.drop_duplicates(["r", "s"])[["a", "b"]]


def without_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One text of each group stays, that of the smallest doc_id; rows without id or words stay.

    Rows are told apart by id and text, so an id with several texts loses only the copies among them.
    """
    found = saved(placed_rows(docs, k, percent), "placed-rows").where("n_shingles > 0 and doc_id is not null")
    # of several rows with the leading id and set, the least text stays, once
    twins = found.where("lead").groupBy("doc_id", "set_key").agg(F.count("*").alias("rows"), F.min("text_key").alias("least"))
    twins = saved(twins.where("rows > 1"), "twins")
    named = (F.col("doc_id") == F.col("__id")) & (F.col("__text") == F.col("__text_key"))

    def keys(rows: DataFrame, text: str = "text_key") -> DataFrame:
        return saved(rows.select(F.col("doc_id").alias("__id"), F.col(text).alias("__text_key")).distinct(), "keys")

    marked = docs.withColumn("__text", text_key())
    gone = keys(found.where("not lead"))
    stay = marked.join(bounded_side(gone), named, "left_anti")
    if not twins.isEmpty():
        double = found.where("lead").join(bounded_side(twins), ["doc_id", "set_key"])
        one, every = keys(twins, "least"), keys(double)
        once = stay.join(bounded_side(one), named, "left_semi").dropDuplicates(["doc_id", "__text"])
        stay = stay.join(bounded_side(every), named, "left_anti").unionByName(once)
    return stay.drop("__text")


def numbered(rows: DataFrame, order: list[str], number: str) -> DataFrame:
    """Numbers from 1 in the order of the columns: offsets by range partition, none in one task."""
    sorted_ = saved(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()), "sorted")
    sizes = {r["__part"]: r["n"] for r in sorted_.groupBy("__part").agg(F.count("*").alias("n")).collect()}  # one a partition
    starts, at = [], 0
    for part in sorted(sizes):
        starts.append((part, at))
        at += sizes[part]
    first = rows.sparkSession.createDataFrame(starts, "__part int, __start long")
    placed = sorted_.withColumn("__at", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    return placed.join(F.broadcast(first), "__part").select(*rows.columns, (F.col("__start") + F.col("__at")).alias(number))
