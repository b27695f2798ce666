"""Approximate nearest neighbours in balanced posting lists.

Centroids are fitted on a bounded sample. Every vector is posted to its nearest centroid, and
as a boundary vector also to others that are nearly as near. The ratio that decides so, and the one
within which a query reads lists, are calibrated on the sample: the pair that compares fewest rows
and still finds RECALL of the nearest there. Vectors without clusters leave little to prune,
and the calibrated ratio is wide then. Lists above LIST_ROWS split
into sublists by a hash, so that a hot cluster spreads over tasks. A query finds its nearest
centroids by best-first search in an in-memory neighbour graph and reads the lists whose
distance is within a ratio of the nearest one, and further ones in order of distance until they
are sure to hold k other vectors; distances in the lists are exact. A query that still has fewer
than k is compared with every vector.

Defined results: vectors that are null, zero, or hold null or non-finite components take no
part, nor do those of another length than the most frequent one; rows without id take no part;
of repeated rows of an id the smallest vector counts; ties go to the smaller id; with fewer candidates than asked
all are returned.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import hash_sample, saved

SAMPLE_ROWS = 20_000  # vectors that centroids are fitted and ratios calibrated on at most
LISTS = 5_000  # at most, bounds the graph that every task holds; up to there lists grow as the root of the rows
LIST_ROWS = 4_000  # rows of a sublist
REPLICAS = 4  # lists that a vector is posted to at most
BOUNDARIES = (1.0, 1.02, 1.05, 1.1)  # ratios tried for posting a boundary vector to further lists
RECALL = 0.98  # of a query's nearest in the sample, wanted of the lists within the calibrated ratio
TRIED = 300  # sample vectors that the ratios are calibrated with
DEGREE = 16  # of the graph
SLACK = 1.1  # the graph is walked so far beyond the ratio
SHORT = 2_000  # queries about so many are compared with all vectors at once


@dataclass(frozen=True)
class Centroids:
    points: np.ndarray
    links: np.ndarray

    def distances(self, x: np.ndarray) -> np.ndarray:
        square = (x**2).sum(1)[:, None] - 2 * x @ self.points.T + (self.points**2).sum(1)[None, :]
        return np.sqrt(np.maximum(square, 0))

    def search(self, q: np.ndarray, ratio: float, least: int = 64) -> list[tuple[float, int]]:
        """Best-first walk over the graph: the centroids met within ``ratio`` of the nearest, or ``least`` of them, sorted.

        The walk goes on as long as the next node lies within the ratio and some slack, so no number of
        lists ends it, and lists behind a slightly farther one are met too.
        """
        start = float(np.linalg.norm(self.points[0] - q))
        met, open_ = {0: start}, [(start, 0)]
        best, kept = start, [-start]  # the ``least`` smallest distances, as a heap
        while open_:
            near, at = heapq.heappop(open_)
            if near > SLACK * ratio * best and len(kept) == least and near > -kept[0]:
                break
            fresh = [i for i in dict.fromkeys(self.links[at].tolist()) if i not in met]
            for d, i in zip(np.linalg.norm(self.points[fresh] - q, axis=1).tolist(), fresh, strict=True):
                met[i] = d
                heapq.heappush(open_, (d, i))
                heapq.heappush(kept, -d)
                if len(kept) > least:
                    heapq.heappop(kept)
                best = min(best, d)
        return sorted((d, i) for i, d in met.items() if d <= max(ratio * best, -kept[0]))


def fit_centroids(sample: np.ndarray, lists: int, rounds: int = 8) -> Centroids:
    """Lloyd's rounds in which a crowded centroid counts as farther away, for balanced lists."""
    draw = np.random.default_rng(3)
    points = sample[draw.choice(len(sample), min(lists, len(sample)), replace=False)].copy()
    load = np.zeros(len(points))
    for _ in range(rounds):
        far = Centroids(points, np.zeros((0, 0))).distances(sample)
        own = (far * (1 + 0.05 * load)).argmin(1)
        count = np.bincount(own, minlength=len(points))
        load = np.minimum(count / max(count.mean(), 1), 4)
        total = np.zeros_like(points)
        np.add.at(total, own, sample)
        points = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], points)
    far = Centroids(points, np.zeros((0, 0))).distances(points)
    near = np.argsort(far, axis=1, kind="stable")[:, 1 : DEGREE + 1]
    ring = np.roll(np.arange(len(points)), -1)[:, None]  # keeps the graph connected
    return Centroids(points, np.hstack([near, ring]))


def posted(far: np.ndarray, boundary: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) pairs: every row's nearest list, and further ones within the boundary ratio."""
    order = np.argsort(far, axis=1, kind="stable")[:, :REPLICAS]
    close = np.take_along_axis(far, order, 1)
    at, place = np.nonzero(close <= boundary * close[:, :1])
    return at, order[at, place]


def calibrated(centroids: Centroids, sample: np.ndarray, k: int) -> tuple[float, float]:
    """(boundary, probe) ratios: the pair that compares fewest rows among those that reach RECALL on the sample.

    A query's nearest in the sample lie farther away than in the table, so the table's are
    found in fewer lists.
    """
    far = centroids.distances(sample)
    tried = np.linspace(0, len(sample) - 1, min(TRIED, len(sample))).astype(int)
    asked = far[tried] / np.maximum(far[tried].min(1, keepdims=True), 1e-300)
    near = np.empty((len(tried), min(k, len(sample) - 1)), int)
    for row, at in enumerate(tried):
        gap = ((sample - sample[at]) ** 2).sum(1)
        gap[at] = np.inf
        near[row] = np.argpartition(gap, max(near.shape[1] - 1, 0))[: near.shape[1]]
    best = None
    for boundary in BOUNDARIES:
        at, lists = posted(far, boundary)
        holds = [lists[slice(*ends)] for ends in zip(np.searchsorted(at, np.arange(len(sample))), np.searchsorted(at, np.arange(len(sample)), "right"), strict=True)]
        needed = np.array([asked[row, holds[i]].min() for row in range(len(tried)) for i in near[row]])
        probe = float(np.quantile(needed, RECALL, method="higher")) if len(needed) else 1.0
        rows = np.bincount(lists, minlength=far.shape[1])
        cost = ((asked <= probe) * rows).sum()
        if best is None or cost < best[0]:
            best = cost, boundary, probe
    return best[1], best[2]


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part, as doubles."""
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null")
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where(good & F.exists("embedding", lambda x: x != 0))
    sizes = v.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1)
    dim = [r["dim"] for r in sizes.collect()]
    same = v.where(F.size("embedding") == (dim[0] if dim else 0))
    return same.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def nearest(group: pd.DataFrame, asked: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest rows of one sublist for each query that reads it; exact differences, in blocks."""
    out = []
    if len(group) and len(asked):
        ids, rows = group["vec_id"].to_numpy(), np.stack(group["embedding"].to_list())
        for query, q in zip(asked["query_id"], asked["q"], strict=True):
            far = np.sqrt(((rows - np.asarray(q)) ** 2).sum(1))
            far[ids == query] = np.inf
            pick = np.flatnonzero(far <= np.partition(far, min(k, len(far)) - 1)[min(k, len(far)) - 1])
            pick = pick[np.lexsort((ids[pick], far[pick]))][:k]
            out += [(query, ids[i], far[i]) for i in pick if far[i] < np.inf]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": int, "vec_id": int, "score": float})


def enough(order: list[int], sizes: dict[int, int], wanted: int) -> int:
    """How many lists of ``order`` hold ``wanted`` postings of different vectors for certain.

    A vector is posted once to a list and to at most REPLICAS of them.
    """
    total = largest = 0
    for at, i in enumerate(order):
        total, largest = total + sizes.get(i, 0), max(largest, sizes.get(i, 0))
        if max(largest, total // REPLICAS) >= wanted:
            return at + 1
    return len(order)


def compared(batches: Iterator[pd.DataFrame], asked: pd.DataFrame, k: int) -> Iterator[pd.DataFrame]:
    """The k nearest rows of each block for every query of ``asked``."""
    for frame in batches:
        yield nearest(frame, asked, k)


def topped_up(found: DataFrame, asked: DataFrame, rows: DataFrame, n: int, k: int) -> DataFrame:
    """``found`` with the k nearest of all rows for queries that have fewer than can be given."""
    met = found.groupBy("query_id").agg(F.count("*").alias("met"))
    short = asked.join(met, "query_id", "left").where(F.coalesce("met", F.lit(0)) < min(k, n - 1)).select("query_id", "q")
    short = saved(short, "short-queries")
    parts = -(-short.count() // SHORT)  # each is compared in a pass of its own
    for part in range(parts):
        block = short.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part).toPandas()
        more = rows.mapInPandas(lambda b, a=block: compared(b, a, k), "query_id long, vec_id long, score double")
        found = found.unionByName(more)
    return found.distinct()


@dataclass(frozen=True)
class Index:
    """Posting lists of all vectors, and what a query needs to choose among them."""

    rows: DataFrame
    n: int
    centroids: Centroids
    probe: float
    posts: DataFrame
    held: dict[int, int]  # postings of each list; at most LISTS

    def choose(self, frames: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
        """(query_id, q, lists) of the queries in (vec_id, embedding) frames."""
        for frame in frames:
            lists = []
            for q in frame["embedding"]:
                found = self.centroids.search(np.asarray(q), self.probe)
                near = sum(d <= self.probe * found[0][0] for d, _ in found)
                order = [i for _, i in found]
                lists.append(order[: max(near, enough(order, self.held, k + 1))])  # the query's own row is one
            yield pd.DataFrame({"query_id": frame["vec_id"], "q": frame["embedding"], "lists": lists})

    def asked(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, q, lists) for rows of queries."""
        chooser = Index(None, self.n, self.centroids, self.probe, None, self.held)
        return queries.mapInPandas(lambda frames: chooser.choose(frames, k), "query_id long, q array<double>, lists array<int>")


def build(vectors: DataFrame, k: int = 10) -> Index | None:
    """Fit on a bounded sample, post every vector; None without usable vectors."""
    rows = saved(usable(vectors), "vectors")
    n = rows.count()
    picked = rows.join(F.broadcast(hash_sample(rows, "vec_id", SAMPLE_ROWS)), "vec_id")  # bounded
    sample = sorted(((r["vec_id"], r["embedding"]) for r in picked.collect()), key=lambda r: r[0])
    if not sample:
        return None
    points = np.array([e for _, e in sample])
    centroids = fit_centroids(points, max(1, min(LISTS, math.isqrt(n), len(points) // 4)))
    boundary, probe = calibrated(centroids, points, k)

    def post(batches):
        for frame in batches:
            if len(frame):
                at, lists = posted(centroids.distances(np.stack(frame["embedding"].to_list())), boundary)
                yield pd.DataFrame({
                    "list": lists, "vec_id": frame["vec_id"].to_numpy()[at], "embedding": frame["embedding"].to_numpy()[at],
                })

    posts = saved(rows.mapInPandas(post, "list int, vec_id long, embedding array<double>"), "postings")
    held = {r["list"]: r["n"] for r in posts.groupBy("list").agg(F.count("*").alias("n")).collect()}
    return Index(rows, n, centroids, probe, posts, held)


def neighbours(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """(query_id, rank, vec_id, score) for the queries, the rows whose id ``every`` divides."""
    spark, index = vectors.sparkSession, build(vectors, k)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    cuts = spark.createDataFrame([(i, -(-m // LIST_ROWS)) for i, m in index.held.items()], "list int, cuts int")
    sizes = F.broadcast(cuts)  # at most LISTS rows
    split = index.posts.join(sizes, "list").withColumn("sub", F.pmod(F.xxhash64("vec_id"), "cuts").cast("int")).drop("cuts")
    queries = index.rows.where(F.col("vec_id") % every == 0)
    asked = index.asked(queries, k).select("query_id", "q", F.explode("lists").alias("list")).join(sizes, "list")
    asked = asked.select("list", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("sub"), "query_id", "q")
    found = (
        split.groupBy("list", "sub").cogroup(asked.groupBy("list", "sub"))
        .applyInPandas(lambda g, a: nearest(g, a, k), "query_id long, vec_id long, score double")
        .distinct()
    )
    found = topped_up(
        saved(found, "found"), queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), index.rows, index.n, k
    )
    best = F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, k)  # k of each sublist read
    ranked = found.groupBy("query_id").agg(best.alias("best")).select("query_id", F.posexplode("best").alias("at", "b"))
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))
