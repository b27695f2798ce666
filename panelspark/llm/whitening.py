"""Whitening of embeddings by the exact characteristic polynomial of their scatter.

Entries become whole numbers x = floor(1024 c) + 100000. Sums and products of all vectors are
added up exactly: per task in blocks whose products stay below 2^53, then by Spark as decimals.
That gives the integer scatter M = n sum(x x') - S S' = n^2 V of the covariance V. Its characteristic
polynomial is found modulo many primes, each prime a row that a Spark task brings to Hessenberg
form, and put together by Chinese remainders; as M is positive semidefinite, its k-th coefficient
is at most C(d, k) (trace / d)^k, which says how many primes are enough. All roots of the polynomial
are real, so the sign changes after a Taylor shift by a are exactly the number of roots above a
(Descartes), and bisection on whole numbers isolates the largest roots, however close they lie.
Components come from inverse iteration in the null space of M - e I, with numbers of
several hundred bits. Driver and tasks hold d x d numbers and no rows.

Defined results: vectors that are null, empty or hold null or non-finite entries are dropped, as are
vectors of another length than the most frequent one (the shorter of equally frequent) and
vectors with entries beyond +-2^40, whose squares could not be summed exactly; zero vectors stay.
Repeated rows count each; null ids stay. Components of eigenvalue 0 are left out, so there are
fewer than asked if the rank is smaller, and no rows if all vectors are equal or none is left.
Components of an eigenvalue met several times are any orthonormal basis of its space. Other
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import saved

UNIT, SHIFT = 1024, 100_000  # of the contract: x = floor(1024 c) + 100000
LARGEST = float(2**40)
LIMB = 2**15  # products are taken of digits to this base, exact in double precision
BLOCK_ROWS = 4096  # of one product: 2^15 * 2^15 * 4096 < 2^53
BITS = 128  # of the roots after the point, relative to the largest
PRIME_BITS = 31


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, y) of the vectors that count; y = x - SHIFT."""
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("c"))
    good = F.forall("c", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= LARGEST))
    v = v.where(good & (F.size("c") > 0)).select("vec_id", F.transform("c", lambda c: F.floor(c * UNIT).cast("long")).alias("y"))
    v = saved(v, "whole-vectors")
    sizes = v.groupBy(F.size("y").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return v.where(F.size("y") == (sizes[0]["d"] if sizes else 0))


def digits(y: np.ndarray) -> list[np.ndarray]:
    """y as digits to the base LIMB, the lowest first, with the sign of y, as doubles."""
    size, out = np.abs(y), []
    while not out or size.any():
        out.append(np.sign(y) * (size % LIMB).astype(float))
        size = size // LIMB
    return out


def partial_sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row (i, n, s, products with j >= i) per dimension and task, exact, as decimal text."""
    n, sums, cross = 0, None, None
    for frame in frames:
        for at in range(0, len(frame), BLOCK_ROWS):
            y = np.stack(frame["y"].iloc[at : at + BLOCK_ROWS].to_list())
            if sums is None:
                sums, cross = np.zeros(y.shape[1], object), np.zeros((y.shape[1],) * 2, object)
            parts = digits(y)
            for a, left in enumerate(parts):
                sums += left.sum(0).astype(np.int64).astype(object) * LIMB**a
                for b, right in enumerate(parts):
                    cross += (left.T @ right).astype(np.int64).astype(object) * LIMB ** (a + b)
            n += len(y)
    if n:
        d = len(sums)
        yield pd.DataFrame({
            "i": np.repeat(np.arange(d), [d - i for i in range(d)]), "j": np.concatenate([np.arange(i, d) for i in range(d)]),
            "n": n, "s": [str(sums[i]) for i in range(d) for _ in range(i, d)], "p": [str(cross[i, j]) for i in range(d) for j in range(i, d)],
        })


def scatter(rows: DataFrame) -> tuple[int, list[int], list[list[int]]]:
    """(n, sums of y, n sum(y y') - s s'): a shift of x changes no covariance."""
    parts = rows.select("y").mapInPandas(partial_sums, "i int, j int, n long, s string, p string")
    whole = "decimal(38,0)"
    total = parts.groupBy("i", "j").agg(
        F.sum("n").alias("n"), F.sum(F.col("s").cast(whole)).cast("string").alias("s"), F.sum(F.col("p").cast(whole)).cast("string").alias("p")
    ).collect()  # d (d + 1) / 2 rows
    if not total:
        return 0, [], []
    d, n = max(r["i"] for r in total) + 1, total[0]["n"]
    sums = [0] * d
    for r in total:
        sums[r["i"]] = int(r["s"])
    m = [[0] * d for _ in range(d)]
    for r in total:
        i, j = r["i"], r["j"]
        m[i][j] = m[j][i] = n * int(r["p"]) - sums[i] * sums[j]
    return n, sums, m


def primes(count: int) -> list[int]:
    """The ``count`` largest primes below 2^PRIME_BITS, by a sieve on one block after the other."""
    root = math.isqrt(2**PRIME_BITS) + 1
    small = np.ones(root + 1, bool)
    small[:2] = False
    for p in range(2, math.isqrt(root) + 1):
        if small[p]:
            small[p * p :: p] = False
    small, found, high = np.flatnonzero(small), [], 2**PRIME_BITS
    while len(found) < count:
        low = high - 2**16
        block = np.ones(high - low, bool)
        for p in small.tolist():
            block[-low % p :: p] = False
        found += (np.flatnonzero(block)[::-1] + low).tolist()
        high = low
    return found[:count]


def hessenberg(a: np.ndarray, p: int) -> np.ndarray:
    """A similar matrix mod p with zeros below the first subdiagonal."""
    d = len(a)
    for k in range(1, d - 1):
        live = np.flatnonzero(a[k:, k - 1])
        if not len(live):
            continue
        pivot = k + int(live[0])
        if pivot != k:
            a[[k, pivot]] = a[[pivot, k]]
            a[:, [k, pivot]] = a[:, [pivot, k]]
        times = a[k + 1 :, k - 1] * pow(int(a[k, k - 1]), -1, p) % p
        a[k + 1 :] = (a[k + 1 :] - times[:, None] * a[k]) % p
        for i in np.flatnonzero(times):  # the inverse from the right: products stay below 2^62
            a[:, k] = (a[:, k] + times[i] * a[:, k + 1 + i]) % p
    return a


def polynomial_mod(m: list[list[int]], p: int) -> np.ndarray:
    """Coefficients of det(x I - m) mod p, the constant first."""
    h = hessenberg(np.array([[v % p for v in row] for row in m], np.int64), p)
    d = len(h)
    done = np.zeros((d + 1, d + 1), np.int64)  # row k: the polynomial of the leading k x k part
    done[0, 0] = 1
    for k in range(d):
        done[k + 1, 1:] = done[k, :-1]
        done[k + 1] = (done[k + 1] - h[k, k] * done[k]) % p
        under = 1
        for i in range(k - 1, -1, -1):
            under = under * int(h[i + 1, i]) % p
            if not under:
                break
            done[k + 1] = (done[k + 1] - int(h[i, k]) * under % p * done[i]) % p
    return done[d]


def polynomial(spark, m: list[list[int]]) -> list[int]:
    """Coefficients of det(x I - m), the constant first; primes are dealt over tasks."""
    d, trace = len(m), sum(m[i][i] for i in range(len(m)))
    bound = max(math.comb(d, k) * (trace**k // d**k + 1) for k in range(d + 1))
    used = primes(-(-(2 * bound + 1).bit_length() // (PRIME_BITS - 1)))

    def residues(frames):
        for frame in frames:
            for p in frame["p"].tolist():
                yield pd.DataFrame({"p": [p], "c": [polynomial_mod(m, p).tolist()]})

    tasks = min(len(used), max(1, spark.sparkContext.defaultParallelism))
    dealt = spark.createDataFrame([(p,) for p in used], "p long").repartition(tasks)
    found = {r["p"]: r["c"] for r in dealt.mapInPandas(residues, "p long, c array<long>").collect()}  # d + 1 each
    whole, out = 1, [0] * (d + 1)
    for p, c in sorted(found.items()):
        back = pow(whole, -1, p)
        out = [o + whole * ((r - o) * back % p) for o, r in zip(out, c, strict=True)]
        whole *= p
    return [o - whole if 2 * o > whole else o for o in out]


def above(c: list[int], a: int) -> int:
    """How many roots are larger than a, with multiplicity; all roots of c are real."""
    shifted = list(c)
    for low in range(len(c) - 1):
        for i in range(len(c) - 2, low - 1, -1):
            shifted[i] += a * shifted[i + 1]
    signs = [v > 0 for v in shifted if v]
    return sum(x != y for x, y in zip(signs, signs[1:], strict=False))


def value_sign(c: list[int], a: int) -> int:
    out = 0
    for v in reversed(c):
        out = out * a + v
    return (out > 0) - (out < 0)


def largest_roots(c: list[int], count: int) -> tuple[list[int], int]:
    """The ``count`` largest positive roots times 2^scale, rounded up, and scale; falling, with repeats."""
    d = len(c) - 1
    top = max(1, -c[d - 1])  # the trace
    scale = max(0, BITS - top.bit_length() + d.bit_length())
    c = [v << (scale * (d - k)) for k, v in enumerate(c)]
    high, counts = top << scale, {}

    def roots_above(a: int) -> int:
        if a not in counts:
            counts[a] = above(c, a)
        return counts[a]

    out = []
    for k in range(1, min(count, roots_above(0)) + 1):
        # the k-th largest root lies in (low, up]
        low = max((a for a, n in counts.items() if n >= k), default=0)
        up = min((a for a, n in counts.items() if n < k), default=high)
        roots_above(up)
        while up - low > 1 and counts[low] - counts[up] > 1:
            mid = (low + up) // 2
            low, up = (mid, up) if roots_above(mid) >= k else (low, mid)
        if up - low > 1:  # alone there: its sign tells the side
            right = value_sign(c, up) or value_sign(c, up + 1)
            while up - low > 1:
                mid = (low + up) // 2
                sign = value_sign(c, mid)
                low, up = (mid, up) if sign and sign != right else (low, mid)
        out.append(up)
    return out, scale


def null_vector(m: np.ndarray, root: int, scale: int, known: list[np.ndarray]) -> np.ndarray:
    """A unit vector of the null space of m - root / 2^scale, orthogonal to the known ones, times 2^scale.

    Two rounds of inverse iteration with elimination on whole numbers in units of 2^-bits.
    """
    d, bits = len(m), scale + 64
    a = np.array([[int(v) << bits for v in row] for row in m], object)
    a[np.diag_indices(d)] -= root << (bits - scale)
    order, low = np.arange(d), np.zeros((d, d), object)
    for k in range(d):
        best = k + max(range(d - k), key=lambda i: abs(a[k + i, k]))
        for rows in (a, low):
            rows[[k, best]] = rows[[best, k]]
        order[[k, best]] = order[[best, k]]
        a[k, k] = a[k, k] or 1
        if k + 1 < d:
            low[k + 1 :, k] = (a[k + 1 :, k] << bits) // a[k, k]
            a[k + 1 :, k:] -= low[k + 1 :, k, None] * a[k, k:] >> bits
    draw = np.random.default_rng(12)
    x = np.array([int(v) for v in draw.integers(-(2**40), 2**40, d)], object)
    for _ in range(2):
        x = orthogonal(x, known, bits)[order]
        for k in range(d):
            x[k + 1 :] -= low[k + 1 :, k] * x[k] >> bits
        for k in range(d - 1, -1, -1):
            x[k] = (x[k] << bits) // a[k, k]
            x[:k] -= a[:k, k] * x[k] >> bits
        x = unit(x, bits)
    return unit(orthogonal(x, known, bits), bits)


def unit(x: np.ndarray, bits: int) -> np.ndarray:
    size = math.isqrt(int((x * x).sum())) or 1
    return np.array([(int(v) << bits) // size for v in x], object)


def orthogonal(x: np.ndarray, known: list[np.ndarray], bits: int) -> np.ndarray:
    for k in known:
        x = x - (k * int((k * x).sum()) >> 2 * bits)
    return x


@dataclass(frozen=True)
class Whitening:
    """Mean, components (rows), eigenvalues of V and their shares of its trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray


def fit(rows: DataFrame, components: int) -> Whitening | None:
    n, sums, m = scatter(rows)
    trace = sum(m[i][i] for i in range(len(m)))
    if not trace:
        return None
    roots, scale = largest_roots(polynomial(rows.sparkSession, m), components)
    found: list[np.ndarray] = []
    for root in roots:
        found.append(null_vector(np.array(m, object), root, scale, found))
    vectors = np.array([[int(v) / 2 ** (scale + 64) for v in x] for x in found])
    vectors *= np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(1)])[:, None]
    values = np.array([root / (n * n << scale) for root in roots])
    return Whitening(n, sums, vectors, values, np.array([root / (trace << scale) for root in roots]))


def projected(w: Whitening):
    """Rows (vec_id, deviation, whitened) of a batch; centred before multiplying."""
    scaled = w.components / np.sqrt(w.values)[:, None]
    shift = [s // w.n for s in w.sums]  # whole part of the mean; the rest is small
    rest = np.array([(s - w.n * q) / w.n for s, q in zip(w.sums, shift, strict=True)])
    remain = [s - w.n * q for s, q in zip(w.sums, shift, strict=True)]
    whole = np.array(shift, np.int64)

    def run(frames):
        for frame in frames:
            if not len(frame):
                continue
            apart = np.stack(frame["y"].to_list()) - whole
            exact = apart.astype(object) * w.n - np.array(remain, object)
            yield pd.DataFrame({
                "vec_id": frame["vec_id"], "deviation": [str(v) for v in (exact**2).sum(1)],
                "whitened": list((apart - rest) @ scaled.T),
            })

    return run


def whitened(vectors: DataFrame, components: int = 8) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) per row and component.

    ``deviation`` is exact, as decimal(38,0).
    """
    spark, rows = vectors.sparkSession, usable(vectors)
    w = fit(rows, components)
    schema = "vec_id long, deviation decimal(38,0), w array<double>"
    if w is None:
        made, error, shares = spark.createDataFrame([], schema), 0.0, []
    else:
        made = rows.mapInPandas(projected(w), "vec_id long, deviation string, whitened array<double>")
        made = saved(made.select("vec_id", F.col("deviation").cast("decimal(38,0)"), F.col("whitened").alias("w")), "whitened")
        error, shares = identity_error(made, len(w.values)), w.explained.tolist()
    each = made.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    share = F.lit(shares).cast("array<double>")
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(w.n if w else 0).cast("long").alias("n"), "deviation", "whitened",
        F.get(share, "at").alias("explained"), F.lit(error).alias("identity_error"),
    )


def identity_error(made: DataFrame, k: int) -> float:
    """Largest absolute entry of the covariance of all whitened rows minus the identity."""
    means = made.agg(*(F.avg(F.col("w")[i]).alias(f"m{i}") for i in range(k)))
    centred = made.join(F.broadcast(means)).select(*((F.col("w")[i] - F.col(f"m{i}")).alias(f"c{i}") for i in range(k)))
    cov = centred.agg(*(F.avg(F.col(f"c{i}") * F.col(f"c{j}")).alias(f"c{i}_{j}") for i in range(k) for j in range(i, k))).first()
    return max(abs(cov[f"c{i}_{j}"] - (i == j)) for i in range(k) for j in range(i, k))
