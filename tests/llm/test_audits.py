"""Operators 11 to 13 against plain versions, on planted and odd input."""

from __future__ import annotations

from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.llm import divergence as dv
from panelspark.llm import robust_rules as rr
from panelspark.llm import whitening as wh
from panelspark.llm.common import table


def plain_counts(text):
    """Every count of the base rule, word by word."""
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen, inside = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            inside |= {i, i + 1, i + 2}
    lines, doubled = set(), 0
    for line in (text or "").split("\n"):
        if line.strip(" \t\n\r\v\f"):
            doubled += line in lines
            lines.add(line)
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), doubled, len(inside)]


ODD = [None, "", " \n\t", "a", "é b\x1cc", "x y z x y z", "l\nl\nl \n\nl", "#$ a|b <c>\r\n", "w " * 3000, "a b c d\n" * 70]


def test_counts_match_a_plain_version(spark, folder):
    texts = ODD + [r["text"] for r in table(spark, folder, "documents").collect()]
    for text in texts:
        assert rr.counted(text)[0] == plain_counts(text)


def test_repeated_windows_with_many_words():
    words = [str(i).encode() for i in range(3000)] * 2
    assert rr.repeated_words(words) == 6000 and rr.repeated_words(words[:3001]) == 0


def prose(draw, i, mark=""):
    return f"{i} " + " ".join("".join(draw.choice(list("etaoin"), draw.integers(2, 9))) + mark for _ in range(200))


def plain_estimate(x):
    """Concentration steps over all rows of one group, with sorting."""
    tolerance = np.diag((rr.UNIT * rr.TOLERANCE) ** 2)
    scale = np.maximum((np.percentile(x, 75, axis=0) - np.percentile(x, 25, axis=0)) / 1.349, rr.UNIT * rr.TOLERANCE)
    best = None
    for part in (0.5, rr.SHARE, 1.0):
        d, h = (((x - np.median(x, axis=0)) / scale) ** 2).sum(1), part
        for _ in range(60):
            near = x[np.argsort(d, kind="stable")[: int(np.ceil(h * len(x)))]]
            centre = near.mean(0)
            spread = np.cov(near.T, bias=True) * (rr.CONSISTENT if h < 1 else 1) + tolerance
            d, h = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(spread), x - centre), rr.SHARE
        if best is None or np.linalg.slogdet(spread)[1] < best[0]:
            best = np.linalg.slogdet(spread)[1], d
    return best[1]


def test_outliers_go_and_ordinary_texts_stay(spark, docs_of):
    draw = np.random.default_rng(1)
    rows = [(i, prose(draw, i, "&&&" if i % 10 == 0 else "")) for i in range(300)]
    docs = docs_of(rows).withColumn("source", F.when(F.col("doc_id") < 150, "a").otherwise("b"))
    made = {r["doc_id"]: r for r in rr.judge_quality(docs).collect()}
    assert [made[i]["kept"] for i in range(300)] == [i % 10 != 0 for i in range(300)]
    assert {r["level"] for r in made.values()} == {0}
    x = np.array([rr.counted(t)[1] for i, t in rows if i < 150], float)
    for i, d in enumerate(plain_estimate(x)):  # bins let a few more rows in than sorting does
        assert made[i]["distance"] ** 2 == pytest.approx(d, rel=0.15, abs=0.1)


def test_small_groups_use_larger_ones_and_odd_rows(spark, docs_of):
    draw = np.random.default_rng(2)
    rows = [(i, prose(draw, i, "|" if i == 7 else "")) for i in range(60)] + [(100 + i, t) for i, t in enumerate(ODD)] + [(None, None), (1, None)]
    docs = docs_of(rows).withColumn("source", F.concat(F.lit("s"), F.coalesce("doc_id", F.lit(0)) % 9)).withColumn("kept", F.lit("clash"))
    docs = docs.withColumn("lang", F.when(F.col("doc_id") < 50, F.col("lang")))  # 50 rows without a language
    made = rr.judge_quality(docs).collect()
    assert len(made) == len(rows)
    assert {r["level"] for r in made if not r["base_failed"]} == {1, 2}
    assert all(r["distance"] is None and not r["kept"] for r in made if r["base_failed"])
    assert [r["kept"] for r in made if r["doc_id"] == 7] == [False]


def test_few_or_no_rows_have_no_estimate(spark, docs_of):
    draw = np.random.default_rng(3)
    made = rr.judge_quality(docs_of([(i, prose(draw, i)) for i in range(5)]).withColumn("source", F.lit(None).cast("string"))).collect()
    assert all(r["kept"] and r["distance"] is None and r["level"] is None for r in made)
    assert rr.judge_quality(docs_of([]).withColumn("source", F.lit("a"))).collect() == []


def test_estimates_do_not_depend_on_partitions(spark, folder):
    docs = table(spark, folder, "documents")
    one, many = (sorted(map(tuple, rr.judge_quality(docs.repartition(n)).collect())) for n in (1, 7))
    assert one == many


# whitening


def exact_polynomial(m):
    """Faddeev and LeVerrier, in fractions."""
    d = len(m)
    a, c, out = [[Fraction(0)] * d for _ in range(d)], Fraction(1), [Fraction(1)]
    for k in range(1, d + 1):
        a = [[sum(m[i][t] * a[t][j] for t in range(d)) + (c if i == j else 0) * 1 for j in range(d)] for i in range(d)] if k > 1 else [
            [Fraction(i == j) for j in range(d)] for i in range(d)
        ]
        c = -sum(sum(m[i][t] * a[t][i] for t in range(d)) for i in range(d)) / k
        out.append(c)
    return out[::-1]


def gram(rows, d, seed):
    x = np.random.default_rng(seed).integers(-9999, 9999, (rows, d))
    return (x.T @ x).tolist()


@pytest.mark.parametrize("m", [gram(9, 6, 1), gram(3, 6, 2), [[5]], [[2, 0], [0, 2]], [[0, 0, 0], [0, 3, 0], [0, 0, 3]]])
def test_polynomial_is_exact(spark, m):
    assert wh.polynomial(spark, m) == exact_polynomial(m)


def test_primes():
    found = wh.primes(5000)
    assert found[0] == 2**31 - 1 and found == sorted(set(found), reverse=True)
    assert all(pow(2, p - 1, p) == 1 and pow(3, p - 1, p) == 1 for p in found)


def test_roots_close_and_repeated():
    roots = [10**12, 10**12, 10**12 - 1, 7, 7, 1, 0, 0]
    c = [1]
    for r in roots:
        c = [(c[i - 1] if i else 0) - r * (c[i] if i < len(c) else 0) for i in range(len(c) + 1)]
    found, scale = wh.largest_roots(c, 8)
    assert [round(Fraction(f, 2**scale), 9) for f in found] == [10**12, 10**12, 10**12 - 1, 7, 7, 1]


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_whitening_equals_numpy(spark, folder):
    v = table(spark, folder, "embeddings")
    rows = v.collect()
    x = np.floor(1024 * np.array([r["embedding"] for r in rows], float)) + 100000
    values, axes = np.linalg.eigh(np.cov(x.T, bias=True))
    values, axes = values[::-1][:8], axes[:, ::-1][:, :8]
    want = (x - x.mean(0)) @ axes / np.sqrt(values)
    made = wh.whitened(v.withColumn("whitened", F.lit("clash")).repartition(5)).collect()
    assert len(made) == 8 * len(rows)
    place = {r["vec_id"]: i for i, r in enumerate(rows)}
    trace = np.trace(np.cov(x.T, bias=True))
    sums = [sum(map(int, col)) for col in x.T]
    for r in made:
        i, k = place[r["vec_id"]], r["component"] - 1
        assert abs(r["whitened"]) == pytest.approx(abs(want[i, k]), abs=1e-9)
        assert r["explained"] == pytest.approx(values[k] / trace, rel=1e-9)
        assert r["n"] == len(rows) and r["identity_error"] < 1e-9
        if k == 0:
            assert int(r["deviation"]) == sum((len(rows) * int(a) - s) ** 2 for a, s in zip(x[i], sums, strict=True))


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 2.0, 0.5]), (2, [1.0, -2.0, 0.5]), (2, [0.0, 0.0, 0.5]), (None, [3.0, 1.0, 0.5]), (5, [3.0, 1.0, 0.5])]
    bad = [(6, None), (7, []), (8, [nan, 1.0, 1.0]), (9, [inf, 1.0, 1.0]), (10, [None, 1.0, 1.0]), (11, [1.0]), (12, [1e30, 0.0, 0.0])]
    made = wh.whitened(vectors_of(spark, good + bad)).collect()
    assert sorted(str(r["vec_id"]) for r in made) == sorted(str(i) for i, _ in good for _ in range(2))  # rank 2
    assert {r["n"] for r in made} == {5} and max(r["identity_error"] for r in made) < 1e-9
    assert sum({r["component"]: r["explained"] for r in made}.values()) == pytest.approx(1)
    for rows in ([], bad, [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(4)]):
        assert wh.whitened(vectors_of(spark, rows)).collect() == []


def test_whitening_of_equal_eigenvalues(spark):
    rows = [(i, [float(s * (i == k)) for k in range(4)]) for i in range(4) for s in (1, -1)]
    made = wh.whitened(vectors_of(spark, rows)).collect()
    assert len(made) == 8 * 4 and max(r["identity_error"] for r in made) < 1e-9


def test_sums_of_large_entries_are_exact(spark):
    rows = [(i, [2.0**29 * i, 3.0, -(2.0**28) - i]) for i in range(6)]
    n, sums, m = wh.scatter(wh.usable(vectors_of(spark, rows)))
    y = [[int(1024 * np.float32(c)) for c in v] for _, v in rows]
    assert n == 6 and sums == [sum(r[i] for r in y) for i in range(3)]
    assert m == [[6 * sum(r[i] * r[j] for r in y) - sums[i] * sums[j] for j in range(3)] for i in range(3)]


# divergence; its SQL is compared on the given tables by tests/test_oracles.py


def plain_divergence(rows, documents=3, ranks=200):
    """Dense counts of every group and kept term."""
    docs = [((lang or ""), (source or ""), dv.terms_of(text)) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        seen = Counter(t for _, _, c in mine for t in c)
        kept = [t for t, n in seen.items() if n >= documents]
        count = {s: Counter() for _, s, _ in mine}
        for _, s, c in mine:
            count[s].update(c)
        count[None] = sum((c for _, _, c in mine), Counter())
        p = {}
        for s, c in count.items():
            total = sum(c[t] for t in kept)
            p[s] = {t: 1 + 10**9 * (c[t] + 1) // (total + len(kept)) for t in kept}
        def far(s, o, t):
            return (p[s][t] - p[o][t]) ** 2 // p[o][t]

        for s in count:
            if s is None:
                continue
            pairs = [(o, sum(far(s, o, t) for t in kept)) for o in count if o not in (s, None)]
            terms = [(t.decode(), far(s, None, t)) for t in kept if count[s][t] and p[s][t] > p[None][t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, ranks)):
                best = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(best)]
    return sorted(out)


def test_divergence_equals_a_plain_version(spark, monkeypatch):
    draw = np.random.default_rng(4)
    words = ["the", "Über", "x1y", "ça", "zeta", "eta", "omega", "naïve", "\U0001f600", "A", "b-c"]
    rows = [(" ".join(draw.choice(words, draw.integers(1, 30))), "en" if i % 3 else None, f"s{i % 4}") for i in range(60)]
    rows += [(None, "en", "empty"), ("", "en", None), ("12 34", "xx", "p"), ("only once", "xx", "q"), ("THE the", "en", "s1")] * 2
    docs = spark.createDataFrame([(i, *r, "clash") for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, value string")
    want = plain_divergence(rows)
    for held, block in ((dv.HELD_TERMS, dv.BLOCK_TERMS), (3, 2)):
        monkeypatch.setattr(dv, "HELD_TERMS", held)
        monkeypatch.setattr(dv, "BLOCK_TERMS", block)
        assert sorted(map(tuple, dv.divergence(docs.repartition(3)).collect())) == want
    assert len([r for r in want if r[0] == "xx"]) == 2  # pairs of a language without kept terms


def test_divergence_ranks_and_empty(spark):
    rows = [(i, " ".join(chr(97 + j) * 3 for j in range(i % 5 + 1)), "en", f"s{i % 2}") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    made = dv.divergence(docs, ranks=1).collect()
    assert all(r["rank"] == 1 for r in made if r["part"] == "term")
    assert dv.divergence(docs.limit(0)).collect() == []


def test_terms_of_a_long_text():
    assert dv.terms_of("Word1wOrdÄ " * 500_000) == {b"word": 1_000_000 - 500_000, "wordÄ".encode(): 500_000}
