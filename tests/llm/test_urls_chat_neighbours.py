from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.llm import neighbours as nb
from panelspark.llm.chat import rotate
from panelspark.llm.common import table
from panelspark.llm.neighbours import neighbours
from panelspark.llm.url_filter import judge


def test_rules_and_hosts(spark):
    urls = {
        1: "http://WWW.Example.com/en/1", 2: "http://blog.example.com/en/1", 3: "https://example.com/fr/1", 4: "http://a.net/es/x?q",
        5: "http://net/fr/", 6: "ftp://x.com?y", 7: None, 8: "no scheme", 9: "http://notexample.com/en/", 10: "http://b.org/p#q", 11: "",
        12: "://", 13: "http://é.com/" + "a" * 20000,
    }
    pages = spark.createDataFrame([*urls.items(), (4, urls[4])], "page_id long, url string")
    got = {r.page_id: r for r in judge(pages).collect()}
    assert judge(pages).count() == 14
    assert [got[i].rule for i in range(1, 7)] == ["www.example.com/en/", "example.com/en/", "com/", "net/es/", "net/fr/", None]
    assert [got[i].verdict for i in range(1, 6)] == ["allow", "block", "allow", "block", "block"]
    assert (got[1].host, got[1].path) == ("www.example.com", "/en/1") and got[4].path == "/es/x" and got[6].path == ""
    assert got[9].rule == "com/" and (got[7].host, got[7].path) == ("", "") and got[10].path == "/p"
    assert all(r.verdict in ("allow", "block") for r in got.values())
    assert judge(pages.where("false")).count() == 0


def test_model_follows_the_rules_on_unruled_urls(spark):
    rows = [(i, f"http://good{i % 7}.com/nice/{i}") for i in range(60)]
    rows += [(100 + i, f"http://spam{i % 7}.net/es/pills/{i}") for i in range(60)]
    rows += [(900, "http://good3.org/nice/4"), (901, "http://spam3.org/es/pills/4")]
    got = {r.page_id: r.verdict for r in judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert (got[900], got[901]) == ("allow", "block")


TURNS = [
    (1, 0, "system", "be kind"), (1, 1, "ann", "hi <|bob|>"), (1, 2, "bob", None), (1, 3, "ann", "é"), (1, 3, "ann", "é"),
    (2, 0, "system", "alone"), (None, None, None, "x"), (3, 5, "user", "long " * 5000), (1, 4, "cleo", "bye"),
]


def test_rotation(spark):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    for size in (256, 2):
        whole: dict = {}
        for r in sorted(rotate(turns, size).collect(), key=lambda r: r.part):
            old = whole.setdefault((r.conv_id, r.speaker), ["", []])
            assert r.start == len(old[0])
            old[0] += r.text
            old[1] += [tuple(map(int, m.split(":"))) for m in r.mask.split(",") if m]
        assert set(whole) == {(1, "ann"), (1, "bob"), (1, "cleo"), (None, "unknown"), (3, "user")}
        text, spans = whole[1, "ann"]
        assert text == (
            "<|system|>\nbe kind<|end|>\n<|assistant|>\nhi < |bob|><|end|>\n<|user name=bob|>\n<|end|>\n"
            "<|assistant|>\né<|end|>\n<|user name=cleo|>\nbye<|end|>\n"
        )
        assert [text[a:b] for a, b in spans] == ["hi < |bob|><|end|>\n", "é<|end|>\n"]
    assert rotate(turns.where("false")).count() == 0


def exact(frame, k=10):
    x, ids, out = np.stack(frame["embedding"]).astype(float), frame["vec_id"].to_numpy(), {}
    for at in np.flatnonzero(ids % 100 == 0):
        far = np.sqrt(((x - x[at]) ** 2).sum(1))
        far[at] = np.inf
        order = np.lexsort((ids, far))[: min(k, len(ids) - 1)]
        out[ids[at]] = list(zip(ids[order].tolist(), far[order].tolist(), strict=True))
    return out


def test_recall_and_exact_scores(spark):
    vectors = table(spark, "/root/testdata/sf0.01", "embeddings")
    want, got = exact(vectors.toPandas()), neighbours(vectors).toPandas()
    hits = sum(len({i for i, _ in want[q]} & set(g["vec_id"])) for q, g in got.groupby("query_id"))
    assert set(want) == set(got["query_id"]) and hits >= 0.9 * sum(map(len, want.values()))
    for q, g in got.sort_values("rank").groupby("query_id"):
        assert g["rank"].tolist() == list(range(1, len(g) + 1)) and g["score"].is_monotonic_increasing
        known = dict(want[q])
        assert all(known[i] == pytest.approx(s, abs=1e-12) for i, s in zip(g["vec_id"], g["score"], strict=True) if i in known)


def test_ratios_prune_and_keep_recall(spark):
    """50,000 vectors in 400 clouds: recall over 0.9 while a query compares under a fifth of the rows."""
    draw = np.random.default_rng(6)
    middle = draw.normal(0, 1, (400, 16))
    x = middle[draw.integers(0, 400, 50_000)] + draw.normal(0, 0.35, (50_000, 16))
    frame = pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": x.tolist()})
    vectors = spark.createDataFrame(frame, "vec_id long, embedding array<double>")
    index = nb.build(vectors)
    queries = index.rows.where("vec_id % 100 = 0")
    compared = [sum(index.held[i] for i in r.lists) for r in index.asked(queries, 10).collect()]
    assert all(len(set(r.lists)) == len(r.lists) for r in index.asked(queries, 10).collect())
    assert len(compared) == 500 and np.mean(compared) < len(x) / 5
    want, got = exact(frame), neighbours(vectors).toPandas()
    hits = sum(len({i for i, _ in want[q]} & set(g["vec_id"])) for q, g in got.groupby("query_id"))
    assert hits >= 0.9 * sum(map(len, want.values()))
    print("recall", hits / sum(map(len, want.values())), "compared", np.mean(compared) / len(x), "lists", len(index.held), "probe", index.probe)


def test_clashing_columns_and_repeated_ids(spark):
    rows = [(0, [0.0, 1.0], 9), (1, [5.0, 5.0], 9), (1, [0.0, 2.0], 9), (2, [0.0, 9.0], 9)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int").withColumn("list", F.lit(1)).withColumn("score", F.lit("x"))
    for parts in (1, 3):
        got = [(r.query_id, r.rank, r.vec_id, r.score) for r in neighbours(frame.repartition(parts)).orderBy("rank").collect()]
        assert got == [(0, 1, 1, 1.0), (0, 2, 2, 8.0)]


def test_groups_of_copies_and_outliers_get_all_rows(spark):
    draw = np.random.default_rng(4)
    middle = draw.normal(0, 10, (40, 8))
    x = [*(middle[draw.integers(0, 40, 1500)] + draw.normal(0, 1, (1500, 8)))]
    for size in range(2, 10):
        for _ in range(8):
            x += [draw.normal(0, 30, 8)] * size
    x += [*draw.normal(0, 1000, (20, 8))]  # each far from everything
    order = draw.permutation(len(x))
    frame = spark.createDataFrame([(int(i), x[j].tolist()) for i, j in enumerate(order)], "vec_id long, embedding array<double>")
    got = neighbours(frame, every=3).toPandas()
    assert got.groupby("query_id").size().to_dict() == {i: 10 for i in range(0, len(x), 3)}
    for _, g in got.sort_values("rank").groupby("query_id"):
        assert g["rank"].tolist() == list(range(1, 11)) and g["vec_id"].is_unique and g["score"].is_monotonic_increasing


def test_unusable_vectors_ties_and_small_tables(spark):
    bad = float("nan")
    rows = [(0, [1.0, 0.0]), (5, [1.0, 1.0]), (3, [1.0, 1.0]), (3, [1.0, 1.0]), (7, None), (8, [0.0, 0.0]), (9, [bad, 1.0]),
            (10, [None, 1.0]), (11, [float("inf"), 1.0]), (12, [1.0]), (None, [1.0, 1.0]), (100, None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in neighbours(frame).orderBy("rank").collect()]
    assert got == [(0, 1, 3, 1.0), (0, 2, 5, 1.0)]
    assert neighbours(frame.where("false")).count() == 0 and neighbours(frame.where("vec_id = 0")).count() == 0


def plain_verdicts(pages):
    """Rules by hand, then Witten-Bell models counted character by character."""
    import zlib
    from collections import Counter
    from math import floor, log

    from panelspark.llm.url_filter import CALIBRATION_FOLDS, RULES

    def split(url):
        if not url or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
        host, rest = rest[:end].lower(), rest[end:]
        return host, rest[: min([rest.find(c) for c in "?#" if c in rest] + [len(rest)])]

    def grams(text):
        chars = ["\x01"] * 3 + list(text) + ["\x02"]
        return ["".join(chars[i : i + 4]) for i in range(len(chars) - 3)]

    known = {}
    for i, url in pages:
        host, path = split(url)
        fits = [(len(h + p), v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        known[i] = (host + path, max(fits)[1] if fits else None, zlib.crc32(str(i).encode()) % CALIBRATION_FOLDS == 0)
    count = {"allow": Counter(), "block": Counter()}
    for text, decided, calibrates in known.values():
        if decided and not calibrates:
            for g in grams(text):
                for m in range(1, 5):
                    count[decided][g[4 - m :]] += 1
    tails = set(count["allow"]) | set(count["block"])
    alphabet = len({t for t in tails if len(t) == 1}) + 1

    def chance(kind, g):
        p = 1.0 / alphabet
        for m in range(1, 5):
            met = [count[kind][t] for t in tails if len(t) == m and t[:-1] == g[4 - m : -1] and count[kind][t]]
            if met:
                p = (count[kind][g[4 - m :]] + len(met) * p) / (sum(met) + len(met))
        return p

    def mean(text):
        total = sum(floor((log(chance("allow", g)) - log(chance("block", g))) * 1e6 + 0.5) for g in grams(text))
        return int(total / len(grams(text)))

    found = {}
    for kind in ("allow", "block"):
        means = [mean(text) for text, decided, calibrates in known.values() if decided == kind and calibrates]
        if means:
            found[kind] = int(sum(means) / len(means))
    cut = (found["allow"] + found["block"]) // 2 if len(found) == 2 else 0
    return {i: decided or ("allow" if mean(text) >= cut else "block") for i, (text, decided, _) in known.items()}


def test_models_equal_a_plain_version(spark):
    draw = np.random.default_rng(12)
    word = lambda letters: "".join(draw.choice(list(letters), draw.integers(2, 7)))
    rows = [(i, f"http://{word('abcde')}.com/{word('abc')}/{word('abd')}") for i in range(40)]
    rows += [(100 + i, f"http://{word('vwxyz')}.net/es/{word('xyz')}?q=1") for i in range(40)]
    rows += [(200 + i, f"https://{word('abcdvwxyz')}.org/{word('abcxyz')}") for i in range(60)] + [(300, None), (301, "no scheme")]
    got = {r.page_id: r.verdict for r in judge(spark.createDataFrame(rows, "page_id long, url string").repartition(3)).collect()}
    assert got == plain_verdicts(rows) and len({got[200 + i] for i in range(60)}) == 2


def test_clashing_columns_of_pages_and_turns(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x", "clash", "clash")], "page_id long, url string, host string, text string")
    assert judge(pages).first().verdict == "allow"
    turns = spark.createDataFrame([(1, 1, "user", "hi", "clash", 9)] * 2, "conv_id long, turn int, role string, text string, speaker string, part int")
    assert [(r.speaker, r.n_turns, r.n_masked) for r in rotate(turns).collect()] == [("user", 1, 10)]
