from __future__ import annotations

import random

import pytest

from panelspark.llm import near_dups as n


def brute(texts, k, percent):
    sets = {}
    for key, text in texts.items():
        w = (text or "").encode().lower().split()
        j = min(k, len(w))
        sets[key] = {tuple(w[i : i + j]) for i in range(len(w) - j + 1)} if w else set()
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    keys = sorted(texts)
    for x, a in enumerate(keys):
        for b in keys[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: (len(sets[i]), find(i), find(i) == i) for i in texts}


def corpus():
    """Chains and stars of edits whose smallest id is not the middle, copies, short and empty texts."""
    draw = random.Random(9)
    texts, at = {}, 0
    for group in range(12):
        base = [f"g{group}w{draw.randrange(900)}" for _ in range(draw.choice([20, 80, 300]))]
        for _ in range(draw.choice([2, 6, 25])):
            body = list(base)
            for _ in range(max(1, len(body) // draw.choice([25, 40, 60]))):
                body[draw.randrange(len(body))] = f"e{draw.randrange(10**6)}"
            texts[at] = " ".join(body)
            at += 1
            if draw.random() < 0.2:
                base = body  # a chain
        texts[at] = " ".join(base)
        at += 1
    return texts | {900: None, 901: "", 902: "One word", 903: "one  WORD", 904: "x", 905: texts[0], 906: "long " * 30000}


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_equals_brute_force(docs_of, k, percent):
    texts = corpus()
    got = n.near_duplicates(docs_of(texts), k, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute(texts, k, percent)


def test_blocks_and_joins_beyond_their_bounds(docs_of, monkeypatch):
    monkeypatch.setattr(n, "BLOCK", 500)
    monkeypatch.setattr(n, "COLUMNS", 64)
    monkeypatch.setattr(n, "IDS_BROADCAST", -1)
    monkeypatch.setattr(n, "STAR", 2)
    monkeypatch.setattr(n, "EDGES", 20)
    texts = corpus()
    got = n.near_duplicates(docs_of(texts), 3, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute(texts, 3, 85)


@pytest.mark.parametrize("edges_a_task", [500_000, 7])
def test_components_of_a_chain(spark, monkeypatch, edges_a_task):
    monkeypatch.setattr(n, "EDGES", edges_a_task)
    rows = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (60, 55), (60, 58)]
    edges = spark.createDataFrame(rows, "a long, b long").repartition(6)
    got = {r.node: r.root for r in n.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100, 60: 55, 58: 55}
    assert n.components(edges.limit(0)).collect() == []


@pytest.mark.parametrize("partitions", [1, 6])
def test_one_id_with_two_texts_in_an_open_star(docs_of, partitions):
    rows = [(1, "a"), (2, "a x"), (7, "b"), (7, "a y"), (9, "b z"), (8, "a")]
    got = n.near_duplicates(docs_of(rows).repartition(partitions), 3, 85).collect()
    want = [(1, 1, 1, True), (2, 1, 2, True), (7, 1, 7, True), (7, 1, 7, True), (8, 1, 1, False), (9, 1, 9, True)]
    assert sorted(map(tuple, got)) == want
    body = [f"w{i}" for i in range(60)]
    near = " ".join(body)
    far = " ".join([*body[:30], "edit", *body[31:]])
    rows = [(5, near), (5, "other words"), (6, far), (4, "other words"), (6, "third text here")]
    got = sorted(map(tuple, n.near_duplicates(docs_of(rows).repartition(partitions), 3, 85).collect()))
    assert sorted((i, c) for i, _, c, _ in got) == [(4, 4), (5, 4), (5, 5), (6, 5), (6, 6)]
    kept = sorted((r.doc_id, r.text) for r in n.without_near_duplicates(docs_of(rows), 3, 85).collect())
    assert kept == [(4, "other words"), (5, near), (6, "third text here")]


def test_twins_of_the_leading_row(docs_of):
    rows = [(3, "One two three"), (3, "one  two three"), (3, "one  two three"), (4, "ONE TWO THREE")]
    assert n.without_near_duplicates(docs_of(rows)).count() == 1


def test_one_row_of_each_group_stays(docs_of):
    same = "a b c d e f g h"
    rows = [(3, same), (3, same), (1, same), (None, "other"), (None, None), (8, None), (9, "")]
    kept = n.without_near_duplicates(docs_of(rows))
    assert kept.columns == docs_of([]).columns
    assert sorted(((r.doc_id or -1), r.text) for r in kept.collect() if r.text) == [(-1, "other"), (1, same)]
    assert kept.count() == 5
    assert n.without_near_duplicates(docs_of([])).count() == 0


def test_one_id_with_unrelated_texts_keeps_them(docs_of):
    """Copies go by text, not by id; rows without words stay."""
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    rows = [(1, a), (7, b), (7, a), (7, ""), (7, None), (7, b), (9, a), (None, "c d e"), (5, None), (5, None)]
    got = [(r.doc_id, r.text) for r in n.without_near_duplicates(docs_of(rows)).collect()]
    want = [(1, a), (7, b), (7, ""), (7, None), (None, "c d e"), (5, None), (5, None)]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
