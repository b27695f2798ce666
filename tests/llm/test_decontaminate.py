from __future__ import annotations

import hashlib
import random
import re

from panelspark.llm import decontaminate as d

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(texts, items):
    out = {}
    for key, text in texts.items():
        w, hit, found = words(text), set(), set()
        for item, body in items:
            v = words(body)
            n = min(10, len(v))
            windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
            for i in range(len(w) - n + 1 if n else 0):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found.add("" if item is None else str(item))
        out[key] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def cases():
    draw = random.Random(4)
    vocab = [f"w{i}" for i in range(40)] + ["Äpfel", "é", "x1"]
    passage = lambda n: [draw.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(passage(n))) for i, n in enumerate((30, 25, 10, 12, 9, 6, 5, 3, 1))]
    items += [(20, items[0][1]), (None, "ONE-two, three four"), (21, None), (22, ""), (23, "a " * 40)]
    texts = {}
    for i in range(60):
        body = passage(draw.randrange(0, 60))
        for _ in range(draw.randrange(0, 3)):
            source = words(draw.choice(items)[1])
            a = draw.randrange(0, max(1, len(source)))
            body[len(body) // 2 : len(body) // 2] = source[a : a + draw.randrange(5, 20)]
        texts[i] = draw.choice([" ", ", ", "\n"]).join(body)
    texts |= {100: None, 101: "", 102: "a " * 3000, 103: "one two THREE!four", 104: "...", 105: items[0][1].upper()}
    return texts, items


def rows(found):
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found.collect()}


def test_equals_brute_force_and_both_join_ways(spark, docs_of, monkeypatch):
    texts, items = cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(texts, items)
    assert rows(d.contamination(docs_of(texts), bench)) == want
    monkeypatch.setattr(d, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(d, "KEYS_BROADCAST", -1)
    assert rows(d.contamination(docs_of(texts), bench)) == want
    kept = d.without_contaminated(docs_of(texts), bench)
    assert {r.doc_id for r in kept.collect()} == {k for k, v in want.items() if not v[4]}
    assert kept.columns == docs_of({}).columns


def test_empty_tables_and_repeated_rows(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    assert rows(d.contamination(docs_of({1: "a b"}), none)) == {1: (2, 0, 0, hashlib.sha256(b"").hexdigest(), False)}
    assert d.contamination(docs_of([]), none).count() == 0
    assert d.contamination(docs_of([(1, "a"), (1, "a"), (None, "a")]), none).count() == 2


def test_time_grows_with_the_words_of_one_text(spark, docs_of):
    from time import perf_counter

    bench = spark.createDataFrame([(1, " ".join(f"b{i}" for i in range(40)))], "item_id long, text string")
    took = {}
    for n in (1_000, 160_000, 320_000):
        body = " ".join(f"w{i % 977}x{i % 1009}" for i in range(n)) + " " + " ".join(f"b{i}" for i in range(30))
        start = perf_counter()
        row = d.contamination(docs_of({1: body}), bench).first()
        took[n] = perf_counter() - start
        assert (row.n_words, row.n_hit, row.n_items) == (n + 30, 30, 1)
    assert took[320_000] < 3 * took[160_000]


def test_no_python_in_the_plan(spark, docs_of):
    plan = d.contamination(docs_of({1: "a"}), spark.createDataFrame([(1, "a")], "item_id long, text string"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text and "Cartesian" not in text
