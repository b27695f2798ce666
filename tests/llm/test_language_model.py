from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from panelspark.llm import attention_lm as a
from panelspark.llm.common import table


def base(texts):
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    words = {i: [*(t or "").encode().lower().split(), None] for i, t in texts.items()}
    seen = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    total, kinds = sum(seen.values()), len(seen)
    low = total + 0.1 * (kinds + 1)
    return {
        i: (held[i], len(ws), sum(w in seen for w in ws), total, sum(math.log10((seen[w] + 0.1) / low) for w in ws))
        for i, ws in words.items()
    }


@pytest.mark.parametrize("frequent", [200_000, 50])
def test_base_equals_brute_force(spark, docs_of, monkeypatch, frequent):
    monkeypatch.setattr(a, "FREQUENT", frequent)
    texts = {r.doc_id: r.text for r in table(spark, "/root/testdata/sf0.001", "documents").collect()}
    texts |= {1000: None, 1001: "", 1003: "new" * 5000, 1004: "ÄB\x0bä  The"}
    got = a.score_texts(docs_of(texts)).collect()
    want = base(texts)
    assert len(got) == len(texts)
    for r in got:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
        assert r.base_score == pytest.approx(want[r.doc_id][4], rel=1e-9)
        assert math.isfinite(r.score) and r.score <= 0


def test_rare_words_keep_their_share(spark, docs_of, monkeypatch):
    texts = {r.doc_id: r.text for r in table(spark, "/root/testdata/sf0.001", "documents").limit(60).collect()}
    docs = docs_of(texts | {1000: None, 1001: "never seen words " * 40}).coalesce(1)
    scores = []
    for frequent in (200_000, 50):
        monkeypatch.setattr(a, "FREQUENT", frequent)
        scores.append({r.doc_id: r.score for r in a.score_texts(docs).collect()})
    assert scores[1] == pytest.approx(scores[0], rel=1e-6)


def small_model():
    draw = np.random.default_rng(0)
    starts = np.arange(40) % 3 == 0
    row, group, inside = a.grouped(draw.integers(0, 50, 40).astype(float), starts)
    classes, rows = int(group.max()) + 1, int(row.max()) + 1
    begins = np.zeros(classes, np.float32)
    begins[group[:-2][starts]] = begins[-1] = 1
    weights = {k: v + draw.normal(0, 0.3, v.shape).astype(np.float32) for k, v in a.fresh_weights(rows, classes).items()}
    return a.Model(row, group, inside, draw.normal(0, 1, (rows, classes)).astype(np.float32), weights, begins)


def test_windows_score_each_id_once():
    for size in (1, 23, 24, 25, 100):
        keys, valid = a.windows(size)
        asked = keys[:, a.CONTEXT :][valid[:, a.CONTEXT :]]
        assert sorted(asked.tolist()) == list(range(size))


def test_rounds_train_on_every_window_of_every_text(monkeypatch):
    asked = []
    monkeypatch.setattr(a.Trainer, "learn", lambda self: None)
    for size in (1, 24, 25, 200):
        for phase in range(a.STRIDE):
            trainer = a.Trainer(small_model())
            for number in range(a.ROUNDS):
                trainer.add(np.append(np.arange(size - 1) % 40, trainer.model.end), a.phase_of(phase, number))
            asked.append((size, sum(int(valid[:, a.CONTEXT :].sum()) for _, valid, _ in trainer.waiting)))
    assert all(size == seen for size, seen in asked)


def test_attention_is_causal_and_batches_agree():
    model, draw = small_model(), np.random.default_rng(1)
    ids = np.append(draw.integers(0, 40, 90), model.end)
    out, _ = a.log_chances(model, ids, np.array([91]))
    changed = ids.copy()
    changed[60] = (changed[60] + 1) % 40
    again, _ = a.log_chances(model, changed, np.array([91]))
    assert np.allclose(out[:60], again[:60], atol=1e-5) and not np.allclose(out[60:], again[60:])
    both, _ = a.log_chances(model, np.concatenate([changed, ids]), np.array([91, 91]))
    assert np.allclose(both, np.concatenate([again, out]), atol=1e-5)


def test_gradient_is_the_slope_of_the_loss():
    model, draw = small_model(), np.random.default_rng(2)
    model.weights = {k: v.astype(float) for k, v in model.weights.items()}
    ids = np.append(draw.integers(0, 40, 70), model.end)
    keys, valid = a.windows(len(ids))
    rows = model.row[np.concatenate([[model.end + 1], ids[:-1]])][keys]
    target = model.group[ids][keys[:, a.CONTEXT :]]

    def loss():
        out, _ = a.log_chances(model, ids, np.array([len(ids)]))
        return -(out - model.inside[ids]).mean()

    grads = a.gradient(model, rows, valid, target)
    for name, at in (("query", (1, 2)), ("key", (0, 3)), ("value", (2, 2)), ("out", (3, 1)), ("near", (4,)), ("embed", (rows[0, -1], 5))):
        w = model.weights[name]
        w[at] += 1e-3
        up = loss()
        w[at] -= 2e-3
        down = loss()
        w[at] += 1e-3
        assert grads[name][at] == pytest.approx((up - down) / 2e-3, abs=2e-4)


def test_no_training_texts(docs_of):
    held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    (got,) = a.score_texts(docs_of({held: "a b"})).collect()
    assert (got.n_tokens, got.n_known, got.train_tokens, got.base_score) == (3, 0, 0, 0.0) and got.score < 0
    assert a.score_texts(docs_of([])).count() == 0


def test_model_sizes_are_not_cut():
    assert a.SINGLES >= 240 and a.QUERIES >= 32 and a.CONTEXT >= 16


def test_chances_of_all_classes_sum_to_one():
    model, draw = small_model(), np.random.default_rng(3)
    ids = np.append(draw.integers(0, 40, 50), model.end)
    total = 0.0
    for c in range(model.bigram.shape[1]):
        group = model.group.copy()
        group[model.end] = c
        out, edge = a.log_chances(a.replace(model, group=group), ids, np.array([51]))
        total += math.exp(out[-1]) * (model.begins[c] > 0)
    assert total == pytest.approx(math.exp(edge[-1]), rel=1e-4) and 0 < total < 1


def test_an_id_costs_the_classes_of_its_kind_alone(monkeypatch):
    model, draw, done, exp = small_model(), np.random.default_rng(4), [], np.exp
    ids = np.append(draw.integers(0, 40, 700), model.end)
    keys, valid = a.windows(len(ids))
    rows = model.row[np.concatenate([[model.end + 1], ids[:-1]])][keys]
    most = valid[:, a.CONTEXT :].size * (a.QUERIES + a.CONTEXT) + 2 * len(ids)
    starts = model.begins[model.group[ids]] > 0
    most += int(np.where(starts, (model.begins > 0).sum(), (model.begins == 0).sum()).sum())
    monkeypatch.setattr(np, "exp", lambda x, **more: (done.append(np.size(x)), exp(x, **more))[1])
    a.gradient(model, rows, valid, model.group[ids][keys[:, a.CONTEXT :]])
    assert sum(done) <= most
    done.clear()
    a.log_chances(model, ids, np.array([len(ids)]))
    assert sum(done) <= most


@pytest.mark.parametrize("size", [1, 31, 32, 33, 64, 65, 300])
def test_training_takes_the_windows_of_scoring(monkeypatch, size):
    monkeypatch.setattr(a.Trainer, "learn", lambda self: None)
    model = small_model()
    ids = np.append(np.random.default_rng(size).integers(0, 40, size - 1), model.end)
    keys, valid = a.windows(size)
    for phase in range(a.STRIDE):
        trainer = a.Trainer(model)
        trainer.add(ids, phase)
        want, ok = model.row[np.concatenate([[model.end + 1], ids[:-1]])][keys[phase :: a.STRIDE]], valid[phase :: a.STRIDE]
        for rows, seen, target in trainer.waiting:
            assert (seen == ok).all() and (rows[ok] == want[ok]).all()
            asked = ok[:, a.CONTEXT :]
            assert (target[asked] == model.group[ids][keys[phase :: a.STRIDE, a.CONTEXT :]][asked]).all()
        assert len(trainer.waiting) == (len(ok) > 0)


def test_words_of_letters_are_one_piece():
    import base64

    import public_tokenizers
    import tiktoken

    path = a.tokenizer_path()
    with open(path, "rb") as file:
        ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, file)}
    model = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for word in ("the", "zqxv", "don't", "12ab", "a" * 300, "äöü", "x y", "s", "--"):
        assert np.frombuffer(a.subwords(path)[word.encode()], "<u2").tolist() == model.encode_ordinary(" " + word)
