"""Held-out accuracy of the two classifiers, and their defined results."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from panelspark.llm.common import table
from panelspark.llm.quality import CUT, fit_ranking, learn_quality, score_quality, shape, with_quality
from panelspark.llm.toxicity import fit_nnpu, learn_toxicity, parts_of, score_toxicity, with_toxicity, without_toxic

WEIRD = [(None, "no id"), (1, None), (2, ""), (3, "word " * 20000), (4, "same"), (4, "same")]


def test_ranking_orders_by_the_planted_feature():
    draw = np.random.default_rng(1)
    x = np.abs(draw.normal(1, 0.3, (400, len(shape("")))))
    label = (x[:, 6] < 1).astype(int)
    score = fit_ranking(x, label).scores(x)
    assert ((score >= CUT) == (label == 1)).mean() > 0.95
    assert score.min() >= 0 and score.max() <= 1


def test_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    labels = table(spark, folder, "labels")
    got = score_quality(table(spark, folder, "documents"), labels).join(labels, "doc_id").where("held_out")
    right = got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert right > 0.95


def test_quality_defined_results(docs_of, labels_of):
    empty = labels_of([])
    got = score_quality(docs_of(WEIRD), empty).collect()
    assert len(got) == len(WEIRD)
    assert {round(r.score, 9) for r in got} == {CUT}  # nothing learnt: the cut itself
    assert score_quality(docs_of([]), empty).count() == 0
    one_class = learn_quality(docs_of({1: "a"}), labels_of([(1, 1, 0), (1, None, 0), (None, 1, 1)]))
    assert with_quality(docs_of({1: "a"}), one_class).columns == ["doc_id", "text", "lang", "n_chars", "score", "predicted"]


def test_nnpu_finds_the_positive_direction():
    draw = np.random.default_rng(2)
    pos, neg = draw.poisson(2, (300, 5)).astype(float), draw.poisson(2, (1700, 5)).astype(float)
    pos[:, 0] += 8
    w, b = fit_nnpu(pos[:150], np.vstack([neg, pos[150:]]), 0.1)
    assert (pos @ w + b > 0).mean() > 0.8 and (neg @ w + b > 0).mean() < 0.1


def test_toxic_words_and_beginnings(docs_of, labels_of):
    clean = {i: f"plain text number {'abc'[i % 3]} of the lot" for i in range(400)}
    toxic = {i: f"plain text {'scumbag' if i % 2 else 'loweich'} of the lot" for i in range(400, 520)}
    labels = labels_of([(i, 1, int(i >= 400)) for i in range(520)])
    docs = docs_of(clean | toxic)
    got = {r.doc_id: r for r in score_toxicity(docs, labels).collect()}
    assert all(got[i].predicted == 1 for i in toxic) and not any(got[i].predicted for i in clean)
    kept = without_toxic(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(clean)
    assert parts_of("ab") == ["ab$"]


def test_toxicity_defined_results(docs_of, labels_of):
    got = score_toxicity(docs_of(WEIRD), labels_of([]))
    assert got.count() == len(WEIRD) and got.where("predicted = 1 or score < 0 or score > 1").isEmpty()
    model = learn_toxicity(docs_of([]), labels_of([]))
    assert with_toxicity(docs_of([]), model).count() == 0
    assert without_toxic(docs_of(WEIRD), labels_of([])).count() == len(WEIRD)
