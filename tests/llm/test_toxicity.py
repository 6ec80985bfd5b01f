import random
import tracemalloc
import zlib

import numpy as np
import pytest

from leafmill.llm import toxicity

from conftest import prose


@pytest.fixture(scope="module")
def labelled(spark):
    """Toxic texts have an insult and a group in them; either alone is fine, as only pairs tell."""
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(1500):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        text = f"{prose(rng, 25)} {'grumbly' if insult else ''} {prose(rng, 5)} {'gnomes' if group else ''}"
        docs.append((i, text))
        labels.append((i, 1, int(insult and group)))
    return docs, spark.createDataFrame(labels + [(None, 1, 1), (5000, 1, 1), (3, 1, None)], "doc_id bigint, quality int, toxic int")


def test_pairs_of_terms_are_learnt(frame, labelled, odd):
    docs, labels = labelled
    truth = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None}
    everything = frame([(i, t) for i, t in docs] + [(None if i is None else 9000 + i, t) for i, t in odd])
    machine = toxicity.train(everything, labels)
    rows = toxicity.scored(everything, machine).withColumn("held", toxicity.held_out()).collect()
    assert len(rows) == len(docs) + len(odd) and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.doc_id in truth and r.held]
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
    assert np.mean([(r.score >= 0.5) == truth[r.doc_id] for r in held]) > 0.95
    kept = toxicity.scored(everything, machine, below=0.5)
    assert kept.columns == everything.columns and kept.count() == sum(r.score < 0.5 for r in rows)
    empties = {r.score for r in rows if not (r.text or "").strip()}
    assert len(empties) == 1


def test_no_labels_and_one_kind(spark, frame):
    docs = frame([(i, "some words") for i in range(9)])
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert {r.score for r in toxicity.scored(docs, toxicity.train(docs, none)).collect()} == {0.5}
    clean = spark.createDataFrame([(i, 0) for i in range(9)], "doc_id bigint, toxic int")
    assert all(r.score < 0.2 for r in toxicity.scored(docs, toxicity.train(docs, clean)).collect())
    assert toxicity.scored(frame([]), toxicity.train(docs, clean)).collect() == []


def test_score_is_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    machine = toxicity.Machine(24, np.arange(5), 0.3, rng.normal(size=5), rng.normal(size=(5, 3)))
    own = [0, 2, 4]
    pairs = sum(machine.factors[a] @ machine.factors[b] for i, a in enumerate(own) for b in own[i + 1 :])
    raw = 0.3 + machine.weights[own].sum() + pairs
    assert np.isclose(machine.score(np.zeros(3, int), np.array(own), 1)[0], 1 / (1 + np.exp(-raw)))


def test_pairs_survive_the_choice_of_terms(spark, frame):
    """Toxic is what has both words or neither: neither tells anything alone, among thousands of others."""
    rng = random.Random(4)
    vocabulary = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "nu", "pe", "ra", "so", "ti", "vu", "ze") for b in "bdfgklmnprst" for c in ("an", "el", "ir", "os", "ut", "ay", "ew", "oy")]
    docs, labels = [], []
    for i in range(4000):
        one, two = rng.random() < 0.5, rng.random() < 0.5
        words = [rng.choice(vocabulary) for _ in range(60)] + ["quibbler"] * one + ["wexford"] * two
        rng.shuffle(words)
        docs.append((i, " ".join(words)))
        labels.append((i, int(one == two)))
    table = frame(docs)
    machine = toxicity.train(table, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    rows = toxicity.scored(table, machine).where(toxicity.held_out()).collect()
    assert np.mean([(r.score >= 0.5) == dict(labels)[r.doc_id] for r in rows]) > 0.95


def test_gradients_against_differences_of_the_loss():
    rng = np.random.default_rng(3)
    labels = (rng.random(30) < 0.4).astype(float)
    rows, columns = np.nonzero(rng.random((30, 8)) < 0.4)
    settings = toxicity.Settings(l2=0.01, l2_factors=0.02)
    machine = toxicity.Machine(24, np.arange(8), 0.2, rng.normal(size=8), rng.normal(size=(8, 6)))

    def loss(bias, weights, factors):
        p = toxicity.Machine(24, np.arange(8), bias, weights, factors).score(rows, columns, 30)
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p)) + 0.005 * (weights**2).sum() + 0.01 * (factors**2).sum()

    db, dw, dv = toxicity._gradients(machine, rows, columns, labels, settings)
    h = 1e-6
    assert np.isclose(db, (loss(0.2 + h, machine.weights, machine.factors) - loss(0.2 - h, machine.weights, machine.factors)) / (2 * h), atol=1e-6)
    for i in range(8):
        step = np.zeros(8)
        step[i] = h
        assert np.isclose(dw[i], (loss(0.2, machine.weights + step, machine.factors) - loss(0.2, machine.weights - step, machine.factors)) / (2 * h), atol=1e-6)
        for f in range(6):
            step = np.zeros((8, 6))
            step[i, f] = h
            assert np.isclose(dv[i, f], (loss(0.2, machine.weights, machine.factors + step) - loss(0.2, machine.weights, machine.factors - step)) / (2 * h), atol=1e-6)


def test_rows_are_bounded_even_if_doc_ids_repeat(spark, frame, monkeypatch):
    sizes = []
    real = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda labels, *rest: sizes.append(len(labels)) or real(labels, *rest))
    docs = frame([(1, f"text {k}") for k in range(200)] + [(2, "other")] * 100)
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)] * 20, "doc_id bigint, toxic int")
    toxicity.train(docs, labels, toxicity.Settings(sample=50))
    assert sizes == [50]


def test_the_fit_takes_little_of_the_drivers_memory():
    """A sample of full size: 6,000 texts of 400 terms, 20,000 in all."""
    rng = np.random.default_rng(6)
    labels = (rng.random(6000) < 0.2).astype(float)
    rows = np.repeat(np.arange(6000, dtype=np.int32), 400)
    buckets = (20_000 * rng.random(len(rows)) ** 2).astype(np.int32)
    tracemalloc.start()
    try:
        machine = toxicity.fit(labels, rows, buckets, toxicity.Settings(epochs=1))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(machine.buckets) >= 512 and most < 110 << 20
