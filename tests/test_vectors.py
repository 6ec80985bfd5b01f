"""Embedders, the vector store, and what generators measure."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.operators import embed as E
from leafmill.operators import generation as G
from leafmill.operators import metrics as M
from leafmill.operators import retrieval as R
from leafmill.operators import store as VS


def vectors(n, seed=1, dim=8):
    draw = random.Random(seed)
    return [(i, [draw.gauss(i % 5, 0.4) if j == i % 5 else draw.gauss(0, 0.4) for j in range(dim)]) for i in range(n)]


@pytest.fixture(scope="module")
def rows():
    return vectors(300)


def brute(rows, queries, k, how="cosine"):
    out = {}
    for qid, q in queries:
        norm = lambda x: math.sqrt(sum(a * a for a in x)) or 1.0
        score = lambda v: sum(a * b for a, b in zip(q, v)) / (norm(q) * norm(v) if how == "cosine" else 1.0)  # noqa: E731, B023
        out[qid] = [d for d, _ in sorted(((d, round(score(v), 9)) for d, v in rows), key=lambda x: (-x[1], x[0]))[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("qid", "rank").collect():
        out.setdefault(r.qid, []).append(r.doc)
    return out


def frames(spark, rows, queries):
    return spark.createDataFrame(rows, "doc bigint, vec array<double>"), spark.createDataFrame(queries, "qid bigint, vec array<double>")


@pytest.mark.parametrize("how", ["cosine", "dot"])
@pytest.mark.parametrize("lists", [0, 7])
def test_store_is_exact_when_all_cells_are_probed(spark, rows, how, lists):
    docs, queries = frames(spark, rows, rows[::30])
    store = VS.VectorStore.ingest(docs, how, lists)
    assert found(store.query(queries, 6, probes=lists, block=16)) == brute(rows, rows[::30], 6, how)


def test_few_probes_find_most(spark, rows):
    docs, queries = frames(spark, rows, rows[::30])
    got, want = found(VS.VectorStore.ingest(docs, lists=10).query(queries, 10, probes=4)), brute(rows, rows[::30], 10)
    assert np.mean([len(set(got[q]) & set(want[q])) / 10 for q in want]) >= 0.9


def test_a_crowded_cell_is_cut_and_nothing_lost(spark):
    same = [(i, [1.0, 0.0]) for i in range(200)] + [(200, [0.0, 1.0])]
    docs, queries = frames(spark, same, [(0, [1.0, 0.0])])
    assert found(VS.VectorStore.ingest(docs, lists=2).query(queries, 150, probes=1, block=8))[0] == list(range(150))


@pytest.mark.parametrize("lists", [0, 5])
def test_upsert_save_and_load(spark, rows, lists, tmp_path):
    docs, queries = frames(spark, rows, rows[::50])
    new = [(3, [9.0] * 8), (1000, [0.5] * 8)]
    store = VS.VectorStore.ingest(docs, lists=lists).upsert(frames(spark, new, [])[0])
    store.save(str(tmp_path / "store"))
    again = VS.VectorStore.load(spark, str(tmp_path / "store"))
    changed = [r for r in rows if r[0] != 3] + new
    assert found(again.query(queries, 5, probes=5)) == brute(changed, rows[::50], 5)
    with pytest.raises(Exception, match="exist"):
        store.save(str(tmp_path / "store"))


def test_store_of_nothing_nulls_and_repeats(spark):
    docs, queries = frames(spark, [], [(1, [1.0, 0.0])])
    assert VS.VectorStore.ingest(docs, lists=4).query(queries, 3).count() == 0
    docs, _ = frames(spark, [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (None, [1.0, 1.0]), (2, None), (3, [0.0, 0.0])], [])
    assert found(VS.VectorStore.ingest(docs, lists=4).query(queries, 3, probes=4)) == {1: [1, 3]}


def test_numbers_may_be_texts(spark):
    docs = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 1.0])], "doc string, vec array<double>")
    asked = spark.createDataFrame([("q", [1.0, 0.0])], "qid string, vec array<double>")
    assert found(R.nearest(asked, docs, 3)) == {"q": ["a", "b", "c"]}


def test_hashed_embedder(spark):
    a, b, none = E.hashed(32)()(["The cat, the CAT", "cat the cat the", "?!"])
    assert np.allclose(a, b) and abs(np.linalg.norm(a) - 1) < 1e-12 and not none.any()
    texts = spark.createDataFrame([(1, "the cat"), (2, None), (3, "")], "id int, text string")
    got = {r.id: r.v for r in texts.select("id", E.embedded(F.col("text"), E.hashed(32)).alias("v")).collect()}
    assert got[1] == E.hashed(32)()(["the cat"])[0].tolist() and not any(got[2]) and not any(got[3])


def test_registry(monkeypatch):
    assert E.build(None) is None and E.build({"type": "TFIDF"}) is None
    assert E.build({"type": "hashed", "dim": 4})()(["x"]).shape == (1, 4)
    monkeypatch.setattr(E, "MAKERS", dict(E.MAKERS))
    for config in ({"type": "other"}, {"type": "sbert"}):
        with pytest.raises(ValueError, match="no embedder"):
            E.build(config)
    with pytest.raises(ValueError, match="TF-IDF"):
        E.for_boundaries({"semantic_embedder": {"type": "tfidf"}})
    E.register("sentence_transformers", lambda **keys: keys)
    assert E.build({"type": "ST", "model": "m", "batch_size": 8}) == {"model": "m", "batch_size": 8}
    assert E.for_boundaries({}, {"type": "tfidf", "model": "x"}) == {} and E.for_boundaries({}, {"type": "sbert", "model": "y"}) == {"model": "y"}
    assert E.for_boundaries({"semantic_embedder": {"type": "st", "model": "z"}}, {"type": "sbert"}) == {"model": "z"}


def test_payloads_are_measured_after_warm_up(spark):
    def make():
        asked = []

        def answer(prompts):
            asked.extend(prompts)
            if prompts == ["bad"]:
                raise RuntimeError("no")
            return [{"response": f"{prompts[0]} {len(asked)}", "total_duration": 2_000_000_000, "eval_duration": 500_000_000, "eval_count": 10, "prompt_eval_count": 3}]

        return answer

    prompts = spark.createDataFrame([("1", "a")], "id string, prompt string").coalesce(1)
    (r,) = G.bench(prompts, {"m": make}, repeats=1, warmup=1).collect()
    assert r.error is None
    assert (r.text, r.total_s, r.eval_s, r.load_s, r.prompt_tokens, r.tokens, r.tokens_per_s, r.ok) == ("a 2", 2.0, 0.5, -1.0, 3, 10, 20.0, True)
    (bad,) = G.bench(prompts.withColumn("prompt", F.lit("bad")), {"m": make}, repeats=1, warmup=1).collect()
    assert not bad.ok and bad.text is None and "no" in bad.error and bad.tokens_per_s == -1.0


def test_tokens_by_nearest_rank(spark):
    answers = spark.createDataFrame([("v", False, [1], [1], [1], t) for t in range(1, 12)], "variant string, not_found boolean, cited array<bigint>, context_pages array<bigint>, expected_pages array<bigint>, tokens int")
    assert [(r.p50_tokens, r.p95_tokens) for r in M.answer_metrics(answers, "variant").collect()] == [(6.0, 11)]
    (none,) = M.answer_metrics(answers.where("false")).collect()
    assert none.n == 0 and none.p95_tokens == -1
