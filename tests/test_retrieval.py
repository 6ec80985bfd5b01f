import math
import random
import re
from collections import Counter

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafmill.functions import noise as N
from leafmill.functions import text as T
from leafmill.operators import generation as G
from leafmill.operators import graph
from leafmill.operators import lexical as L
from leafmill.operators import metrics as M
from leafmill.operators import retrieval as R
from leafmill.plans import retrieval as P

DOCS = ["The cat sat. The dog!", "A dog ran, a dog hid", "Café the bird", "the the the end", ""]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(DOCS)], "doc string, text string")


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(1, "The dog the dog"), (2, "cafe bird"), (3, "unseen")], "qid bigint, text string")


def scores(df):
    return {(r.qid, r.doc): r.score for r in df.collect()}


def test_bm25(docs, queries):
    tokens = [re.findall(r"\w+|[^\w\s]", t) for t in DOCS]
    mean = sum(map(len, tokens)) / len(tokens)
    df = Counter(w for t in tokens for w in set(t))
    raw = {w: math.log(len(DOCS) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    want = {}
    for q, text in ((1, "The dog the dog"), (2, "cafe bird"), (3, "unseen")):
        for i, t in enumerate(tokens):
            tf = Counter(t)
            hits = [w for w in re.findall(r"\w+", text) if w in tf]
            if hits:
                want[q, f"d{i}"] = sum((raw[w] if raw[w] >= 0 else floor) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(t) / mean)) for w in hits)
    assert scores(L.Bm25(docs).scores(queries)) == pytest.approx(want)


def grams(text):
    words = re.findall(r"\w\w+", text.lower().replace("é", "e"))
    return words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


@pytest.mark.parametrize("most", [60_000, 3])
def test_tfidf(docs, queries, most):
    counts = [Counter(grams(t)) for t in DOCS]
    total = sum(counts, Counter())
    kept = sorted(total, key=lambda g: (-total[g], g))[:most]
    idf = {g: math.log((1 + len(DOCS)) / (1 + sum(g in c for c in counts))) + 1 for g in kept}

    def unit(c):
        v = {g: n * idf[g] for g, n in c.items() if g in idf}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {g: x / norm for g, x in v.items()}

    want = {}
    for q, text in ((1, "The dog the dog"), (2, "cafe bird"), (3, "unseen")):
        a = unit(Counter(grams(text)))
        for i, c in enumerate(counts):
            b = unit(c)
            if a.keys() & b.keys():
                want[q, f"d{i}"] = sum(a[g] * b[g] for g in a.keys() & b.keys())
    assert scores(L.TfIdf(docs, most).scores(queries)) == pytest.approx(want)


def test_accents(spark):
    assert spark.range(1).select(L.unaccented(F.lit("ÀÉîõÜ ß é ø"))).first()[0] == "aeiou ß e ø"


def test_top_k_fills_with_zeros(docs, queries):
    best = R.top_k(R.with_zeros(L.Bm25(docs).scores(queries), queries, docs, 3), 3)
    rows = {(r.qid, r.rank): (r.doc, round(r.score, 9)) for r in best.collect()}
    assert len(rows) == 9 and [rows[3, k] for k in (1, 2, 3)] == [("d0", 0), ("d1", 0), ("d2", 0)]


def test_minmax(spark):
    rows = spark.createDataFrame([(1, 2.0), (1, 2.0), (2, 0.0), (2, 1.0), (2, 3.0)], "q int, x double")
    assert sorted(tuple(r) for r in rows.select("q", R.minmax(F.col("x"), "q").alias("y")).collect()) == [(1, 1.0), (1, 1.0), (2, 0.0), (2, pytest.approx(1 / 3)), (2, 1.0)]


def test_hybrid(spark):
    dense = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.5), (1, "c", 0.1)], "qid int, doc string, score double")
    lexical = spark.createDataFrame([(1, "a", 0.0), (1, "b", 4.0), (1, "c", 1.0), (1, "e", 2.0)], "qid int, doc string, score double")
    got = scores(R.hybrid(dense, lexical))
    assert got == pytest.approx({(1, "a"): 0.5, (1, "b"): 0.5 * 5 / 9 + 0.5, (1, "c"): 0.5 / 9 + 0.125, (1, "e"): 0.25})


def test_parents(spark):
    children = spark.createDataFrame([("a1", "a"), ("a2", "a"), ("b1", "b")], "doc string, parent string")
    parents = spark.createDataFrame([(1, "a"), (2, "zz")], "qid int, parent string")
    got = R.pairs_within(spark.createDataFrame([(1,), (2,)], "qid int"), children, parents)
    assert sorted(tuple(r) for r in got.collect()) == [(1, "a1"), (1, "a2"), (2, "a1"), (2, "a2"), (2, "b1")]


def test_rerank(spark):
    pairs = spark.createDataFrame([(1, "a", "red fox", "a red hen"), (1, "b", "red fox", "Red FOX"), (1, "c", "red fox", "")], "qid int, doc string, question string, text string")
    assert [(r.doc, r.score) for r in R.rerank(pairs, 2).orderBy("rank").collect()] == [("b", 1.0), ("a", 0.5)]

    def by_length():
        return lambda q, t: pd.Series([float(len(x)) for x in t])

    assert [r.doc for r in R.rerank(pairs, 1, by_length).collect()] == ["a"]


def test_agreement(spark):
    frame = lambda docs: spark.createDataFrame([(1, d) for d in docs], "qid int, doc int")
    assert R.agreement(frame([1, 2, 3]), frame([3, 9, 1]), 3).first().agreement == pytest.approx(2 / 3)
    assert R.agreement(frame([1]), frame([1]), 0).first().agreement == 0


@pytest.fixture(scope="module")
def vectors(spark):
    rng = random.Random(0)
    return spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(40)], "doc bigint, vec array<float>")


def test_knn_in_blocks(vectors):
    rows = {(r.src, r.nbr_rank): r.dst for r in graph.knn(vectors, 5).collect()}
    assert rows == {(r.src, r.nbr_rank): r.dst for r in graph.knn(vectors, 5, cell_rows=9, block_rows=4).collect()} and len(rows) == 200
    vec = {r.doc: r.vec for r in vectors.collect()}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    want = sorted((d for d in vec if d != 7), key=lambda d: -cos(vec[7], vec[d]))[:5]
    assert [rows[7, k] for k in range(1, 6)] == want


def test_expansion(spark):
    edges = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (1, 3, 1), (3, 0, 1), (2, 4, 1)], "src bigint, dst bigint, nbr_rank int")
    seeds = spark.createDataFrame([(1, 0)], "qid int, doc bigint")
    hops = lambda n, e: {r.doc: r.hop for r in graph.expand(seeds, edges, n, e).collect()}
    assert hops(1, 1) == {0: 0, 1: 1} and hops(2, 0) == {0: 0, 1: 1, 2: 1, 3: 2, 4: 2} and hops(0, 0) == {0: 0}


def test_graph_rerank(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "doc bigint, vec array<float>")
    q = spark.createDataFrame([(1, [1.0, 1.0])], "qid int, vec array<float>")
    one = spark.createDataFrame([(1, 0)], "qid int, doc bigint")
    cand = spark.createDataFrame([(1, 0, 0), (1, 1, 1)], "qid int, doc bigint, hop int")
    got = scores(graph.rerank(cand, one, q, v, 0.25))
    assert got == pytest.approx({(1, 0): 0.75 * math.sqrt(0.5), (1, 1): 0.75 * math.sqrt(0.5) + 0.25 * 0.075})


def test_metrics(spark):
    frame = lambda *x: spark.createDataFrame([(v,) for v in x], "first_rank int")
    got = M.ranking_metrics(frame(1, 4, None)).first()
    assert tuple(got) == (3, pytest.approx(1 / 3), pytest.approx(1 / 3), pytest.approx(2 / 3), pytest.approx(1.25 / 3), 2.5)
    assert tuple(M.ranking_metrics(frame(None)).first()) == (1, 0, 0, 0, 0, math.inf)
    assert tuple(M.ranking_metrics(frame()).first()) == (0, 0, 0, 0, 0, math.inf)
    d = M.deltas(M.ranking_metrics(frame(None)), M.ranking_metrics(frame(1))).first()
    assert tuple(d) == (1, 1, 1, 1)


def test_percentiles(spark):
    rows = spark.createDataFrame([(float(x),) for x in (1, 2, 10)], "x double")
    got = rows.agg(M.percentile("x", 95), M.median_or("x"), M.mean_or("x")).first()
    assert tuple(got) == (pytest.approx(9.2), 2, pytest.approx(13 / 3))
    none = rows.where("x > 99").agg(M.percentile("x", 95), M.median_or("x"), M.mean_or("x")).first()
    assert math.isnan(none[0]) and none[1:] == (-1, -1)
    ten = spark.createDataFrame([(float(x), "g") for x in range(1, 11)], "x double, g string")
    assert M.nearest_rank(ten, "x", 0.95, "g").first().value == 10


def test_answer_metrics(spark):
    kinds = "not_found boolean, cited array<int>, context_pages array<int>, expected_pages array<int>, tokens int"
    rows = spark.createDataFrame([(False, [1, 9], [1, 2], [1], 10), (False, [2], [2], None, 20), (True, [], [1], [5], 0)], kinds)
    got = M.answer_metrics(rows).first()
    assert (got.n, got.non_empty_rate, got.cites_rate, got.hallucination_rate, got.expected_page_hit_rate, got.p50_tokens) == (3, pytest.approx(2 / 3), pytest.approx(2 / 3), 0.5, 0.5, 10)


def test_gold(spark):
    from leafmill.sources import readers

    answers = [("p1", '{"a": [1, 2], "b": 3}'), ("p2", "no json, values 4 and 5"), ("p3", "anything"), ("p4", "{broken")]
    gold = [("p1", ["a"], ["zzz"], [r"\d+"], True, ["a", "c"], {"a": 2}, [1, 2, 3], 0.5), ("p2", ["VALUES"], None, ["("], None, None, None, [4, 5], None), ("p4", None, ["broken"], None, True, ["k"], None, None, None)]
    scored = G.gold_scores(spark.createDataFrame(answers, "id string, text string"), spark.createDataFrame(gold, readers.GOLD))
    rows = {r.id: (r.checks, r.quality, r.passed) for r in scored.collect()}
    assert rows == {"p1": (8, 0.875, True), "p2": (3, pytest.approx(2 / 3), False), "p3": (0, -1.0, False), "p4": (3, 0.0, False)}


def test_generators(spark):
    asked = spark.createDataFrame([("p1", "[p3-p4] x"), ("p2", "boom"), ("p3", None)], "id string, prompt string")

    def broken():
        def answer(prompts):
            if "boom" in prompts[0]:
                raise RuntimeError("no")
            return G.stub()(prompts)

        return answer

    rows = G.bench(asked, {"m": broken}, 2).collect()
    assert len(rows) == 6 and {r.id: (r.ok, r.text) for r in rows} == {"p1": (True, "See the passage. [p3]"), "p2": (False, None), "p3": (True, "NOT_FOUND")}
    with pytest.raises(ValueError, match="v1"):
        G.http("http://x/v1", "m")


def test_verify_and_repair(spark):
    rows = spark.createDataFrame([("q", "good [p1]"), ("q", "bad"), ("q", "mend")], "prompt string, answer string")

    def checker():
        def say(prompt):
            answer = prompt.rpartition("Answer:\n")[2]
            return "no json" if answer == "bad" else '{"supported": false, "fix": "mended [p2]"}' if answer == "mend" else '{"supported": true}'

        return lambda prompts: [say(p) for p in prompts]

    got = G.verified(rows, checker, lambda: lambda prompts: ["again [p9]" for _ in prompts], keep=lambda df: df.persist())
    assert {(r.answer, r.supported, r.attempts) for r in got.collect()} == {("good [p1]", True, 1), ("again [p9]", True, 2), ("mended [p2]", True, 2)}


def test_evaluation(spark):
    pages = spark.createDataFrame([("d", i, f"page {i} speaks of topic{i} and of nothing else") for i in range(1, 7)], "doc_key string, page bigint, text string")
    questions = spark.createDataFrame([(i, f"topic{i} and of nothing") for i in range(1, 7)], "qid bigint, text string")
    for kind in ("dense", "bm25", "hybrid"):
        metrics, ranks = P.evaluate(pages, questions, {"strategy": "naive_tokens", "chunk_size": 50, "overlap": 0}, N.BASIC, {"type": kind}, k=3)
        assert metrics.first().hit_at_1 == 1.0, kind
        assert ranks.count() == 6


def test_expected_pages_by_automata(spark):
    pages = [(i, t) for i, t in enumerate(["the cat sat", "cat", "", None, "the the cat sat on", "Cät ☃ sat", "a.b*c"])]
    questions = [("q1", "cat"), ("q2", "the cat"), ("q3", ""), ("q4", None), ("q5", "ät ☃"), ("q6", "cat"), ("q7", "nowhere"), ("q8", ".b*"), ("q9", "at s")]
    want = sorted((q, p) for p, t in pages for q, x in questions if t is not None and x is not None and x in t)
    frames = spark.createDataFrame(pages, "page bigint, text string"), spark.createDataFrame(questions, "qid string, text string")
    for block in (1, 8, 1 << 20):
        assert sorted((r.qid, r.page) for r in P.expected_pages(*frames, block=block).collect()) == want
    assert P.expected_pages(frames[0], frames[1].limit(0)).collect() == [] and P.expected_pages(frames[0].limit(0), frames[1]).collect() == []
    plan = P.expected_pages(*frames)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan


def test_terms_are_cut_as_tokens(spark):
    """All characters of a batch at once, as the patterns cut each text."""
    texts = ["don't x_1, é²!", "", "日本 -", " \n", "a", "( ( x", "x\x1cy z", "𝒳y😀b", "_", "a b.c"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc int, text string")
    want = {r.doc: (r.t, r.w) for r in rows.select("doc", F.array_join(T.tokens(F.col("text")), "\n").alias("t"), F.array_join(F.regexp_extract_all("text", F.lit(rf"[{T.WORD}]{{2,}}"), F.lit(0)), "\n").alias("w")).collect()}
    got = L.listed(pa.array(texts)).to_pylist(), L.listed(pa.array(texts), 2).to_pylist()
    assert dict(enumerate(zip(*got, strict=True))) == want
    assert L.listed(pa.array([], pa.string())).to_pylist() == []


def test_counts_of_terms_leave_each_document_in_place(spark):
    """What is shuffled for a vocabulary are counts, and weights and scores of pairs need no shuffle of terms."""
    texts = ["a b a", "b c", "", "a b"]
    rows = spark.createDataFrame([("\n".join(t.split()),) for t in texts], "w string")
    counts = {r.term: (r.total, r.df) for r in L.counted(rows, pairs=True, rows=3).collect()}
    assert counts == {"a": (3, 2), "b": (3, 3), "c": (1, 1), "a b": (2, 2), "b a": (1, 1), "b c": (1, 1)}
    index = L.TfIdf(spark.createDataFrame([(i, t.replace("a", "aa").replace("b", "bb")) for i, t in enumerate(texts)], "doc int, text string"))
    plan = index.weights()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "MapInArrow" in plan


def test_counts_take_long_documents_in_parts(spark):
    """What is counted at a time is bounded by bytes, however long documents are, and a document is never cut."""
    texts = pa.array(["a\nb", "", None, "a\nb\na\nb", "c", "b\nc"])
    assert [x.to_pylist() for x in L._parts(texts, 10, 5)] == [["a\nb", "", None], ["a\nb\na\nb"], ["c", "b\nc"]]
    assert [len(x) for x in L._parts(texts, 2, 99)] == [2, 2, 2] and list(L._parts(texts.slice(0, 0), 2, 2)) == []
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), texts], names=["doc", "w"])
    assert [x.column(0).to_pylist() for x in L._slices(batch, "w", 10, 5)] == [[0, 1, 2], [3], [4, 5]]
    rng = random.Random(3)
    long = [" ".join(rng.choice(["w%d" % i for i in range(9)]) for _ in range(rng.randrange(40))) for _ in range(30)]
    rows = spark.createDataFrame([("\n".join(t.split()),) for t in long], "w string")
    want, df = Counter(), Counter()
    for t in long:
        w = t.split()
        both = w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]
        want.update(both)
        df.update(set(both))
    for most in (1, 200, 1 << 20):
        assert {r.term: (r.total, r.df) for r in L.counted(rows, True, 7, most).collect()} == {t: (n, df[t]) for t, n in want.items()}


def test_pieces_of_pages(spark):
    """As token_windows() has them; a page is cut into tokens once."""
    texts = ["", None, "a", "a b, c (d) e", " ".join("abcdefghijk"), "é 日本 x_1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc bigint, text string")
    for size, overlap in ((3, 1), (4, 4), (50, 10), (0, 0)):
        want = docs.select(F.col("doc").alias("page"), F.posexplode(T.token_windows(F.col("text"), size, overlap)).alias("sub", "text"))
        got = R.sub_chunks(docs, size, overlap)
        assert got.columns == want.columns and sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
        assert {r.k for r in R.sub_chunks(docs.withColumn("k", F.lit(7)), size, overlap).collect()} == {7}


def test_pairs_go_to_the_documents(spark):
    """Scores of given pairs shuffle no document, whatever the planner would send by itself."""
    docs = spark.createDataFrame([(i, "xx yy zz"[: i % 9]) for i in range(50)], "doc bigint, text string")
    queries = spark.createDataFrame([(1, "xx yy"), (2, "zz")], "qid bigint, text string")
    pairs = spark.createDataFrame([(1, 8), (2, 17), (2, 3)], "qid bigint, doc bigint")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for index in (L.TfIdf(docs), L.Bm25(docs)):
            found = index.scores_of(pairs, queries)
            lines = found._jdf.queryExecution().sparkPlan().toString().split("\n")
            under = "\n".join(lines[next(i for i, x in enumerate(lines) if "MapInArrow" in x) :])
            assert "BroadcastHashJoin" in under and "SortMergeJoin" not in under
            assert {(r.qid, r.doc): r.score > 0 for r in found.collect()} == {(1, 8): True, (2, 17): True, (2, 3): False}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_profiles_are_summed_where_weights_are_made(spark):
    """The same as over the rows of weights; documents without known grams have none."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*DOCS, "the", "!", "dog dog dog dog", None])], "doc int, text string")
    for most in (60_000, 4):
        index = L.TfIdf(docs, most)
        want = {r.doc: tuple(r)[1:] for r in index.weights().groupBy("doc").agg(F.count("*"), F.sum("weight"), F.max("weight")).collect()}
        got = {r.doc: tuple(r)[1:] for r in index.profiles().collect()}
        assert got.keys() == want.keys() and all(got[d] == pytest.approx(want[d]) for d in want) and 5 <= len(want) < 9


def test_best_keeps_ties_by_document(spark):
    """Documents that come late but earlier in order take the place of equals; only those are looked at."""
    docs = spark.createDataFrame([(f"d{i:04d}", "xx yy" if i % 3 else "zz") for i in reversed(range(2500))], "doc string, text string").coalesce(1)
    queries = spark.createDataFrame([(1, "xx"), (2, "none"), (3, "zz")], "qid bigint, text string")
    got = {q: [r.doc for r in R.top_k(L.Bm25(docs).best(queries, 4), 4).where(F.col("qid") == q).orderBy("rank").collect()] for q in (1, 2, 3)}
    assert got[2] == ["d0000", "d0001", "d0002", "d0003"] and got[3] == ["d0000", "d0003", "d0006", "d0009"]
    pairs = spark.createDataFrame([(1, "d0001"), (1, "d0000"), (9, "d0001"), (1, "none")], "qid bigint, doc string")
    got = {(r.qid, r.doc): r.score for r in L.TfIdf(docs).scores_of(pairs, queries).collect()}
    assert got.pop((1, "d0001")) == pytest.approx(3**-0.5) and set(got.values()) == {0.0} and len(got) == 3


def test_expansion_makes_only_the_edges_it_follows(spark):
    """The same as over the whole graph, also where cells and blocks are small."""
    r = random.Random(5)
    vectors = spark.createDataFrame([(i, [r.gauss(0, 1) for _ in range(5)]) for i in range(60)], "doc bigint, vec array<double>")
    seeds = spark.createDataFrame([(1, 3), (1, 8), (2, 59)], "qid bigint, doc bigint")
    rows = lambda df: sorted(tuple(x) for x in df.select("qid", "doc", "hop").collect())
    want = rows(graph.expand(seeds, graph.knn(vectors, 8), 2, 4))
    assert rows(graph.expand_from(seeds, vectors, 2, 4)) == want == rows(graph.expand_from(seeds, vectors, 2, 4, cell_rows=20, block_rows=10))
