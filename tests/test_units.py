"""Units cut in batches, against the columns that say the same, and what is done once only."""

import math

import numpy as np
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.functions import units as U
from leafmill.operators import chunks as C
from leafmill.operators import embed as E
from leafmill.operators import lexical as L

TEXTS = ["INTRODUCTION\nOne. Two!  Three? four\n\n a", "", " \n1.2 Scope of x\n٣ zwei\nABCDE F\nAB CD EF:\nx:", "a.b. c!? d. e ...", "½ a_b ê ()[]{}\n:::\nÄÖÜABCDEF\nABCDEF ß", "e" * 80 + ":\n" + "e" * 79 + ":", "1. \n1.2\n1 2 3. 4", "日本。 x. \x1cy"]


def test_batches_cut_as_columns(spark):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(TEXTS)], "i int, text string")
    units = F.transform(T.units(F.col("text")), lambda x: F.struct(x.alias("x"), T.token_count(x).alias("n")))
    want = [[(u.x, u.n) for u in r.u] for r in rows.select("i", units.alias("u")).orderBy("i").collect()]
    normal = [r.x for r in rows.select("i", T.normalized(F.col("text")).alias("x")).orderBy("i").collect()]
    cut = [U.units(x) for x in normal]
    assert [list(zip(x, L.token_counts(x).tolist(), strict=True)) for x in cut] == want
    lines = [x for text in normal for x in U.lines(text)]
    marked = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, x string").select("i", T.is_heading(F.col("x")).alias("h"))
    assert [r.h for r in marked.orderBy("i").collect()] == [U.is_heading(x) for x in lines]


def test_units_of_a_page_are_compared_once(spark):
    asked = spark.sparkContext.accumulator(0)

    def similarity(before, text):
        asked.add(1)
        return 1.0

    pages = spark.createDataFrame([("a", i, "One here. Two here. Three here. Four here.") for i in range(40)], "doc_key string, page bigint, text string")
    assert C.semantic(pages, 10, 4, similarity=similarity).count() > 1
    assert asked.value <= 40 * 3 + 2 * 40


def test_vectors_are_not_passed_on(spark):
    pages = spark.createDataFrame([("a", 1, "One here. Two here.")], "doc_key string, page bigint, text string")
    assert "array<double>" not in str(C.semantic(pages, embedder=E.hashed(8))._jdf.queryExecution().analyzed().toString()) and "ArrowEvalPython" not in C.semantic(pages, embedder=E.hashed(8))._jdf.queryExecution().executedPlan().toString()


def test_batches_are_alike_as_pairs():
    texts = ["One two two", "two ONE Σας", "σαΣ x", "", "x", "x x x y", "Two  three"]
    first = [True, False, False, False, False, False, True]
    got = C._cosines(texts, np.array(first)).tolist()
    assert [None if math.isnan(x) else x for x in got] == [None if f else C.term_cosine(texts[i - 1], x) for i, (f, x) in enumerate(zip(first, texts, strict=True))]


def test_rows_that_repeat_a_page_are_one_page(spark):
    pages = spark.createDataFrame([("a", 1, "x y\nHead:\nz"), ("a", 1, "v w"), ("a", 2, "(u")], "doc_key string, page bigint, text string")
    rows = C._page_lines(pages).orderBy("page", "line").collect()
    assert [(r.page, r.text, r.t, r.n, r.k, r.u, r.h) for r in rows] == [(1, None, "v\nw", 2, 0, 0, None), (1, None, "x\ny", 2, 0, 2, None), (1, "Head:", "", 0, 1, 4, 4), (1, None, "z", 1, 1, 4, 4), (2, None, "(\nu", 2, 0, 0, None)]


def test_lexical_trees_leave_parents_alone(spark):
    """They were made and fitted to for nothing."""
    from leafmill.plans import retrieval as P

    children = spark.createDataFrame([(f"d{i}", "p", f"word{i} other") for i in range(4)], "doc string, parent string, text string")
    questions = spark.createDataFrame([(1, "word2")], "qid bigint, text string")
    broken = spark.range(1).select(F.raise_error(F.lit("read")).cast("string").alias("doc"), F.lit("x").alias("text"))
    assert P.tree_rankings(broken, children, questions, kind="bm25").first().doc == "d2"
