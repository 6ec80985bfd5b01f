import random

import pytest
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators import chunks as C


def pages(spark, *texts, key="d"):
    return spark.createDataFrame([(key, i + 1, t) for i, t in enumerate(texts)], "doc_key string, page bigint, text string")


def got(chunks, *columns):
    return [tuple(r) for r in chunks.orderBy("doc_key", "ord").select(*columns).collect()]


def test_naive_keeps_tails(spark):
    text = " ".join("abcdefghij")
    rows = got(C.naive(pages(spark, text, "", None), 4, 2), "chunk_id", "text", "page_start")
    assert rows == [("p0001_n0000", "a b c d", 1), ("p0001_n0001", "c d e f", 1), ("p0001_n0002", "e f g h", 1), ("p0001_n0003", "g h i j", 1), ("p0001_n0004", "i j", 1)]


def test_windows_keep_their_tokens(spark):
    """Windows of pages that were cut into tokens once are those of the pages, and an index of their tokens is that of their texts."""
    from leafmill.operators import lexical as L

    texts = ["( a) b, c! ((d e) f-\ng é.", "", None, " ".join("pqrst" * 4), "[x", "b (441) ,c ."]
    own = pages(spark, *texts)
    for size, overlap in ((3, 1), (2, 0), (50, 10), (1, 5)):
        known = C.naive(C.tokenized(own), size, overlap)
        assert got(known, "chunk_id", "text", "page_end") == got(C.naive(own, size, overlap), "chunk_id", "text", "page_end")
        assert got(known, "t") == got(known.withColumn("t", F.array_join(T.tokens(F.col("text")), "\n")), "t")
        assert got(known.withColumn("w", T.detokenized(F.split("t", "\n"))), "w") == got(known, "text")
    docs = known.withColumn("doc", F.col("chunk_id")).localCheckpoint()
    asked = spark.createDataFrame([(1, "b c (d"), (2, "é")], "qid bigint, text string")
    scores = lambda rows: sorted(tuple(r) for r in L.Bm25(rows).best(asked, 50).collect())
    assert scores(docs.select("doc", "t")) == scores(docs.select("doc", "text")) != []


def test_pages(spark):
    assert got(C.page_index(pages(spark, "a\r\nb", None)), "chunk_id", "text", "strategy") == [("page/1", "a\r\nb", "page_index"), ("page/2", "", "page_index")]
    assert {r[0] for r in got(C.late(pages(spark, "a")), "strategy")} == {"late_chunking"}


TEXTS = ("one two three\nFIRST HEADING\na b c d e\nSECOND HEADING:\n", "THIRD ONE\nf g\nh", "i j k l m n o p")


def test_tree(spark):
    parents, children = C.tree(pages(spark, *TEXTS), 3, 4, 1)
    assert got(parents, "chunk_id", "text", "section_title", "page_start", "page_end") == [("p0000", "one two three", None, 1, 1), ("p0001", "a b c", "FIRST HEADING", 1, 1), ("p0002", "f g h", "THIRD ONE", 2, 3)]
    assert got(children, "chunk_id", "text", "parent_id") == [
        ("p0000/c0000", "one two three", "p0000"),
        ("p0001/c0000", "a b c d", "p0001"), ("p0001/c0001", "d e", "p0001"),
        ("p0002/c0000", "f g h i", "p0002"), ("p0002/c0001", "i j k l", "p0002"), ("p0002/c0002", "l m n o", "p0002"), ("p0002/c0003", "o p", "p0002"),
    ]


def test_structured(spark):
    rows = got(C.structured(pages(spark, *TEXTS), 4, 2), "chunk_id", "text", "section_title", "page_start", "page_end")
    assert rows == [
        ("s0000_c0000", "one two three", None, 1, 1),
        ("s0001_c0000", "a b c d", "FIRST HEADING", 1, 1),
        ("s0002_c0000", "f g h i", "THIRD ONE", 2, 3), ("s0002_c0001", "j k l m", "THIRD ONE", 2, 3), ("s0002_c0002", "n o p", "THIRD ONE", 2, 3),
    ]


def brute_boundary(units, counts, most, least, window):
    out, i, n = [], 0, len(units)
    tok = lambda a, b: sum(counts[a:b])
    while i < n:
        soft = i + 1
        while soft < n and tok(i, soft) < most:
            soft += 1
        end = n
        if soft < n:
            ends = [(e, tok(i, e)) for e in range(max(i + 1, soft - window), min(n, soft + window) + 1) if tok(i, e) >= least]
            fit = [e for e in ends if e[1] <= most]
            if not ends:
                end = max(i + 1, soft)
                while end < n and tok(i, end) < least:
                    end += 1
            else:
                end = max(fit, key=lambda x: x[1])[0] if fit else min(ends, key=lambda x: x[1])[0]
        out.append(" ".join(units[i:end]))
        i = end
    return out


def brute_semantic(units, counts, most, least, threshold):
    chunks = []
    for k, (u, n) in enumerate(zip(units, counts, strict=True)):
        if chunks and not (chunks[-1][1] >= least and (chunks[-1][1] + n > most or C.term_cosine(units[k - 1], u) < threshold)):
            chunks[-1] = ([*chunks[-1][0], u], chunks[-1][1] + n)
        else:
            chunks.append(([u], n))
    if len(chunks) > 1 and chunks[-1][1] < max(20, least // 2):
        tail = chunks.pop()
        chunks[-1] = (chunks[-1][0] + tail[0], chunks[-1][1] + tail[1])
    return [" ".join(c) for c, _ in chunks]


@pytest.mark.parametrize(("most", "least", "window"), [(40, 10, 2), (12, 30, 1), (25, 5, 6)])
def test_folds_against_brute_force(spark, most, least, window):
    rng = random.Random(most)
    say = lambda: " ".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 20))) + "."
    texts = [" ".join(say() for _ in range(rng.randint(0, 12))) for _ in range(9)] + ["", None]
    frame = pages(spark, *texts).union(pages(spark, "One only.", key="e"))
    rows = C.units(frame).where("doc_key = 'd'").orderBy("page", "unit").collect()
    units, counts = [r.text for r in rows], [r.n for r in rows]
    of = lambda chunks: [r[0] for r in got(chunks.where("doc_key = 'd'"), "text")]
    assert of(C.boundary(frame, most, least, window)) == brute_boundary(units, counts, most, least, window)
    assert of(C.semantic(frame, most, least, 0.6)) == brute_semantic(units, counts, most, least, 0.6)
    assert C.semantic(frame).where("doc_key = 'e'").count() == 1


def test_choosers(spark):
    frame = pages(spark, " ".join(f"a b c s{i}." for i in range(12)))
    plain = got(C.boundary(frame, 12, 4, 2), "text")
    assert got(C.boundary(frame, 12, 4, 2, lambda units, ends, pick: 1 / 0), "text") == plain
    assert got(C.boundary(frame, 12, 4, 2, lambda units, ends, pick: 99), "text") == plain
    first = got(C.boundary(frame, 12, 4, 2, lambda units, ends, pick: 1), "text")
    assert first[0] == ("a b c s0.",) and len(first) > len(plain)


def test_no_token_is_lost(spark):
    frame = pages(spark, *TEXTS)
    total = frame.select(F.sum(F.size(T.tokens(F.col("text"))))).first()[0]
    assert C.naive(frame, 3, 0).select(F.sum(F.size(T.tokens(F.col("text"))))).first()[0] == total


def test_registry(spark):
    frame = pages(spark, *TEXTS)
    for kind in ("page_index", "late_chunking", "structured_headings", "semantic", "llm_boundary"):
        assert C.build(frame, {"strategy": kind}).columns == C.page_index(frame).columns
    assert len(C.build(frame, {"strategy": "tree_parent_child"})) == 2
    with pytest.raises(ValueError, match="no chunker"):
        C.build(frame, {"strategy": "other"})


def test_a_window_that_begins_with_a_bracket(spark):
    """As the reference puts tokens together: no blank behind an opening bracket that stands first."""
    frame = spark.createDataFrame([("a", 1, "call (441) 555")], "doc_key string, page int, text string")
    assert [r.text for r in C.naive(frame, 4, 3).orderBy("ord").collect()] == ["call ( 441)", "(441) 555", "441) 555", ") 555", "555"]
