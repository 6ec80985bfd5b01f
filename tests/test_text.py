import pytest
from pyspark.sql import functions as F

from leafmill.functions import answers as A
from leafmill.functions import noise as N
from leafmill.functions import text as T
from leafmill.functions import vectors as V


def ask(spark, f, *values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in rows.repartition(1).sortWithinPartitions("i").select(f(F.col("x"))).collect()]


def test_normalized(spark):
    texts = ["a-\nb", "a-\nb-\nc", "a-\r\nb", "a \t\x0b b", "x\n\n\n\ny", "a  \n \n \n b", " a \nb ", "", "a\rb", "é-\nß"]
    want = ["ab", "ab-\nc", "a-\nb", "a b", "x\n\ny", "a\n\n\n b", "a\nb", "", "a\nb", "éß"]
    assert ask(spark, T.normalized, *texts) == want


def test_cleaned(spark):
    assert ask(spark, N.cleaned, "a\x00\rb", None, " a \t b\n\n\n\nc ") == ["ab", "", "a b\n\nc"]
    assert ask(spark, lambda c: N.cleaned(c, N.DEEP), "hy-\nphen") == ["hyphen"]
    plain = N.Profile(strip_nonprinting=False, collapse_whitespace=False)
    assert ask(spark, lambda c: N.cleaned(c, plain), " a\r\n\x01  b ") == [" a\n\x01  b "]


def test_tokens(spark):
    assert ask(spark, T.tokens, "don't x_1, é²!", "", "日本 -") == [["don", "'", "t", "x_1", ",", "é²", "!"], [], ["日本", "-"]]
    assert ask(spark, lambda c: T.detokenized(T.tokens(c)), '(a b) x-y (c), "d".', "", "a") == ['(a b) x - y ( c), " d ".', "", "a"]


def test_headings(spark):
    lines = ["1 Intro", "1. Intro", "12 patients were", "2.3 Results", "ABCDEF", "ABCDE", "Note:", "x" * 80 + ":", "", "1", "ABC DEF 12", "Ünd:"]
    assert ask(spark, T.is_heading, *lines) == [True, False, True, True, True, False, True, False, False, False, True, True]
    assert ask(spark, T.heading_title, " :Note:: ") == ["Note"]


def test_units(spark):
    assert ask(spark, T.units, "INTRODUCTION\nOne. Two!  Three? four\n\n a", "") == [["INTRODUCTION", "One.", "Two!", "Three? four".split(" ")[0], "four", "a"], []]


def test_token_windows(spark):
    text = " ".join("abcdefghij")
    assert ask(spark, lambda c: T.token_windows(c, 4, 1), text, "", "a b") == [["a b c d", "d e f g", "g h i j"], [], ["a b"]]
    assert ask(spark, lambda c: T.token_windows(c, 0, 1), "a, b") == [["a, b"]]
    assert ask(spark, lambda c: T.token_windows(c, 2, 5), "a b c") == [["a b", "b c"]]


def test_small_functions(spark):
    assert ask(spark, lambda c: T.prefixed(c, "Query: "), "query: x", "y") == ["query: x", "Query: y"]
    assert ask(spark, lambda c: T.rewritten(c, "clinical guideline"), "What  is X??", "A Clinical Guideline.") == ["What is X? (clinical guideline)", "A Clinical Guideline?"]
    assert ask(spark, T.seconds, 2e9, 5e5, None, -1.0, kind="double") == [2.0, 500000.0, -1.0, -1.0]
    assert ask(spark, T.safe_name, "a/b c:d.e-f") == ["a_b_c_d.e-f"]
    assert ask(spark, T.summary_output, ' "a "b"" ') == ['a "b']
    assert [len(x) for x in ask(spark, T.summary_input, "x" * 7000, "x" * 6000)] == [6001, 6000]
    assert ask(spark, lambda c: T.processor(c, "m:1"), "NAME PROC\nm:1 12%/88% CPU/GPU", "m:1 100% CPU", "none") == ["GPU", "CPU", "unknown"]
    assert ask(spark, T.safe_lower, None, "A") == ["", "a"]


def test_noise(spark):
    refs = "A 1999; B 2001; C 2010; D"
    assert ask(spark, N.reference_like, refs, "doi et al 1999 2001", "et al 1999") == [True, True, False]
    assert ask(spark, N.abbreviation_like, "AB = x CD = y EF: z GH = a IJ = b KL: c", "plain words") == [True, False]
    assert ask(spark, lambda c: N.is_noise(c, N.BASIC), "", " \n", None, "x") == [True, True, True, False]
    assert ask(spark, lambda c: N.is_noise(c, N.DEEP), "word " * 40, "word " * 39) == [False, True]
    assert ask(spark, lambda c: T.capitals_ratio(T.quick_tokens(c)), "ABC 12 abc A1", "") == [0.5, 0.0]
    assert ask(spark, T.equals_per_100, "a=b=", "") == [50.0, 0.0]
    assert N.Profile.of({"name": "x", "min_token_count": "7", "unknown": 1}).min_token_count == 7


def test_vectors(spark):
    rows = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    got = rows.select(V.dot(F.col("a"), F.col("b")), V.cosine(F.col("a"), F.col("b")), V.normalized(F.col("a"))).collect()
    assert got[0][0] == 24 and got[0][1] == pytest.approx(0.96) and got[0][2] == pytest.approx([0.6, 0.8])
    assert got[1][1] == 0 and got[1][2] == [0, 0]


def test_answers(spark):
    texts = ["[p12] [p3-p1] [p12, p13]", '{"citations":["p28","p 14",7]}', "{broken [p4]", None, "none"]
    assert ask(spark, A.cited_pages, *texts) == [[12, 1, 2, 3], [28, 14], [4], [], []]
    assert ask(spark, A.not_found, "answer: NOT_FOUND", '{"answer":"NOT_FOUND"}', "", None, "not_found", "x") == [True, False, True, True, True, False]
    assert ask(spark, lambda c: A.filled(F.lit("{question}|{context}"), c, F.lit("C")), "{context}?") == ["{context}?|C"]
    chunks = spark.createDataFrame([([(2, 3, 4, "b" * 9), (1, 1, 1, " a ")],)], "c array<struct<rank: int, page_start: int, page_end: int, text: string>>")
    assert chunks.select(A.context(F.col("c"), 5, 100)).first()[0] == "[p1-p1]\na\n\n[p3-p4]\nbbbbb…"
    assert chunks.select(A.context(F.col("c"), 5, 10)).first()[0] == "[p1-p1]\na\n…"
