import random

import pytest

WORDS = "the and of licence harbour meadow winter copper lantern ribbon orchard velvet thunder marble cedar falcon willow amber granite saffron".split()

#: Every table has nulls, empty and long texts, ties, repeated rows, and columns whose names clash.
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, spans string, hash bigint, fp bigint, n_words bigint"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 40)) for _ in range(n))


def rows_of(texts):
    return [(i, t, None if i == 1 else "en", "s", len(t or ""), 0.5, "x", 7, 7, None) for i, t in texts]


@pytest.fixture(scope="session")
def frame(spark):
    return lambda texts: spark.createDataFrame(rows_of(texts), COLUMNS)


@pytest.fixture(scope="session")
def odd():
    """(doc_id, text) with what may be odd about them."""
    rng = random.Random(5)
    base = [prose(rng, n) for n in (30, 40, 60, 25)]
    long = prose(rng, 30_000)
    texts = [None, "", " ", "\n\n", *base, base[0], base[1] + " changed", long, "Ünïcödé 日本語 ßtraße İ K ﬁ", "\x00\x1c\x85  x", "one", "ONE"]
    out = list(enumerate(texts)) + [(4, base[0]), (4, base[0]), (5, "another text of document five"), (None, "no id"), (None, None)]
    return out
