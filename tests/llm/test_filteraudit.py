import itertools
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from leafmill.llm import filteraudit as A

LABELS = "doc_id bigint, quality int, toxic int, note string"


def brute_mask(text, copy):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    fails = [len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search("[#$%&*|]", text)), copy]
    return "".join(letter for letter, f in zip("ABCDE", fails, strict=True) if f)


def brute_audit(docs, labels):
    """docs: (doc_id, source, text)."""
    smallest = {}
    for i, _, t in docs:
        if i is not None:
            smallest[t or ""] = min(smallest.get(t or "", i), i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    masked = [(i, s or "", brute_mask(t or "", i is not None and smallest[t or ""] < i)) for i, s, t in docs]
    rows, total = {}, Counter()
    for part in {s for _, s, _ in masked}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [(i, m) for i, s, m in masked if s == part]
            for step, x in enumerate(order, 1):
                gone = [(i, m) for i, m in left if x in m]
                every = [m for _, s, m in masked if s == part]
                left = [(i, m) for i, m in left if x not in m]
                total[part, x] += len(gone)
                rows[part, order, step] = [len(left), len(gone), sum(x in m for m in every) - len(gone), sum(m == x for m in every), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in rows.items()}


def got(df):
    rows = df.collect()
    out = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(out) == len(rows)
    return out


def test_against_brute_force(spark, frame, odd):
    many = [f"word{i} Lower, case {i}" for i in range(40)]
    more = [(100, " ".join(many)), (101, " ".join(many)), (99, "SHOUT " * 60), (102, "a b " * 40), (103, " ".join(many) + " 100%"), (104, "  x y " * 30), (105, "é" * 100 + "A" * 6)]
    texts = [*odd, *more]
    sources = [None, "", "s", "t", "s"]
    docs = [(i, sources[n % 5], t) for n, (i, t) in enumerate(texts)]
    labels = [(i, i % 3 if i % 3 < 2 else None, i % 2, "x") for i in range(0, 110)] + [(4, 1, 0, "again"), (None, 1, 1, "no id")]
    table = spark.createDataFrame([(i, t, s, 7, "x") for i, s, t in docs], "doc_id bigint, text string, source string, mask int, part string")
    known = spark.createDataFrame(labels, LABELS)
    assert got(A.audit(A.masks(table), known)) == brute_audit(docs, [r[:3] for r in labels])
    assert got(A.audit(A.masks(table.limit(0)), known)) == {}
    assert len(got(A.audit(A.masks(table), known.limit(0)))) == 600 * 3


def test_scans_are_those_of_python():
    texts = ["", None, "a", " a  b a", "a\nb\x0bB\x1cC", "x" * 5000 + " y", "日本 日本 ñ", "tail", "head tail ", "A#B"]
    for kind in (pa.string(), pa.large_string()):
        whole = pa.array(["skipped", *texts], kind)
        found = A.scan(whole.slice(1))
        words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
        assert found["n_words"].tolist() == [len(w) for w in words]
        assert found["n_distinct"].tolist() == [len(set(w)) for w in words]
        assert found["n_chars"].tolist() == [len(t or "") for t in texts]
        assert found["n_capitals"].tolist() == [len(re.findall("[A-Z]", t or "")) for t in texts]
        assert found["n_symbols"].tolist() == [len(re.findall("[#$%&*|]", t or "")) for t in texts]


@pytest.mark.parametrize("base", [A._BASE, 1])
def test_words_of_one_hash_are_told_apart(base):
    """With 1 for a base a hash is the sum of its bytes, so words with the same letters collide."""
    texts = ["ab ba ab abc cab b a", "ba", "ab ad bc", "x x x"]
    data, offsets = A.utf8(pa.array(texts))
    spans = [(offsets[i] + m.start(), offsets[i] + m.end(), i) for i, t in enumerate(texts) for m in re.finditer(r"\S+", t)]
    b, e, doc = (np.array(x) for x in zip(*spans, strict=True))
    assert A.distinct_words(data, b, e, doc, len(texts), base).tolist() == [len(set(t.split())) for t in texts]
