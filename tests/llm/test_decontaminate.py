import random
import re
from collections import defaultdict

import numpy as np
import pytest

from leafmill.llm import decontaminate

from conftest import WORDS


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, size=10):
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[k : k + size])].add(str(i) if i is not None else "")
    w, hit, names = words(text), set(), set()
    for n in {len(x) for x in windows}:
        for k in range(len(w) - n + 1):
            found = windows.get(tuple(w[k : k + n]))
            if found:
                hit |= set(range(k, k + n))
                names |= found
    return len(w), len(hit), sorted(names)


@pytest.fixture(scope="module")
def cases(odd):
    rng = random.Random(9)
    say = lambda n: " ".join(rng.choice(WORDS[:4]) for _ in range(n))
    items = [(1, say(30)), (2, say(12)), (10, "short item"), (3, "Ünï ONE"), (4, ""), (5, None), (6, say(10)), (7, "one one one one one one one one one one one one one one"), (None, say(11)), (1, say(14)), (8, "solo")]
    texts = []
    for k in range(60):
        item = rng.choice([t for _, t in items if t])
        cut = words(item)[rng.randint(0, 3) :]
        texts.append((100 + k, f"{say(rng.randint(0, 40))}. {', '.join(cut)}! {say(rng.randint(0, 30))} {item.upper() if k % 3 else ''}"))
    return items, [*odd, *texts, (200, "one " * 40), (201, "x " * 5 + "short, ITEM; short item"), (202, "solo")]


@pytest.mark.parametrize("block_chars", [8_000_000, 150])
def test_against_brute_force(spark, frame, cases, block_chars):
    items, texts = cases
    tests = spark.createDataFrame(items, "item_id bigint, text string")
    rows = decontaminate.contamination(frame(texts), tests, block_chars=block_chars).collect()
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_words, r.n_hit, r.item_ids) for r in rows)
    assert got == sorted((i is not None, i or 0, *brute(t, items)) for i, t in texts)
    clean = decontaminate.decontaminated(frame(texts), tests, block_chars=block_chars)
    assert clean.columns == frame(texts).columns
    assert clean.count() == sum(r.n_hit == 0 for r in rows)


def test_spans_are_the_longest_matches(spark, frame):
    item = " ".join(f"w{i}" for i in range(40))
    text = "a b " + " ".join(f"w{i}" for i in range(5, 30)) + " c " + " ".join(f"w{i}" for i in range(12))
    spans = decontaminate.contamination(frame([(1, text)]), spark.createDataFrame([(7, item)], "item_id bigint, text string")).first().spans
    assert [tuple(x) for x in spans] == [("7", 5, 2, 25), ("7", 0, 28, 12)]


def longest(text, item, size=10):
    """Of each place where a match of `size` words or more ends, the longest, unless it goes on."""
    w, v = words(text), words(item)
    least, out, before = min(size, len(v)), [], {}
    for p in range(len(w)):
        now = {q: before.get(q - 1, 0) + 1 for q in range(len(v)) if w[p] == v[q]}
        here = max(now.values(), default=0)
        then = max((n for q, n in now.items() if p + 1 < len(w) and q + 1 < len(v) and w[p + 1] == v[q + 1]), default=0)
        if here >= least and then < here:
            q = min(q for q, n in now.items() if n == here)
            out.append((q - here + 1, p - here + 1, here))
        before = now
    return out


def test_longest_matches_and_their_places(spark, frame, cases):
    """Phrases that repeat within an item, over 8 times too."""
    items = [(1, "alpha beta gamma " * 12), (2, " ".join(f"r{k % 10}" for k in range(120))), (3, "again " * 40), (4, " ".join(f"w{k}" for k in range(60)))]
    rng = random.Random(2)
    texts = [(1, items[1][1]), (2, "x " + items[0][1] + "y " + items[0][1][17:90]), (3, "again " * 25 + "z " + "again " * 70)]
    for i in range(10, 40):
        parts = [words(rng.choice(items)[1]) for _ in range(4)]
        texts.append((i, " ".join(w for p in parts for at in [rng.randint(0, len(p) - 1)] for w in [*p[at : at + rng.randint(5, 50)], f"own{rng.randint(0, 3)}"])))
    rows = decontaminate.contamination(frame(texts), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    for r in rows:
        want = sorted((str(i), *x) for i, t in items for x in longest(dict(texts)[r.doc_id], t))
        assert sorted(tuple(x) for x in r.spans) == want, r.doc_id
    assert [tuple(x) for x in rows[0].spans] == [("2", 0, 0, 120)]


def test_empty_tables(spark, frame, odd):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert {r.n_hit for r in decontaminate.contamination(frame(odd), none).collect()} == {0}
    assert decontaminate.contamination(frame([]), spark.createDataFrame([(1, "a b")], "item_id bigint, text string")).collect() == []


def test_words_over_slices(monkeypatch):
    monkeypatch.setattr(decontaminate, "SLICE_BYTES", 7)
    text = "Some longer-than-a-slice extraordinarily words é 123 here" * 3
    data = np.frombuffer(text.encode(), np.uint8)
    hashes, begins, ends = decontaminate.word_hashes(data)
    found = [text.encode()[b:e].decode().lower() for b, e in zip(begins, ends, strict=True)]
    assert found == words(text)
    assert len(set(hashes.tolist())) == len(set(found))
