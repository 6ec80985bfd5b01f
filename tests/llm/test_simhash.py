import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from leafmill.llm import simhash


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_roots(values):
    """The smallest value that is reached from each through steps of two bits."""
    left, out = set(values), {}
    while left:
        seed = left.pop()
        group, todo = {seed}, [seed]
        while todo:
            x = todo.pop()
            near = {y for y in left if (x ^ y).bit_count() <= 2}
            left -= near
            group |= near
            todo += near
        out |= dict.fromkeys(group, min(group))
    return out


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("dense", [2, 48])
def test_links_reach_all_that_is_near(spark, dense):
    rng = random.Random(2)
    centres = [rng.getrandbits(64) for _ in range(12)]
    values = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centres for _ in range(12)}
    values |= {c ^ sum(1 << b for b in rng.sample(range(6), rng.randint(0, 6))) for c in centres[:2] for _ in range(60)} | {0, (1 << 64) - 1, (1 << 63) | 1}
    frame = spark.createDataFrame([(signed(v),) for v in values], "fp bigint")
    edges = simhash.links(frame, dense)
    pairs = [(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in edges.collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in pairs)
    roots = {r.node & (1 << 64) - 1: r.root for r in simhash.components(edges).collect()}
    want = brute_roots(values)
    groups = {}
    for v in values:
        groups.setdefault(want[v], set()).add(roots.get(v, signed(v)))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_components_of_a_long_path(spark):
    n = 60
    order = list(range(n))
    random.Random(4).shuffle(order)
    edges = spark.createDataFrame([(min(a, b), max(a, b)) for a, b in zip(order, order[1:], strict=False)], "a bigint, b bigint")
    assert {r.root for r in simhash.components(edges).collect()} == {0}


def test_classes(spark, frame, odd):
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.fp, r.component_id) for r in simhash.classes(frame(odd)).collect()), key=str)
    fps = [brute_fingerprint(t) for _, t in odd]
    roots, least = brute_roots(fps), {}
    for (i, _), fp in zip(odd, fps, strict=True):
        if i is not None:
            least[roots[fp]] = min(least.get(roots[fp], i), i)
    want = sorted(((i is not None, i or 0, signed(fp), least.get(roots[fp])) for (i, _), fp in zip(odd, fps, strict=True)), key=str)
    assert got == want
    assert simhash.classes(frame([])).collect() == []


def test_one_of_each_group_stays(frame, odd):
    got = simhash.deduplicated(frame(odd))
    assert got.columns == frame(odd).columns
    kept = [(r.doc_id, r.text) for r in got.collect()]
    named = [(i, t) for i, t in kept if i is not None]
    roots = brute_roots([brute_fingerprint(t) for _, t in odd])
    root = lambda t: roots[brute_fingerprint(t)]
    least = {}
    for i, t in odd:
        if i is not None:
            least[root(t)] = min(least.get(root(t), i), i)
    assert sorted((root(t), i) for i, t in named) == sorted(least.items())
    assert sorted(t or "" for i, t in kept if i is None) == ["", "no id"]


def test_components_that_share_a_doc_id(frame):
    """Two unlike texts under one doc_id are two components, and each keeps a row."""
    rng = random.Random(9)
    a, b, c = (" ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(60)) for _ in range(3))
    kept = sorted((r.doc_id, r.text) for r in simhash.deduplicated(frame([(1, a), (1, b), (2, b), (2, c), (3, a), (1, b)])).collect())
    assert kept == sorted([(1, a), (1, b), (2, c)])


def test_fingerprints_in_hexadecimal(frame):
    hex_print = simhash.classes(frame([(1, "a b c d")])).select(F.lower(F.lpad(F.hex("fp"), 16, "0"))).first()[0]
    assert hex_print == f"{brute_fingerprint('a b c d'):016x}"
