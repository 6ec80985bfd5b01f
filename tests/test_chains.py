"""Chunkers that follow chains from block to block, against plain folds over lists."""

import random
import re

import pytest
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators import chains
from leafmill.operators import chunks as C
from leafmill.operators import embed as E

WORDS = "the of a heart blood dose patient river stone value 12 (x) end: , ; -".split()


def line(rng):
    r = rng.random()
    if r < 0.08:
        return rng.choice(["1.2 METHODS", "RESULTS", "Note:", "3 scope", ":: odd:"])
    if r < 0.12:
        return rng.choice(["", "  ", "​"])
    if r < 0.14:
        return " ".join(rng.choice(WORDS) for _ in range(300))
    return " ".join(" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 12))) + rng.choice([".", "!", "?", ""]) for _ in range(rng.randint(1, 5)))


def table(spark, seed, n, keys, dense):
    rng = random.Random(seed)
    rows = [(rng.choice(keys), i, None if rng.random() < 0.05 else "\n".join(line(rng) for _ in range(rng.randint(0, dense)))) for i in range(n)]
    return spark.createDataFrame(rows, "doc_key string, page bigint, text string").persist()


def by_key(rows, *order):
    out = {}
    for r in sorted(rows.collect(), key=lambda r: tuple(r[c] for c in order)):
        out.setdefault(r.doc_key, []).append(r)
    return out


def plain_structured(pages, most, least):
    found = []
    lines = C.lines(pages).withColumn("t", T.tokens(F.col("text")))
    for key, rows in by_key(lines, "page", "line").items():
        title, held, place, number = None, [], [], 0

        def close(rows_of, title, number, key=key):
            for part in range(0, len(rows_of), most):
                if not part or len(rows_of[part : part + most]) >= least:
                    found.append((key, f"s{number:04d}_c{part // most:04d}", len(rows_of[part : part + most]), place[0], place[-1], title))

        for r in [*rows, None]:
            if r is not None and not r.heading:
                place = [*place, r.page] if held else [r.page]
                held = held + r.t
            if held and (r is None or r.heading or len(held) >= most):
                close(held, title, number)
                held, number = [], number + 1
            if r is not None and r.heading:
                title = r.text.strip().strip(":")
    return sorted(found, key=repr)


def plain_semantic(pages, most, least, threshold, alike):
    found = []
    for key, rows in by_key(C.units(pages), "page", "unit").items():
        groups = []
        for i, r in enumerate(rows):
            n = sum(x.n for x in groups[-1]) if groups else 0
            if groups and not (n >= least and (n + r.n > most or alike(rows[i - 1].text, r.text) < threshold)):
                groups[-1].append(r)
            else:
                groups.append([r])
        names = [f"s{i:04d}_p{g[0].page:04d}-{g[-1].page:04d}" for i, g in enumerate(groups)]
        if len(groups) > 1 and sum(x.n for x in groups[-1]) < max(20, least // 2):
            groups[-2:] = [groups[-2] + groups[-1]]
        found += [(key, name, " ".join(x.text for x in g), g[0].page, g[-1].page) for name, g in zip(names, groups, strict=False)]
    return sorted(found, key=repr)


def plain_boundary(pages, most, least, window):
    found = []
    for key, rows in by_key(C.units(pages), "page", "unit").items():
        number = 0
        while rows:
            sums = [sum(x.n for x in rows[:e]) for e in range(len(rows) + 1)]
            soft = next((e for e in range(1, len(rows)) if sums[e] >= most), None)
            end = len(rows)
            if soft:
                ends = [e for e in range(max(1, soft - window), min(len(rows), soft + window) + 1) if sums[e] >= least]
                fit = [e for e in ends if sums[e] <= most]
                end = max(fit, key=lambda e: sums[e]) if fit else min(ends, key=lambda e: sums[e])
            number += 1
            found.append((key, f"llm_{number:05d}", " ".join(x.text for x in rows[:end]), rows[0].page, rows[end - 1].page))
            rows = rows[end:]
    return sorted(found, key=repr)


CASES = [(1, 3, ["a"], 1, 200), (2, 60, ["a", "b", None], 6, 200), (3, 60, ["a"], 8, 37), (4, 25, ["a", "b"], 12, 1 << 16)]


@pytest.mark.parametrize("seed, n, keys, dense, block", CASES)
def test_as_plain_folds(spark, seed, n, keys, dense, block):
    pages = table(spark, seed, n, keys, dense)
    for most, least in ((60, 12), (5, 2)):
        got = C.structured(pages, most, least, block=block).select("doc_key", "chunk_id", T.token_count(F.col("text")).alias("n"), "page_start", "page_end", "section_title").collect()
        assert sorted(map(tuple, got), key=repr) == plain_structured(pages, most, least)
    columns = ("doc_key", "chunk_id", "text", "page_start", "page_end")
    vectors = E.hashed(16)()
    for most, least, threshold in ((45, 10, 0.3), (20, 30, 0.3)):
        got = C.semantic(pages, most, least, threshold, block=block).select(*columns).collect()
        assert sorted(map(tuple, got), key=repr) == plain_semantic(pages, most, least, threshold, C.term_cosine)
    got = C.semantic(pages, 45, 10, 0.5, embedder=E.hashed(16), block=block).select(*columns).collect()
    assert sorted(map(tuple, got), key=repr) == plain_semantic(pages, 45, 10, 0.5, lambda a, b: float(vectors([a])[0] @ vectors([b])[0]))
    for most, least, window in ((45, 10, 3), (10, 1, 0)):
        got = C.boundary(pages, most, least, window, block=block).select(*columns).collect()
        assert sorted(map(tuple, got), key=repr) == plain_boundary(pages, most, least, window)


def test_one_document_keeps_all_tasks_busy(spark):
    """Where one doc_key has all rows, no block, and so no task, has an eighth of them."""
    pages = table(spark, 5, 150, ["one"], 12)
    made = F.transform(T.units(F.coalesce("text", F.lit(""))), lambda x: F.struct(x.alias("text"), T.token_count(x).alias("size"), F.lit(False).alias("mark")))
    sizes = [r["count"] for r in chains.pieces(pages, made, 45, 500).groupBy("block").count().collect()]
    assert max(sizes) < sum(sizes) / 8
    plan = C.boundary(pages, 45, 10, block=500)._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"hashpartitioning\(([^)]*)\), REPARTITION", plan)
    assert dealt and sum("block" in x for x in dealt) == len(dealt) - 1  # all but the few rows at the blocks' fronts


def test_running_sums(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), i * 7 - 300, rng.randint(0, 9)) for i in range(200)]
    frame = spark.createDataFrame(rows, "k string, at bigint, n bigint")
    for how, plain in ((F.sum, sum), (F.max, lambda x: max([0, *x]))):
        got = {(r.k, r.at): (r.before_n, r.all_n) for r in chains.running(frame, "k", "at", "n", width=16, how=how).collect()}
        assert got == {(k, at): (plain(n for x, a, n in rows if x == k and a < at), plain(n for x, _, n in rows if x == k)) for k, at, _ in rows}
    assert chains.running(frame.limit(0), "k", "at", "n").collect() == []


def test_empty_tables_and_repeated_pages(spark):
    kinds = "doc_key string, page bigint, text string"
    nothing = spark.createDataFrame([], kinds)
    for chunker in (C.structured, C.semantic, C.boundary):
        assert chunker(nothing).collect() == [] and chunker(spark.createDataFrame([("a", 1, None), ("a", 2, " ")], kinds)).collect() == []
    twice = spark.createDataFrame([("a", 1, "One here. Two here."), ("a", 1, "Three here."), ("a", 1, "Three here.")], kinds)
    (only,) = C.semantic(twice).collect()
    assert sorted(re.findall(r"\w+(?= here)", only.text)) == ["One", "Three", "Three", "Two"] and only.text.index("One") + 10 == only.text.index("Two")
