import random
import re

import xxhash
from pyspark.sql import functions as F

from leafmill.llm import linededup, passages
from leafmill.llm.queries import op4_line_dedup


def h64(s):
    x = xxhash.xxh64_intdigest(s.encode(), 42)
    return x - (1 << 64) if x >> 63 else x


def brute(docs, least):
    """The words that each document keeps: all but those of runs of `least` words that stand earlier."""
    seen, out = set(), {}
    for _, i, key, text in sorted({(i is not None, i or 0, h64(t), t) for i, t in docs if t is not None}):
        own, gone = text.split(), set()
        for at in range(len(own) - least + 1):
            run = tuple(own[at : at + least])
            if run in seen:
                gone |= set(range(at, at + least))
            seen.add(run)
        out[i, key] = [w for k, w in enumerate(own) if k not in gone]
    return out


def documents(seed, n=150):
    rng = random.Random(seed)
    stops = lambda rate: rng.choice(",.;") if rng.random() < rate else ""
    words = lambda n, rate=0.1: [f"w{rng.randint(0, 400)}{stops(rate)}" for _ in range(n)]
    planted = [words(k, rate) for k in (49, 50, 51, 60, 90, 200) for rate in (0, 0.03, 0.06, 0.2, 0.9)]
    docs = []
    for i in range(1, n):
        parts = words(rng.randint(0, 60))
        for _ in range(rng.randint(0, 4)):
            passage = rng.choice(planted)
            cut = rng.choice([0, 0, rng.randint(0, 30)])
            parts += passage[cut:] + words(rng.randint(0, 20))
        docs.append((i, "".join(w + rng.choice([" ", " ", " ", "\n", "  ", "\t"]) for w in parts)))
    return docs + [(3, docs[2][1]), (3, docs[6][1]), (200, "again " * 700), (201, None), (202, " \n"), (203, "  " + docs[9][1])]


def test_against_brute_force(frame):
    for seed in (1, 2):
        docs = documents(seed)
        got = passages.deduplicated(frame(docs), drop=False).select("doc_id", "text").collect()
        want = brute(docs, 50)
        assert len(got) == len(docs)
        left = sorted((r.doc_id, (r.text or "").split()) for r in got)
        assert left == sorted((i, want[i, h64(t)] if t is not None else []) for i, t in docs)
        assert sum(len(x) for _, x in left) < sum(len((t or "").split()) for _, t in docs)


def test_passage_within_longer_lines(spark, frame, tmp_path):
    """It begins and ends inside lines that differ."""
    rng = random.Random(3)
    passage = " ".join(f"p{rng.randint(0, 999)}" for _ in range(80))
    docs = [(i, f"line one of {i}\nbefore{i} {passage} after{i}\nline three of {i}") for i in (1, 2, 3)]
    frame(docs).write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in op4_line_dedup(spark, str(tmp_path)).collect()}
    want = {r.doc_id: r.text for r in passages.deduplicated(linededup.deduplicated(frame(docs), passage=None)).collect()}
    assert want[1] == docs[0][1] and want[2] == "line one of 2\nbefore2 after2\nline three of 2"
    import hashlib

    assert all(rows[i].text_sha256 == hashlib.sha256(want[i].encode()).hexdigest() for i in (1, 2, 3))


def test_white_space_and_what_is_left(frame, odd):
    rng = random.Random(4)
    passage = [f"p{rng.randint(0, 999)}" for _ in range(60)]
    broken = " ".join(passage[:30]) + "\n" + " ".join(passage[30:])
    docs = [(1, " ".join(passage)), (2, f"a  b {broken}\nc\td"), (3, broken), (4, f"a\n{broken}\nb")]
    assert {r.doc_id: r.text for r in passages.deduplicated(frame(docs)).collect()} == {1: docs[0][1], 2: "a  b \nc\td", 4: "a\nb"}
    out = passages.deduplicated(frame(odd))
    assert out.columns == frame(odd).columns and {0, 1, 2, 3, 4} <= {r.doc_id for r in out.collect()}
    assert all(re.search(r"\S", r.text or "x") for r in out.where("doc_id > 3").collect())
    assert passages.deduplicated(frame([])).collect() == []


def test_what_is_left_over(spark):
    """Against lists of words, over random texts and cuts."""
    rng = random.Random(12)
    rows, wanted = [], []
    for k in range(400):
        lines = ["".join(rng.choice(["", " ", "\t"]) + rng.choice(["a", "bb", "é", "c.d"]) + rng.choice([" ", "  ", "\r"]) for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(1, 8))]
        lines = [x if x.strip() else rng.choice(["", " ", " \t"]) for x in lines]
        split = [re.findall(r"\s*\S+\s*", x) or [x] for x in lines]
        n = sum(map(len, split))

        def ranges(most):
            out, at = [], rng.randint(0, 3)
            while at < most:
                end = min(at + rng.randint(0, 4), most - 1)
                out.append({"b": at, "e": end})
                at = end + rng.randint(2, 5)
            return out

        gone, cut = ranges(len(lines)) if rng.random() < 0.5 else [], ranges(n)
        want, o = "", 0
        for i, own in enumerate(split):
            first, o = o, o + len(own)
            if any(c["b"] <= i <= c["e"] for c in gone):
                continue
            left = [w for j, w in enumerate(own, first) if not any(c["b"] <= j <= c["e"] for c in cut)]
            if not any(c["b"] <= first and o - 1 <= c["e"] for c in cut):
                want += "".join(left) + "\n"
        rows.append((k, "\n".join(lines), gone, cut))
        wanted.append(want)
    kind = "array<struct<b: int, e: int>>"
    frame = spark.createDataFrame(rows, f"k int, text string, lines {kind}, words {kind}")
    got = {r.k: r.left for r in frame.select("k", passages.left_over(F.col("text"), F.col("lines"), F.col("words")).alias("left")).collect()}
    assert [got[k] for k in range(len(rows))] == wanted


def test_no_python_on_the_executors(spark, frame, tmp_path, monkeypatch):
    docs = documents(5, 40)
    frame(docs).write.parquet(str(tmp_path / "documents.parquet"))

    def refused(*_, **__):
        raise AssertionError("Python on the executors")

    for name in ("mapInArrow", "mapInPandas"):
        monkeypatch.setattr(type(frame([])), name, refused)
    assert sum(r.n_chars_cut > 0 for r in op4_line_dedup(spark, str(tmp_path)).collect()) > 5


def test_places_of_rows_are_those_of_arrays(spark):
    """Both forms tell the same places, for texts with and without words that are places by themselves."""
    rng = random.Random(13)
    texts = ["again " * n for n in (49, 50, 51, 120)] + [" ".join(f"w{rng.randint(0, 60)}" for _ in range(rng.randint(30, 400))) for _ in range(60)]
    low = [f"v{i}" for i in range(2)]
    texts += [" ".join(rng.choice(low) for _ in range(n)) for n in (60, 200)]
    w = spark.createDataFrame(list(enumerate(texts)), "d int, text string").select("d", passages._hashes(F.col("text")).alias("w"))
    frame = w.withColumn("c", passages._pairs(F.col("w")))
    arrays = frame.where("size(c) >= 50").select("d", F.explode(passages._places(F.col("c"), 39, 12)).alias("k"))
    rows = frame.select("d", "c", F.posexplode_outer("c").alias("k", "x")).where(passages._is_place(50, 39, 12)).select("d", "k")
    want = sorted(map(tuple, arrays.collect()))
    assert len(want) > 500 and sorted(map(tuple, rows.collect())) == want
    counts = {d: sum(1 for e, _ in want if e == d) for d in range(4)}
    assert counts == {0: 0, 1: 12, 2: 13, 3: 82}
