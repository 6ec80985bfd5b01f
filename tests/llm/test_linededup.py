import hashlib
import random
import re

import pytest
import xxhash

from leafmill.llm import linededup
from leafmill.llm.queries import op4_line_dedup


def h64(s):
    x = xxhash.xxh64_intdigest(s.encode(), 42)
    return x - (1 << 64) if x >> 63 else x


def brute(docs, least):
    """What each document keeps: all lines but those of runs of `least` words that stand earlier in any document, and blank ones behind them."""
    seen, out = set(), {}
    for _, i, key, text in sorted({(i is not None, i or 0, h64(t) if t is not None else 42, t or "") for i, t in docs}):
        lines = text.split("\n")
        own = [(k, x.strip(" \t\r\x0b\f")) for k, x in enumerate(lines) if x.strip(" \t\r\x0b\f")]
        gone, new = set(), []
        for s in range(len(own)):
            for t in range(s, len(own)):
                run = tuple(x for _, x in own[s : t + 1])
                if sum(len(x.split()) for x in run) >= least:
                    if run in seen:
                        gone |= set(range(own[s][0], own[t + 1][0] if t + 1 < len(own) else own[t][0] + 1))
                    seen.add(run)
        out[i, key] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def documents(seed, n=60):
    rng = random.Random(seed)
    pool = [" ".join(f"w{rng.randint(0, 999)}" for _ in range(rng.choice([1, 2, 3, 6, 12, 60]))) for _ in range(25)]
    docs = []
    for i in range(1, n):
        text = []
        for _ in range(rng.randint(0, 6)):
            at = rng.randint(0, 20)
            text += [x + rng.choice(["", "", "\r", "\t", " "]) for x in pool[at : at + rng.randint(1, 6)]] if rng.random() < 0.6 else [f"own {i} {rng.random()}", "", "  "]
        docs.append((i, "\n".join(text)))
    docs += [(3, docs[3][1]), (3, docs[5][1]), (None, docs[7][1]), (None, None), (90, "same line again\n" * 40), (91, "\n".join(pool)), (92, " \n".join(pool))]
    return docs


@pytest.mark.parametrize(("seed", "least"), [(1, 10), (2, 5), (3, 1), (4, 20)])
def test_against_brute_force(frame, seed, least):
    docs = documents(seed)
    got = linededup.deduplicated(frame(docs), least, None, report=True).collect()
    want = brute(docs, least)
    assert sorted((str(r.doc_id), r.text or "") for r in got) == sorted((str(i), want[i or 0, h64(t) if t is not None else 42]) for i, t in docs)
    for r in got:
        assert r.n_lines - r.n_cut == r.n_left and r.n_chars_cut >= r.n_cut


def test_lines_of_a_block_that_stand_elsewhere_before(frame):
    """Decoys: an earlier document holds one line of the block, others each line in another context."""
    passage = [" ".join(f"p{k}w{j}" for j in range(3)) for k in range(5)]
    for decoys in ([passage[0]], [passage[3]], passage, ["}", "home"]):
        docs = [(k, f"a{k}\n{x}\nb{k}") for k, x in enumerate(decoys)]
        docs += [(i, "\n".join([f"c{i}", "home", *passage, "}", f"d{i}"])) for i in (20, 21, 22)]
        got = {r.doc_id: r.text for r in linededup.deduplicated(frame(docs)).collect()}
        assert got[20] == docs[-3][1] and got[21] == "c21\nd21" and got[22] == "c22\nd22"


def test_runs_of_enough_words_are_all_found(frame):
    """What winnowing promises: of two copies, the later one goes, whatever stands around it."""
    rng = random.Random(8)
    passage = [f"p{k} q{k} r{k}" for k in range(4)]
    docs = [(i, "\n".join([f"a{i} {rng.random()}" for _ in range(rng.randint(1, 9))] + passage + [f"b{i} {rng.random()}"])) for i in range(30)]
    got = {r.doc_id: r.text for r in linededup.deduplicated(frame(docs)).collect()}
    assert "p0" in got[0] and not any("p0" in got[i] or "r3" in got[i] for i in range(1, 30))


def test_scripts_without_blanks_and_white_space(frame):
    line = "これは六十文字を超える長い行であり単語の間に空白がないため字数で数えられるべきものであるから繰り返されれば消える"
    docs = [(1, f"a\n{line}\nb"), (2, f"c\r\n{line}\r\nd"), (3, "x\ty\tz one two three four five six seven\n"), (4, "y\n\tx\ty\tz one two three four five six seven \nw")]
    got = {r.doc_id: r.text for r in linededup.deduplicated(frame(docs)).collect()}
    assert got == {1: docs[0][1], 2: "c\r\nd", 3: docs[2][1], 4: "y\nw"}


def test_passages_and_lines_at_once(spark, frame, tmp_path):
    """Nothing of 50 words stands earlier in what is left, and what is left in order is what was there."""
    rng = random.Random(11)
    words = lambda n: [f"w{rng.randint(0, 400)}{rng.choice(['', '', '', '.', ','])}" for _ in range(n)]
    lines = [" ".join(words(rng.choice([4, 12, 30]))) for _ in range(30)]
    inner = [" ".join(words(70)) for _ in range(4)]
    docs = []
    for i in range(1, 80):
        at = rng.randint(0, 25)
        parts = [" ".join(words(rng.randint(1, 30))), *lines[at : at + rng.randint(0, 5)], f"x{i} {rng.choice(inner)} y{i} {rng.random()}"]
        rng.shuffle(parts)
        docs.append((i, "\n".join(parts)))
    got = {r.doc_id: r.text for r in linededup.deduplicated(frame(docs), drop=False).collect()}
    seen = set()
    for i, text in docs:
        left, whole = got[i].split(), iter(text.split())
        assert all(any(x == y for y in whole) for x in left)
        assert not any(tuple(left[k : k + 50]) in seen for k in range(len(left) - 49))
        own = text.split()
        seen |= {tuple(own[k : k + 50]) for k in range(len(own) - 49)}
    alone = linededup.cuts(frame(docs)).count()
    assert 0 < alone < sum(got[i] != t for i, t in docs)
    frame(docs).write.parquet(str(tmp_path / "documents.parquet"))
    rows = op4_line_dedup(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.text_sha256 for r in rows} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in got.items()}


def test_what_is_left(frame, odd):
    out = linededup.deduplicated(frame(odd))
    assert out.columns == frame(odd).columns
    kept = [r.doc_id for r in out.collect()]
    assert 8 not in kept and {0, 1, 2, 3, 4} <= set(kept)
    assert all(re.search(r"\S", r.text or "x") for r in out.where("doc_id > 3").collect())
    assert linededup.deduplicated(frame([])).collect() == []
    report = linededup.deduplicated(frame(odd), report=True)
    assert report.count() == len(odd) and report.columns[-4:] == ["n_lines", "n_cut", "n_left", "n_chars_cut"]
