import hashlib
import random
import re

import pytest

from leafmill.llm import pii

KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def holds(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "card":
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(sum(map(int, str(x))) for x in doubled) % 10 == 0
    return 9 <= len(digits) <= 15 if kind == "phone" else True


def brute(text):
    found = sorted((m.start(), k, m.end(), name) for k, (name, p) in enumerate(KINDS) for m in re.finditer(p, text or "") if holds(name, m[0]))
    return [(a, k, b) for a, k, b, _ in found]


def test_random_texts():
    rng = random.Random(6)
    parts = ["a@b.c", "@", "x.y@", "é@e.f", "1.2.3.4", "255", "256", ".", "-", " ", "+", "4111 1111 1111 1111", "4111-1111", "12", "(0)", "a", "+49 30 1234567", "..", "@x-y.z.", "0000001.2.3.4", "%"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 10)))
        assert [x[:3] for x in pii.base_spans(text)] == brute(text), text


def test_long_runs_take_no_square_of_time():
    assert pii.base_spans("1" * 300_000 + " a@" + "b" * 300_000 + "@" + "+1" * 50_000) == []


@pytest.fixture(scope="module")
def cases(odd):
    rng = random.Random(3)
    say = lambda n: " ".join(f"word{'abcdefghij'[rng.randint(0, 9)]}" for _ in range(n))
    told = [(100 + i, f"{say(9)} zanzibari {say(2)} jo@ex.org {say(12)} {'quelle' if i < 2 else 'rest'}") for i in range(4)]
    copies = [(120 + i, f"{say(0)} lonelyterm x@y.org and more") for i in range(5)]
    return [*odd, *told, *copies, (140, "1.2.3.4 jo@ex.org +49 30 1234567, 4111 1111 1111 1111"), *[(200 + i, say(30)) for i in range(200)]]


def test_scan(frame, cases):
    rows = pii.digests(pii.scan(frame(cases))).collect()
    join = lambda spans: ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
    got = sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in rows)
    want = [(str(i), *(sum(x[1] == k for x in brute(t)) for k in range(4)), hashlib.sha256(join(brute(t)).encode()).hexdigest()) for i, t in cases]
    assert got == sorted(want)
    text = dict(cases)
    terms = {(r.doc_id, text[r.doc_id][int(a) : int(b)]) for r in rows if r.doc_id for k, a, b in [x.split(":") for x in r.spans.split(",") if x] if k == "term"}
    assert {(i, "zanzibari") for i in range(100, 104)} <= terms
    assert not any(w.startswith("word") for _, w in terms)
    assert not any(w == "lonelyterm" for _, w in terms), "copies of one text prove nothing"
    assert pii.scan(frame([])).collect() == []


def test_sanitised_texts(frame, cases):
    got = {r.doc_id: r.text for r in pii.sanitise(frame(cases)).where("doc_id >= 100").collect()}
    assert "zanzibari" not in got[100] and "jo@ex.org" not in got[100] and "[EMAIL]" in got[100]
    assert got[140].startswith("[IP] [EMAIL] [PHONE], [CARD]") and got[200] == dict(cases)[200]


def informative(docs, window=6, generalise=0.8):
    """(entity, term) to the share of the entity's information that the term gives, by the definition."""
    import math

    near, having, texts = {}, {}, {}
    for k, (_, text) in enumerate(docs):
        text = text or ""
        words = list(re.finditer(r"[^\W\d_]+", text))
        for w in {m[0].lower() for m in words}:
            having.setdefault(w, set()).add(k)
        own = pii.base_spans(text)
        free = [m for m in words if not any(a < m.end() and m.start() < b for a, _, b, _ in own)]
        for a, rank, b, value in own:
            sides = [m for m in words if m.end() <= a][-window:] + [m for m in words if m.start() >= b][:window]
            for m in sides:
                if m in free:
                    near.setdefault((rank, value), {}).setdefault(m[0].lower(), set()).add(k)
                    texts.setdefault(((rank, value), m[0].lower()), set()).add(text)
    out = {}
    for e, by in near.items():
        n_e = len(set().union(*by.values()))
        for w, rows in by.items():
            if len(texts[e, w]) > 1 and n_e < len(docs):
                share = math.log2(len(rows) * len(docs) / (n_e * len(having[w]))) / math.log2(len(docs) / n_e)
                if round(share, 9) >= generalise:
                    out[e, w] = share
    return out


def test_terms_against_the_definition(frame):
    """Entities beside long words, short terms, terms of one letter, and beside each other."""
    rng = random.Random(12)
    pool = [f"{'abcdefghij'[k % 10] * (k % 4 + 1)}{'xyz'[k % 3]}" for k in range(40)] + ["q" * 80, "r" * 95, "z", "李"]
    people = ["jo@ex.org", "1.2.3.4", "ann@ex.org", "+49 30 1234567"]
    docs = []
    for i in range(120):
        words = [rng.choice(pool) for _ in range(rng.randint(5, 40))]
        for _ in range(rng.choice([0, 0, 1, 2])):
            k = rng.randint(0, 3)
            at = rng.randint(0, len(words))
            words[at:at] = [people[k], *rng.sample([f"friend{'abcd'[k]}", "q" * 80, "vwmn"[k]], 2)]
        docs.append((i, " ".join(words)))
    want = informative(docs)
    rows = pii.digests(pii.scan(frame(docs))).collect()
    assert len(want) > 3 and {w for _, w in want} & {"v", "w"}
    for r in rows:
        text, terms, actions = dict(docs)[r.doc_id], set(), {}
        own = pii.base_spans(text)
        words = [m for m in re.finditer(r"[^\W\d_]+", text)]
        for a, rank, b, value in own:
            for m in [m for m in words if m.end() <= a][-6:] + [m for m in words if m.start() >= b][:6]:
                share = want.get(((rank, value), m[0].lower()))
                if share is not None and not any(x < m.end() and m.start() < y for x, _, y, _ in own):
                    terms.add((m.start(), m.end()))
                    actions[m.span()] = max(actions.get(m.span(), 0), share)
        assert {tuple(map(int, x.split(":")[1:])) for x in r.spans.split(",") if x.startswith("term")} == terms
        removed = sum(round(x, 9) >= 0.95 for x in actions.values())
        assert (r.n_generalised, r.n_removed) == (len(actions) - removed, removed)
        spans = sorted([(a, k, b, "mask") for a, k, b, _ in own] + [(*x[:1], 4, x[1], "remove" if round(v, 9) >= 0.95 else "generalise") for x, v in actions.items()])
        assert r.sanitised_sha256 == hashlib.sha256(pii.sanitised(text, spans).encode()).hexdigest()


def test_words_however_far_off():
    text = f"name {'x' * 200} {'y' * 300} me@ex.org é"
    assert {w for _, w, _, _ in pii.contexts(text, pii.base_spans(text), 6)} == {"name", "x" * 200, "y" * 300, "é"}


def test_document_counts(frame):
    got = {r.term: r.n for r in pii.document_counts(frame([(1, "One two two"), (2, "two three"), (3, None)]), most=1).collect()}
    assert got == {"one": 1, "two": 2, "three": 1}
