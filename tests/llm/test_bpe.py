import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from leafmill.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def both():
    return bpe.WordBpe(PATH), Tokenizer.from_file(PATH)


def expected(tokenizer, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    return len(ids), " ".join(map(str, ids)), tokenizer.decode(ids, skip_special_tokens=False)


def test_every_character_up_to_u3000(both):
    own, tokenizer = both
    for c in range(0x3000):
        for text in (chr(c), f"a{chr(c)}B1"):
            assert own.encode(text) == expected(tokenizer, text), hex(c)


def test_random_texts(both):
    own, tokenizer = both
    rng = random.Random(1)
    parts = ["aaaa", "ab", "'s", "'LL", "é", "é", "  ", "\n", "12", "Σ", "ΑΣ", "<|endoftext|>", "<|", "x" * 30, "the", "ing", "!!", "日本", "ß", "ﬁ", "Å"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        assert own.encode(text) == expected(tokenizer, text), text


def merged(word, ranks, end):
    """BPE as it is defined: the first of the best pairs, again and again."""
    symbols = [*word[:-1], word[-1] + end]
    while len(symbols) > 1:
        rank, i = min((ranks.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)))
        if rank == 1 << 60:
            break
        symbols[i : i + 2] = ["".join(symbols[i : i + 2])]
    return symbols


@pytest.mark.parametrize("end", ["", "</w>"])
def test_automata_of_random_merges(end):
    rng = random.Random(3)
    for _ in range(60):
        tokens = ["a", "b", "c"] + (["a" + end, "b" + end, "c" + end] if end else [])
        merges, made = [], set(tokens)
        for _ in range(rng.randint(1, 25)):
            u, v = rng.choice(tokens), rng.choice(tokens)
            if u.endswith(end) and end or u + v in made:
                continue
            merges.append((u, v))
            tokens.append(u + v)
            made.add(u + v)
        automaton = bpe.MergeAutomaton({t: i for i, t in enumerate(tokens)}, merges, end)
        ranks = {m: i for i, m in enumerate(merges)}
        for _ in range(60):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))
            assert [automaton.labels[i] for i in automaton.encode(word)] == merged(word, ranks, end), (merges, word)


def test_tables_are_deterministic(both):
    """At each place of a word one label at most has its arc, so no sweep can turn back; and arcs asked for stay."""
    automaton = both[0].automaton
    rng = random.Random(9)
    for _ in range(2000):
        word = "".join(rng.choice("etaoinshrdlu'1") for _ in range(rng.randint(1, 14)))
        symbols = word[:-1] + automaton.final[word[-1]]
        last = [-1]
        for k in range(1, len(symbols) + 1):
            at = 0
            for c in symbols[:k]:
                while c not in automaton.goto[at] and at:
                    at = automaton.fall[at]
                at = automaton.goto[at].get(c, 0)
            fit = [t for t, n in automaton.outs[at] if (n == k if last[k - n] < 0 else automaton.arc(last[k - n], t))]
            assert len(fit) == 1, (word, k)
            last += fit
        assert automaton.encode(word)[-1] == last[-1]


def test_merges_that_make_no_automaton():
    with pytest.raises(ValueError):
        bpe.MergeAutomaton({"a": 0, "b": 1, "ab": 2, "aba": 3}, [("ab", "a"), ("a", "b")])


def test_documents(both, frame, odd):
    _, tokenizer = both
    got = bpe.encode_documents(frame(odd).withColumnRenamed("score", "ids"), PATH)
    rows = sorted((r.doc_id is not None, r.doc_id, r.n_tokens, r.ids, r.decoded) for r in got.collect() if r.doc_id != 4)
    assert rows == sorted((i is not None, i, *expected(tokenizer, t)) for i, t in odd if i != 4)
    assert got.columns.count("ids") == 1 and "source" in got.columns
    digest = bpe.encode_documents(frame(odd), PATH, digests=True).where("doc_id = 10").first()
    assert digest.ids_sha256 == hashlib.sha256(expected(tokenizer, dict(odd)[10])[1].encode()).hexdigest()
    assert bpe.encode_documents(frame([]), PATH).collect() == []


def test_decode(both):
    own, tokenizer = both
    ids = tokenizer.encode("Hello wörld <|endoftext|>", add_special_tokens=False).ids
    assert own.decode(ids) == tokenizer.decode(ids, skip_special_tokens=False)
