"""BPE encoding and decoding by a tokenization automaton.

The merges are compiled, in their order, into a deterministic automaton whose arcs carry tokens. It starts
with one state per base symbol and an arc from every state for every symbol. Merge number i, (u, v) -> w,
adds one gadget: wherever u then v could be read, an arc w bypasses them, and arc v leaves the state behind
u; where they never could, nothing changes. A state is thus named by the token read last. The new state w starts with the arcs that state v has
then, and the new arc w starts at the states that have arc u then; later gadgets change each on its own.
`MergeAutomaton` keeps these as tables: for each token the states it inherits its arcs from and the arcs
it inherits its origins from, with the number of the gadget that parted them. An arc b at state a is there
unless some gadget cut it between such an ancestor of a and such an ancestor of b before they parted.

A token sequence is what BPE makes of its text exactly if the automaton accepts it, and each prefix of a
word has one accepted path. So a word is encoded by one sweep over its symbols that never turns back: a table
of tokens' symbols (goto, fall-back and the tokens that end there) says which labels could end at a place, and
the arc from the state where such a label begins says whether it does; just one has its arc. All arcs of a
vocabulary of 49,000 tokens would be 2.4 billion table entries, so the table of arcs holds those that words
asked for, each worked out from its gadgets once. Decoding emits the labels of the arcs that the ids name.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructType
from tokenizers import Tokenizer

from .common import mapped, pieces

_END = 1 << 60
_FIRST, _SECOND, _THIRD = map(itemgetter, range(3))


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself, or else the next one from U+0100 on."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    hidden = {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in shown)}
    return [chr(hidden.get(b, b)) for b in range(256)]


class MergeAutomaton:
    """Built from a vocabulary {token: id}, its merges in order, and what marks a word's last symbol.

    Raises ValueError if a token comes from two merges or is merged before it is made: such lists don't
    describe one automaton.
    """

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], end: str = ""):
        self.vocabulary, self.end, n = vocabulary, end, len(vocabulary)
        self.labels = {i: t for t, i in vocabulary.items()}
        #: Behind each token's state: (ancestor, gadget that parts them); before each arc alike.
        states: dict[int, tuple[tuple[int, int], ...]] = {i: ((i, _END),) for i in vocabulary.values()}
        arcs = dict(states)
        cuts: dict[tuple[int, int], int] = {}
        made: dict[int, int] = {}
        #: Tokens whose two parts never stand side by side when their merge comes; no arc carries them.
        dead: set[int] = set()
        for i, (left, right) in enumerate(merges):
            u, v, w = vocabulary[left], vocabulary[right], vocabulary[left + right]
            if w in made or w in (u, v) or (u, v) in cuts:
                raise ValueError(f"merge {i} makes {left + right!r} again")
            if u in dead or v in dead or any((c := cuts.get((x, y))) is not None and c < parted and c <= begun for x, parted in states[u] for y, begun in arcs[v]):
                dead.add(w)
                made[w] = i
                continue
            cuts[u, v] = made[w] = i
            states[w] = ((w, _END), (v, i), *states[v][1:])
            arcs[w] = ((w, _END), (u, i), *arcs[u][1:])
        for i, (left, right) in enumerate(merges):
            u, v = vocabulary[left], vocabulary[right]
            if made.get(u, -1) >= i or made.get(v, -1) >= i:
                raise ValueError(f"merge {i} comes before its parts")
        if dead:
            self.vocabulary = {t: i for t, i in vocabulary.items() if i not in dead}
        self.cuts = {u * n + v: i for (u, v), i in cuts.items()}
        self.states, self.arcs, self.n = states, arcs, n
        self.seen: dict[int, bool] = {}
        self._tables()

    def _tables(self) -> None:
        """goto: from each place of the tokens' symbols the next; fall: the place of the longest other one that
        ends alike; outs: the tokens that end there and their lengths, longest first. A word's last symbol is
        one of its own."""
        self.final = {c: chr(0xF0000 + i) for i, c in enumerate(sorted({t.removesuffix(self.end)[-1:] for t in self.vocabulary} - {""}))} if self.end else {}
        self.goto: list[dict[str, int]] = [{}]
        own = [-1]
        for token, i in self.vocabulary.items():
            symbols = token
            if self.end and token.endswith(self.end) and len(token) > len(self.end):
                symbols = token[: -len(self.end)]
                symbols = symbols[:-1] + self.final[symbols[-1]]
            at = 0
            for c in symbols:
                if c not in self.goto[at]:
                    self.goto[at][c] = len(own)
                    self.goto.append({})
                    own.append(-1)
                at = self.goto[at][c]
            own[at] = i
        self.fall, self.outs, lengths = [0] * len(own), [()] * len(own), [0] * len(own)
        queue = [0]
        for at in queue:
            for c, to in self.goto[at].items():
                lengths[to] = lengths[at] + 1
                back = self.fall[at]
                while at and back and c not in self.goto[back]:
                    back = self.fall[back]
                self.fall[to] = self.goto[back].get(c, 0) if at else 0
                shorter = self.outs[self.fall[to]]
                self.outs[to] = ((own[to], lengths[to]), *shorter) if own[to] >= 0 else shorter
                queue.append(to)

    def arc(self, state: int, label: int) -> bool:
        """Whether the automaton has this arc. Of equal merges the leftmost goes first, hence < and <=."""
        key = state * self.n + label
        known = self.seen.get(key)
        if known is None:
            if len(self.seen) >= 500_000:
                self.seen.clear()
            cuts, n = self.cuts, self.n
            known = self.seen[key] = not any(
                (cut := cuts.get(x * n + y)) is not None and cut < parted and cut <= begun
                for x, parted in self.states[state]
                for y, begun in self.arcs[label]
            )
        return known

    def encode(self, word: str) -> list[int]:
        """Ids of a pre-split word that is written in the vocabulary's symbols, in one sweep."""
        goto, fall, outs, seen, n = self.goto, self.fall, self.outs, self.seen, self.n
        if self.end and word:
            word = word[:-1] + self.final.get(word[-1], "\U000fffff")
        #: The label that ends at each place, and its length: the state reached there.
        last, sizes, at = [-1], [0], 0
        for k, c in enumerate(word, 1):
            to = goto[at].get(c)
            while to is None and at:
                at = fall[at]
                to = goto[at].get(c)
            at = to or 0
            for token, size in outs[at]:
                state = last[k - size]
                if state < 0:
                    if size == k:
                        break
                elif (known := seen.get(state * n + token)) or known is None and self.arc(state, token):
                    break
            else:
                # a symbol that starts no token: a merge's part, or one that is unknown
                token, size = -1, 1
            last.append(token)
            sizes.append(size)
        path, at = [], len(word)
        while at:
            if last[at] < 0:
                raise ValueError(f"no tokens for {word!r}")
            path.append(last[at])
            at -= sizes[at]
        return path[::-1]


class Memo(dict):
    """What a function makes of words: made when first asked for, or taken over from the memo before, whose
    own is dropped. So the words last used are kept, in two generations."""

    def __init__(self, make, before: dict):
        super().__init__()
        self.make, self.before = make, dict(before)

    def __missing__(self, word: str):
        found = self[word] = self.before.get(word) or self.make(word)
        return found


class WordBpe:
    """Reads a tokenizer file of the tokenizers library of this kind: NFC, white space to one blank, lower
    case, words by a pattern, bytes as symbols, BPE with a mark at each word's end, no decoder."""

    def __init__(self, path: str, cache: int = 200_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or spec["decoder"] or model["continuing_subword_prefix"]:
            raise ValueError(f"{path} is another kind of tokenizer")
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = MergeAutomaton(model["vocab"], merges, model["end_of_word_suffix"] or "")
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.labels = self.automaton.labels | {i: t for t, i in self.added.items()}
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        split = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        whole = Tokenizer.from_file(path)
        self.normalize, self.split = whole.normalizer.normalize_str, whole.pre_tokenizer.pre_tokenize_str
        self.find = re.compile(_latin(split)).findall
        self.symbols = byte_symbols()
        self.bytes = {c: b for b, c in enumerate(self.symbols)}
        self.cache, self.memo = cache, Memo(self._word, {})

    def _word(self, word: str) -> tuple[int, str, str]:
        """(number of ids, ids, labels) of a word, joined by blanks."""
        ids = self.automaton.encode(word if word.isascii() and word.isprintable() else "".join(map(self.symbols.__getitem__, word.encode())))
        return len(ids), " ".join(map(str, ids)), self.decode(ids)

    def words(self, text: str) -> list[str]:
        """The words of a text. Beyond U+00FF it depends on the library's Unicode version which characters
        are letters and how they compose, so there the library normalises and splits."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            byte = self.bytes.__getitem__
            return [bytes(map(byte, word)).decode() for word, _ in self.split(self.normalize(text))]
        return self.find(text.lower())

    def encode(self, text: str) -> tuple[int, str, str]:
        """(number of ids, ids joined by blanks, decoded text)."""
        if len(self.memo) > self.cache:
            self.memo = Memo(self._word, self.memo)
        parts = self.split_added.split(text) if self.split_added and any(x in text for x in self.added) else [text]
        found = []
        for k, part in enumerate(parts):
            found += [(1, str(self.added[part]), self.decode([self.added[part]]))] if k % 2 else map(self.memo.__getitem__, self.words(part))
        return sum(map(_FIRST, found)), " ".join(map(_SECOND, found)), " ".join(map(_THIRD, found))

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs that the ids name, special ones too, joined as without a decoder; ids unknown are skipped."""
        return " ".join(self.labels[i] for i in ids if i in self.labels)


def _latin(pattern: str) -> str:
    """The pattern with its classes spelt out for characters up to U+00FF."""
    return pattern.replace(r"\p{L}", "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff").replace(r"\p{N}", "0-9\xb2\xb3\xb9\xbc-\xbe").replace(r"\s", r"\t-\r\x20\x85\xa0")


_LOADED: dict[str, WordBpe] = {}


def encode_documents(docs: DataFrame, path: str, text: str = "text", digests: bool = False) -> DataFrame:
    """The columns of `docs` without the text, with n_tokens, and ids and decoded (or their sha256 as
    ids_sha256 and decoded_sha256 if `digests`).

    A null text is an empty one, with no ids. Any other column may be null or repeat; columns of the
    result's own names are replaced. Each row stands alone, so the order and the number of equal rows
    don't matter; an empty table gives an empty table. A text of any length is one value.
    """
    names = ["n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))]
    kept = [c for c in docs.columns if c not in (text, *names)]
    frame = docs.select(*[docs[c] for c in kept], docs[text].alias("__text"))
    schema = StructType([f for f in frame.schema.fields if f.name != "__text"])
    for name in names:
        schema = schema.add(name, LongType() if name == "n_tokens" else StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _LOADED:
            _LOADED[path] = WordBpe(path)
        bpe = _LOADED[path]
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in pieces(batches, "__text"):
            done = [bpe.encode(t.as_py() or "") for t in batch.column("__text")]
            own = [pa.array([x[0] for x in done], pa.int64()), *(pa.array([sha(x[k]) if digests else x[k] for x in done], pa.string()) for k in (1, 2))]
            rest = [batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*rest, *own], names=[*kept, *names])

    return mapped(frame, run, schema)
