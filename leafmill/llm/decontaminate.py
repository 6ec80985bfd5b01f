"""Benchmark decontamination by suffix arrays of the training texts.

The training texts are taken in shards. A shard's suffix array holds its word positions in the order of
the words that follow, and every suffix of the test items is looked up in it by binary search: the
positions that begin with a suffix's window lie side by side. Only positions whose first two words follow
each other in some test item can be found by such a search, so only they are sorted. From the places found
follow the longest verbatim matches of each item, with their places in item and document.

Each shard lies within a task, so nothing is shuffled, and a document's answer doesn't depend on others.
Test items are a query set: they are written to the shared folder in blocks of about `block_chars` characters,
and each block passes over the shards, so what a task holds of them is bounded and the driver holds none.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from .common import filesystem, fresh_path, mapped, pieces, words

SHARD_BYTES, SLICE_BYTES = 8 << 20, 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FIND = re.compile(rb"[0-9a-z\x80-\xff]+").findall
_NONE = np.uint32(0xFFFFFFFF)


def _powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, _BASE)]))


def word_hashes(data: np.ndarray, is_word: np.ndarray = _IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of UTF-8 bytes: the words' 64-bit hashes, and where they begin and end; A-Z count as a-z unless other bytes
    than letters and digits make words. Works through slices that end between words."""
    hashes, begins, ends, at = [], [], [], 0
    while at < len(data):
        end = min(at + SLICE_BYTES, len(data))
        while end < len(data) and is_word[data[end - 1]] and is_word[data[end]]:
            more = np.flatnonzero(~is_word[data[end : end + SLICE_BYTES]])
            end = end + int(more[0]) if len(more) else min(end + SLICE_BYTES, len(data))
        part = data[at:end]
        inside = np.concatenate([[False], is_word[part], [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        b, e = edges[::2], edges[1::2]
        if len(b):
            lengths = e - b
            first = np.cumsum(lengths) - lengths
            chars = (_LOW[part[inside[1:-1]]] if is_word is _IS_WORD else part[inside[1:-1]]).astype(np.uint64) + np.uint64(1)
            place = np.arange(len(chars)) - np.repeat(first, lengths)
            sums = np.add.reduceat(chars * _powers(int(lengths.max()))[place], first)
            sums ^= sums >> np.uint64(31)
            hashes.append(sums * np.uint64(0xBF58476D1CE4E5B9))
            begins.append(b + at)
            ends.append(e + at)
        at = end
    join = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
    return join(hashes, np.uint64), join(begins, np.int64), join(ends, np.int64)


class Windows:
    """The windows of a block of test items: `size` words each, or a whole shorter item."""

    def __init__(self, items: list[tuple[str, str | None]], size: int):
        self.size, places = size, defaultdict(list)
        for k, (_, text) in enumerate(items):
            own = words(text)
            for at in range(max(1, len(own) - size + 1) if own else 0):
                places[tuple(own[at : at + size])].append((k, at))
        self.names = [name for name, _ in items]
        self.windows = sorted(places)
        #: The items of each window, and the windows of each item in its order.
        self.items: list[list[int]] = [sorted({k for k, _ in places[w]}) for w in self.windows]
        self.rows: list[dict[int, int]] = [{} for _ in items]
        for n, w in enumerate(self.windows):
            for k, at in places[w]:
                self.rows[k][at] = n
        self.texts: dict[int, Repeats] = {}
        vocabulary = sorted({w for window in self.windows for w in window})
        hashes = word_hashes(np.frombuffer(" ".join(vocabulary).encode(), np.uint8))[0]
        self.known = np.sort(np.unique(hashes))
        number = dict(zip(vocabulary, np.searchsorted(self.known, hashes) + 1, strict=True))
        n = len(self.windows)
        low, high = np.zeros((n, size), ">u4"), np.full((n, size), _NONE, ">u4")
        self.lengths = np.array([len(w) for w in self.windows], np.int64)
        for i, w in enumerate(self.windows):
            low[i, : len(w)] = high[i, : len(w)] = [number[x] for x in w]
        self.low, self.high = _keys(low), _keys(high)
        base = len(self.known) + 1
        self.pairs = np.unique(np.array([number[w[0]] * base + number[w[1]] for w in self.windows if len(w) > 1], np.int64))
        self.singles = np.unique(np.array([number[w[0]] for w in self.windows if len(w) == 1], np.int64))
        self.bytes = [tuple(x.encode() for x in w) for w in self.windows]

    def item(self, k: int) -> Repeats:
        """The automaton of an item's windows, made when a text first holds one of them."""
        if k not in self.texts:
            self.texts[k] = Repeats([self.rows[k][at] for at in range(len(self.rows[k]))])
        return self.texts[k]


class Repeats:
    """All substrings of a sequence (a suffix automaton), to find the longest that ends at each place of another."""

    def __init__(self, sequence: list[int]):
        self.next: list[dict[int, int]] = [{}]
        #: Of each state: where its substrings first end, the length of the longest, and the state of the next shorter ones.
        self.end, self.length, self.shorter = [-1], [0], [-1]
        last = 0
        for at, x in enumerate(sequence):
            state = self._add(at, self.length[last] + 1, {})
            while last >= 0 and x not in self.next[last]:
                self.next[last][x] = state
                last = self.shorter[last]
            if last < 0:
                self.shorter[state] = 0
            else:
                met = self.next[last][x]
                if self.length[met] > self.length[last] + 1:
                    copy = self._add(self.end[met], self.length[last] + 1, dict(self.next[met]), self.shorter[met])
                    while last >= 0 and self.next[last].get(x) == met:
                        self.next[last][x] = copy
                        last = self.shorter[last]
                    self.shorter[met] = copy
                    met = copy
                self.shorter[state] = met
            last = state

    def _add(self, end: int, length: int, following: dict[int, int], shorter: int = 0) -> int:
        self.next.append(following)
        self.end.append(end)
        self.length.append(length)
        self.shorter.append(shorter)
        return len(self.next) - 1

    def longest(self, sequence: list[int]) -> list[tuple[int, int, int]]:
        """(end there, end here, length) of the longest match that ends at each place, where it doesn't go on; each value of the sequence is known."""
        out, state, n = [], 0, 0
        for at, x in enumerate([*sequence, None]):
            if x is not None and x in self.next[state]:
                state, n = self.next[state][x], n + 1
                continue
            if n:
                out.append((at - 1, self.end[state], n))
            while state > 0 and x not in self.next[state]:
                state = self.shorter[state]
            if x is not None:
                n = self.length[state] + 1 if state else 1
                state = self.next[state][x]
        return out


def _keys(rows: np.ndarray) -> np.ndarray:
    """Rows of big-endian numbers as byte strings that sort like them. A last byte keeps trailing zeros."""
    n, width = len(rows), rows.shape[1] * 4
    if not n:
        return np.empty(0, f"S{width + 1}")
    out = np.full((n, width + 1), 1, np.uint8)
    out[:, :-1] = np.ascontiguousarray(rows).view(np.uint8).reshape(n, width)
    return out.reshape(-1).view(f"S{width + 1}")


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    return known[at] == values


class Shard:
    """Texts with the sparse suffix array of their words."""

    def __init__(self, texts: list[str | None], test: Windows):
        coded = [(t or "").encode() for t in texts]
        self.data = np.frombuffer(b"\0".join(coded), np.uint8)
        hashes, self.begins, self.ends = word_hashes(self.data)
        offsets = np.cumsum([0, *(len(x) + 1 for x in coded)])
        #: Of each text the number of its first word; one more for the end.
        self.first = np.searchsorted(self.begins, offsets)
        self.n_words = np.diff(self.first)
        n = len(hashes)
        ids = np.zeros(n, np.int64)
        if n and len(test.known):
            at = np.searchsorted(test.known, hashes)
            at[at == len(test.known)] = 0
            ids = np.where(test.known[at] == hashes, at + 1, 0)
        base = len(test.known) + 1
        may = _among(ids, test.singles) & (ids > 0)
        if n > 1:
            both = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
            may[both[_among(ids[both] * base + ids[both + 1], test.pairs)]] = True
        starts = np.flatnonzero(may)
        follow = starts[:, None] + np.arange(test.size)
        end = self.first[np.searchsorted(self.first, starts, "right")] if len(starts) else starts
        inside = follow < end[:, None]
        rows = np.where(inside, ids[np.minimum(follow, max(n - 1, 0))], 0).astype(">u4") if len(starts) else np.empty((0, test.size), ">u4")
        keys = _keys(rows)
        order = np.argsort(keys, kind="stable")
        self.suffixes, self.sorted = starts[order], keys[order]

    def find(self, test: Windows) -> tuple[np.ndarray, np.ndarray]:
        """(word position, window) of every occurrence, by binary search and then word by word."""
        lo, hi = np.searchsorted(self.sorted, test.low, "left"), np.searchsorted(self.sorted, test.high, "right")
        n = np.maximum(hi - lo, 0)
        window = np.repeat(np.arange(len(n)), n)
        rank = np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        place = self.suffixes[rank]
        same = np.fromiter((self._words(p, int(test.lengths[w])) == test.bytes[w] for p, w in zip(place.tolist(), window.tolist(), strict=True)), bool, len(place))
        return place[same], window[same]

    def _words(self, at: int, n: int) -> tuple[bytes, ...]:
        if at + n > len(self.ends):
            return ()
        return tuple(_FIND(_LOW[self.data[self.begins[at] : self.ends[at + n - 1]]].tobytes()))


def scan(texts: list[str | None], test: Windows) -> tuple[np.ndarray, np.ndarray, list[list[str]], list[list[dict]]]:
    """For each text: words, words hit, names of the items found, and the longest matches."""
    shard = Shard(texts, test)
    place, window = shard.find(test)
    covered = np.zeros(len(shard.begins) + 1, np.int64)
    np.add.at(covered, place, 1)
    np.add.at(covered, place + test.lengths[window], -1)
    hits = np.concatenate([[0], np.cumsum(np.cumsum(covered[:-1]) > 0)])
    n_hit = hits[shard.first[1:]] - hits[shard.first[:-1]]
    doc = np.searchsorted(shard.first, place, "right") - 1
    names: list[list[str]] = [[] for _ in texts]
    spans: list[list[dict]] = [[] for _ in texts]
    order = np.argsort(place, kind="stable")
    met: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
    for p, w, d in zip((place - shard.first[doc])[order].tolist(), window[order].tolist(), doc[order].tolist(), strict=True):
        for item in test.items[w]:
            met[d, item].append((p, w))
    for (d, item), own in met.items():
        size, at = int(test.lengths[own[0][1]]), 0
        for k in range(1, len(own) + 1):
            if k < len(own) and own[k][0] == own[k - 1][0] + 1:
                continue
            for here, there, n in test.item(item).longest([w for _, w in own[at:k]]):
                spans[d].append({"item_id": test.names[item], "item_start": there - n + 1, "doc_start": own[at][0] + here - n + 1, "n_words": n + size - 1})
            at = k
    for d, own in enumerate(spans):
        own.sort(key=lambda x: (x["doc_start"], x["item_id"], x["item_start"]))
        names[d] = sorted({x["item_id"] for x in own})
    return shard.n_words, n_hit, names, spans


def blocks(tests: DataFrame, block_chars: int) -> list[str]:
    """Folders of the shared folder, each with a block of the test items (item_id as text, text) as Parquet. Null ids count as empty."""
    spark = tests.sparkSession
    named = tests.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    total = named.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first().n
    n, path = max(1, math.ceil(total / block_chars)), fresh_path(spark, "items")
    block = named.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).cast("int"))
    block.repartition(n, "block").write.partitionBy("block").parquet(path)
    return [f"{path}/block={b}" for b in range(n)]


def _windows(path: str, size: int) -> Windows:
    """The windows of a block, read by a task; a worker keeps the last ones."""
    if (path, size) not in _LOADED:
        import pyarrow.parquet as pq
        from pyarrow.fs import FileSelector

        fs, at = filesystem(path)
        found = [x.path for x in fs.get_file_info(FileSelector(at, allow_not_found=True)) if x.path.endswith(".parquet")]
        items = [row for f in sorted(found) for row in pq.ParquetFile(fs.open_input_file(f)).read().to_pylist()]
        _LOADED.clear()
        _LOADED[path, size] = Windows(sorted((x["item_id"], x["text"]) for x in items if x["text"] is not None), size)
    return _LOADED[path, size]


_LOADED: dict[tuple[str, int], Windows] = {}


def contamination(docs: DataFrame, tests: DataFrame, size: int = 10, block_chars: int = 8_000_000) -> DataFrame:
    """The columns of `docs` but text, with n_words, n_hit (words inside any occurrence of a window of a test
    item), item_ids (sorted; those with a window there) and spans (item_id, item_start, doc_start, n_words, in
    words from 0): for each item and place of the document, the longest verbatim match that ends there, with
    the item's first place of it, unless the match goes on with the next word.

    A window is `size` consecutive words of an item, or all of a shorter one. Null and empty texts have no
    words, neither here nor there. Every row stands alone, so ties and repeated rows need no rule, and an
    empty table gives an empty one; columns of the result's own names are replaced. A text of any length is
    one document of one shard.
    """
    own = StructType().add("n_words", LongType()).add("n_hit", LongType()).add("item_ids", ArrayType(StringType()))
    own = own.add("spans", ArrayType(StructType().add("item_id", StringType()).add("item_start", LongType()).add("doc_start", LongType()).add("n_words", LongType())))
    kept = [c for c in docs.columns if c not in ("text", *own.names)]
    frame = docs.select(*[docs[c] for c in kept], docs["text"].alias("__text"))
    rest = StructType([f for f in frame.schema.fields if f.name != "__text"])
    sets = blocks(tests, block_chars)
    for k, path in enumerate(sets):
        last, first = k == len(sets) - 1, k == 0
        schema = StructType([*rest.fields, *own.fields, *([] if last else [frame.schema["__text"]])])
        frame = mapped(frame, _pass(path, size, kept, first, last), schema)
    return frame


def _pass(path, size, kept, first, last):
    types = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("item_id", pa.string()), ("item_start", pa.int64()), ("doc_start", pa.int64()), ("n_words", pa.int64())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "__text", SHARD_BYTES):
            texts = batch.column("__text").to_pylist()
            n_words, n_hit, names, spans = scan(texts, _windows(path, size))
            if not first:
                before = batch.column("spans").to_pylist()
                spans = [sorted([*a, *b], key=lambda x: (x["doc_start"], x["item_id"], x["item_start"])) for a, b in zip(before, spans, strict=True)]
                names = [sorted({*a, *b}) for a, b in zip(batch.column("item_ids").to_pylist(), names, strict=True)]
                n_hit = [_union(x) if n else 0 for x, n in zip(spans, map(len, spans), strict=True)]
            values = [pa.array(n_words, types[0]), pa.array(n_hit, types[1]), pa.array(names, types[2]), pa.array(spans, types[3])]
            arrays = [batch.column(c) for c in kept] + values + ([] if last else [batch.column("__text")])
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, "n_words", "n_hit", "item_ids", "spans", *([] if last else ["__text"])])

    return run


def _union(spans: list[dict]) -> int:
    """Words inside any of the spans, which are ordered by doc_start."""
    total, end = 0, 0
    for x in spans:
        a, b = max(end, x["doc_start"]), x["doc_start"] + x["n_words"]
        if b > a:
            total, end = total + b - a, b
    return total


def decontaminated(docs: DataFrame, tests: DataFrame, size: int = 10, block_chars: int = 8_000_000) -> DataFrame:
    """The rows of `docs` (with a text column) in which no window of a test item occurs."""
    out = docs
    for path in blocks(tests, block_chars):
        out = mapped(out, _clean(path, size), docs.schema)
    return out


def _clean(path, size):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", SHARD_BYTES):
            yield batch.filter(pa.array(scan(batch.column("text").to_pylist(), _windows(path, size))[1] == 0))

    return run


def items_digest(names: Column) -> Column:
    return F.sha2(F.array_join(names, ","), 256)

