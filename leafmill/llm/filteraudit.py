"""An audit of how five quality filters interact, in every order in which they could run.

Texts are scanned in the Arrow buffers that hold them. Byte classes give masks of white space, capitals,
symbols and continuation bytes; prefix sums over these count words, capitals and characters of all texts of a
batch at once. Words are hashed by differences of a prefix sum, sorted within their document, and equal
neighbours verified byte by byte, which counts the different ones. What fails is a mask of five bits.
The fifth filter, copies of earlier texts, is an aggregate by the text's digest, joined back.

Only counts by part and mask, 32 rows a part at most, meet the 120 orders: a document is removed by the
first filter of the order that its mask names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mapped, pieces, saved

LETTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 50, 65, 5, b"#$%&*|"
#: Bytes of text that are scanned at once, a longer text by itself. Arrays of a scan take about 60 times as much.
SCAN_BYTES = 2 << 20
_IN_WORD, _SYMBOL = np.ones(256, bool), np.zeros(256, bool)
_IN_WORD[[9, 10, 11, 12, 13, 32]] = False
_SYMBOL[list(SYMBOLS)] = True
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xBF58476D1CE4E5B9)


@cache
def _powers(n: int, base: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)]))


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """1, base, base squared and so on, n of them, modulo 2 to the 64."""
    return _powers(max(1 << 16, 1 << (n - 1).bit_length()), base)[:n] if n else np.empty(0, np.uint64)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of texts and where each begins, one more for the end; null is empty. Nothing is copied
    but for nulls."""
    texts = texts.fill_null("") if texts.null_count else texts
    _, offsets, data = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each text are flagged."""
    sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(flags, dtype=np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def distinct_words(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, doc: np.ndarray, n: int, base: int = _BASE) -> np.ndarray:
    """How many different words each of n texts has; words are bytes from begins to ends, doc tells whose they are."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data), base), dtype=np.uint64)])
    hashes = (sums[ends] - sums[begins]) * powers(len(data), pow(base, -1, 1 << 64))[begins] * _MIX
    order = np.lexsort((hashes, doc))
    a, b = order[:-1], order[1:]
    twin = (hashes[a] == hashes[b]) & (doc[a] == doc[b])
    a, b = a[twin], b[twin]
    length = ends - begins
    same = length[a] == length[b]
    # byte by byte, in slices of a few million bytes
    spans, at = np.cumsum(length[a]), 0
    while at < len(a):
        end = max(at + 1, int(np.searchsorted(spans, (spans[at - 1] if at else 0) + (1 << 20))))
        few = slice(at, end)
        size = np.where(same[few], length[a[few]], 0)
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        unlike = data[np.repeat(begins[a[few]], size) + inside] != data[np.repeat(begins[b[few]], size) + inside]
        same[few] &= np.bincount(np.repeat(np.arange(len(size)), size), unlike, len(size)) == 0
        at = end
    words = np.bincount(doc, minlength=n)
    found = words - np.bincount(doc[a], minlength=n)
    for k in np.unique(doc[a][~same]):
        own = doc == k
        found[k] = len({data[x:y].tobytes() for x, y in zip(begins[own], ends[own], strict=True)})
    return found


def scan(texts: pa.Array) -> dict[str, np.ndarray]:
    """Of each text: n_words, n_distinct, n_capitals, n_chars, n_symbols."""
    data, offsets = utf8(texts)
    inside = _IN_WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])))
    ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    first = np.searchsorted(begins, offsets)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    return {
        "n_words": np.diff(first),
        "n_distinct": distinct_words(data, begins, ends, doc, len(texts)),
        "n_capitals": per_text((data >= 65) & (data <= 90), offsets),
        "n_chars": per_text((data & 0xC0) != 0x80, offsets),
        "n_symbols": per_text(_SYMBOL[data], offsets),
    }


def failed(found: dict[str, np.ndarray]) -> np.ndarray:
    """The mask of a scan: bit i is set where filter i fails, for the filters that look at one text."""
    fails = [
        found["n_words"] < LEAST_WORDS,
        100 * found["n_distinct"] < LEAST_DISTINCT * found["n_words"],
        100 * found["n_capitals"] > MOST_CAPITALS * found["n_chars"],
        found["n_symbols"] > 0,
    ]
    return sum(f.astype(np.int32) << i for i, f in enumerate(fails))


def scanned(docs: DataFrame) -> DataFrame:
    """For every row of `docs` (doc_id, source, text): doc_id, part, digest (SHA-256 of the text), counts of scan()
    and the mask of filters A to D."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", SCAN_BYTES):
            found = scan(batch.column("text"))
            counts = {k: pa.array(v.astype(np.int64)) for k, v in found.items()} | {"mask": pa.array(failed(found))}
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("part"), batch.column("digest"), *counts.values()], names=["doc_id", "part", "digest", *counts])

    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    return mapped(rows, run, "doc_id bigint, part string, digest binary, n_words bigint, n_distinct bigint, n_capitals bigint, n_chars bigint, n_symbols bigint, mask int")


def masks(docs: DataFrame) -> DataFrame:
    """For every row of `docs` (doc_id, source, text), others left aside: doc_id, part, the counts of scan() and
    mask, whose bits 0 to 4 are set where filters A to E fail.

    A null text is an empty one, a null source the part "". E fails where a smaller doc_id has the same text
    anywhere in the table; rows that repeat a doc_id and its text are no copies of each other, and a row without
    doc_id neither is a copy nor makes one. An empty table gives an empty one. A text is scanned as a whole.
    """
    rows = saved(scanned(docs), "scans")
    # counted before it is dealt out, so copies of one text are a row a task; only texts with copies come back
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("digest", "first")
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    marked = F.when(copy, F.col("mask").bitwiseOR(F.lit(1 << 4))).otherwise(F.col("mask"))
    return rows.join(first, "digest", "left").withColumn("mask", marked).drop("digest", "first")


def _orders() -> Column:
    """filter_order, and its five steps: the filter's bit, and the bits of those before it."""
    rows = []
    for order in permutations(range(len(LETTERS))):
        name = "".join(LETTERS[i] for i in order)
        rows += [F.struct(F.lit(name).alias("filter_order"), F.lit(s + 1).alias("step"), F.lit(1 << i).alias("bit"), F.lit(sum(1 << j for j in order[:s])).alias("before")) for s, i in enumerate(order)]
    return F.array(*rows)


def audit(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for every part, filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost
    and shapley, all counts of rows of `masked` (doc_id, part, mask).

    `labels` is (doc_id, quality, toxic). A document with several rows of labels is good if any has quality 1
    and toxic if any has toxic 1; one without has neither. shapley adds up what the step's filter removes over all
    orders: a document that fails m filters is removed first by each of them in 120 / m.
    """
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    rows = masked.select("doc_id", "part", "mask").join(known, "doc_id", "left")
    counts = rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("m"))

    def total(value: str, condition: str) -> Column:
        return F.expr(f"aggregate(m, 0L, (a, x) -> if({condition}, a + {value}, a))")

    at = parts.select("part", "m", F.inline(_orders()))
    here = "(x.mask & bit) <> 0 and (x.mask & before) = 0"
    return at.select(
        "part",
        "filter_order",
        "step",
        total("x.n", "(x.mask & (before | bit)) = 0").alias("kept"),
        total("x.n", here).alias("removed"),
        total("x.n", "(x.mask & bit) <> 0 and (x.mask & before) <> 0").alias("redundant"),
        total("x.n", "x.mask = bit").alias("unique_fails"),
        total("x.good", here).alias("good_lost"),
        total("x.toxic", here).alias("toxic_lost"),
        total("x.n * cast(120 div bit_count(x.mask) as bigint)", "(x.mask & bit) <> 0").alias("shapley"),
    )


def sql() -> str:
    """The audit in SQL for DuckDB."""
    places = range(1, len(LETTERS) + 1)
    tables = ", ".join(f"f AS f{i}" for i in places)
    unlike = " AND ".join(f"f{i}.x <> f{j}.x" for i in places for j in places if i < j)
    names = " || ".join(f"f{i}.x" for i in places)
    return f"""WITH f AS (SELECT unnest({list(LETTERS)!r}) AS x),
orders AS (SELECT {names} AS filter_order FROM {tables} WHERE {unlike}),
steps AS (SELECT filter_order, step, substr(filter_order, step, 1) AS x, substr(filter_order, 1, step - 1) AS before FROM orders, (SELECT unnest(range(1, 6))::INT AS step)),
d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
flags AS (SELECT doc_id, part, CASE WHEN len(w) < {LEAST_WORDS} THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < {LEAST_DISTINCT} * len(w) THEN 'B' ELSE '' END
  || CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > {MOST_CAPITALS} * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
  || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM flags LEFT JOIN l USING (doc_id) GROUP BY ALL),
e AS (SELECT *, contains(fails, x) AS hit, len(list_intersect(string_split(fails, ''), string_split(before, ''))) > 0 AND before <> '' AND fails <> '' AS gone FROM c, steps)
SELECT part, filter_order, step, coalesce(sum(n) FILTER (WHERE NOT hit AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE hit AND NOT gone), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (WHERE hit AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE fails = x), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (WHERE hit AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (WHERE hit AND NOT gone), 0)::BIGINT AS toxic_lost,
  sum(coalesce(sum(n) FILTER (WHERE hit AND NOT gone), 0)) OVER (PARTITION BY part, x)::BIGINT AS shapley
FROM e GROUP BY part, filter_order, step, x"""
