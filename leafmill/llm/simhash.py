"""Near-duplicates by SimHash, found through a segment-popcount embedding.

A fingerprint is cut into 16 segments of 4 bits and mapped to their bit counts. Each differing bit moves
one count by one, so the Manhattan distance of two such points is a lower bound of the Hamming distance:
fingerprints at 2 or fewer bits lie at distance 2 or less on the grid. The range join runs over midpoints:
every point enters its own cell and the up to 32 cells one step away, and two points within 2 meet in one
of them. Pairs that meet are verified on all 64 bits.

Many near copies can crowd a cell. Cells with more than `dense` fingerprints make no pairs. Their
fingerprints are embedded again with segments of one bit, where the counts are the bits: again each enters
its own cell and those one step away, and whatever meets there is 2 bits apart at most, so one link to the
smallest of the cell joins all of them. Both ways are exact, and neither is quadratic in a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, mapped, pieces, saved

SEGMENTS, WIDTH, WITHIN = 16, 4, 2


def fingerprint(text: str | None, k: int = 3) -> int:
    """64 bits; bit b is set if it is set in over half of the XXH64s (seed 42) of the word shingles."""
    import xxhash

    tokens = [w for w in _split(ascii_lower(text))] if text else []
    if not tokens:
        return 0
    n = max(1, len(tokens) - k + 1)
    shingles = map(" ".join, zip(*(tokens[i:] for i in range(k)), strict=False)) if len(tokens) >= k else [" ".join(tokens)]
    one = xxhash.xxh64_intdigest
    hashes = np.fromiter((one(s, 42) for s in shingles), np.uint64, n)
    votes = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        part = hashes[at : at + (1 << 15)].astype("<u8")
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


_WHITE = {c: 32 for c in range(9, 14)}


def _split(text: str) -> list[str]:
    """Words between blanks, tabs and U+000A-U+000D only."""
    if any(c in text for c in "\t\n\x0b\x0c\r"):
        text = text.translate(_WHITE) if not text.isascii() else text.replace("\n", " ").replace("\t", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ")
    return [w for w in text.split(" ") if w]


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """The rows of `docs` as (doc_id, hash, fp): fp holds the 64 bits in a signed long, hash is the text's XXH64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            own = np.array([fingerprint(t.as_py(), k) for t in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("hash"), pa.array(own)], names=["doc_id", "hash", "fp"])

    return mapped(docs.select("doc_id", "text", F.xxhash64("text").alias("hash")), run, "doc_id bigint, hash bigint, fp bigint")


def _nibble(fp: Column, i: int) -> Column:
    return F.bit_count(F.shiftrightunsigned(fp, i * WIDTH).bitwiseAND(F.lit(15).cast("bigint"))).cast("bigint")


def links(distinct: DataFrame, dense: int = 48) -> DataFrame:
    """Links (a, b), a < b, of distinct fingerprints `fp` at 2 or fewer bits.

    Not every such pair is there, but each is joined by a path of links: see the module's text on crowded
    cells.
    """
    counts = [_nibble(F.col("fp"), i) for i in range(SEGMENTS)]
    own = sum((F.shiftleft(c, 3 * i) for i, c in enumerate(counts)), F.lit(0).cast("bigint"))
    steps = [F.when(c < WIDTH, F.lit(1 << (3 * i)).cast("bigint")) for i, c in enumerate(counts)] + [F.when(c > 0, F.lit(-(1 << (3 * i))).cast("bigint")) for i, c in enumerate(counts)]
    entered = distinct.select("fp", own.alias("point"), F.explode(F.filter(F.array(F.lit(0).cast("bigint"), *steps), lambda x: x.isNotNull())).alias("step")).select("fp", (F.col("point") + F.col("step")).alias("cell"))
    crowd = entered.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    crowd = saved(crowd, "cells")
    met = entered.join(crowd, "cell")
    sparse = met.where(F.col("n") <= dense).select("cell", "fp")
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    pairs = sparse.select("cell", F.col("fp").alias("a")).join(sparse.select("cell", F.col("fp").alias("b")), "cell").where((F.col("a") < F.col("b")) & (apart <= WITHIN)).select("a", "b")
    crowded = met.where(F.col("n") > dense).select("fp").distinct()
    flips = F.array(F.lit(0).cast("bigint"), *[F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("bigint") for i in range(64)])
    bits = crowded.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("cell"))
    least = bits.groupBy("cell").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("cell", "a")
    stars = bits.join(least, "cell").where("a < fp").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the smallest node that can be reached.

    Large-star and small-star steps in turn (Kiveris et al., 2014) until nothing changes. Each step is
    written to the shared folder, so that no lineage grows and a lost executor costs one step at most.
    """
    edges = saved(edges, "edges")
    total = edges.agg(F.count("*").alias("n"), F.sum(F.hash("a", "b").cast("bigint")).alias("h")).first()
    if not total.n:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(down, "b").select(F.col("m").alias("x"), F.when(F.col("a") == F.col("m"), F.col("b")).otherwise(F.col("a")).alias("y"))
        edges = saved(small.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct(), "edges")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.hash("a", "b").cast("bigint")).alias("h")).first()
        if now == total:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        total = now


def classes(docs: DataFrame, dense: int = 48) -> DataFrame:
    """For every row of `docs` (doc_id, text): doc_id, hash, fp, component_id, the smallest doc_id that links
    reach, its own included, and root, a fingerprint that names the component.

    Texts without words, null ones too, have fingerprint 0 and link like any other. Repeated rows and
    doc_ids are rows of their own; null doc_ids never become a component_id unless a component has no
    other. An empty table gives an empty one. Columns besides doc_id and text are left aside.
    """
    prints = saved(fingerprints(docs), "fingerprints")
    groups = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "groups")
    roots = components(links(groups.select("fp"), dense))
    linked = groups.join(roots, groups.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = linked.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("least").alias("component_id"))
    named = saved(linked.join(smallest, "root").select(F.col("fp").alias("of"), "component_id", "root"), "components")
    return prints.join(named, prints.fp == named.of).select("doc_id", "hash", "fp", "component_id", "root")


def deduplicated(docs: DataFrame, dense: int = 48) -> DataFrame:
    """One row of `docs` for each component: that of its smallest doc_id.

    Where a component has that doc_id more than once, the row of the smallest text hash stays, one of rows that
    repeat. Two components may share a doc_id; each keeps a row. Rows without a doc_id can't be told apart; they
    all stay.
    """
    found = classes(docs, dense).where(F.col("doc_id") == F.col("component_id"))
    first = found.groupBy("root", F.col("doc_id").alias("__id")).agg(F.min("hash").alias("__hash"), F.count("*").alias("__n"))
    keep = saved(first.select("__id", "__hash", "__n"), "kept")
    marked = docs.withColumn("__xx", F.xxhash64("text"))
    named = marked.join(keep.select("__id", "__hash"), (F.col("doc_id") == F.col("__id")) & (F.col("__xx") == F.col("__hash")), "left_semi")
    if keep.where(F.col("__n") > 1).limit(1).count():
        named = named.dropDuplicates(["doc_id", "__xx"])
    return named.drop("__xx").unionByName(docs.where(F.col("doc_id").isNull()))
