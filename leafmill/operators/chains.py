"""Chunks whose end depends on where they begin, cut without going through a document in one task.

A document is a sequence of pieces with sizes. From any piece on, its own chunk's end follows from the pieces
behind it alone, no further than a chunk reaches. So a document is dealt out in blocks of about `BLOCK` size,
each with as much of the next as a chunk that begins in it can need. Every block finds the next beginning for
each of its pieces at once, by searches in its running sums, and tells, for the few pieces at its front where a
chunk that comes from before it can end, where the chain leaves it and after how many chunks. These few rows are
followed from block to block; then every block knows where its first chunk begins and which number it has, and
puts its own chunks together.

Places within a document are running sums in two steps, of groups of pages and then within a group, so that no task
holds a document's pages either.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructType

from ..session import stored

BLOCK = 1 << 16


def running(rows: DataFrame, by: str, at: str, *values: str, tie: str | None = None, width: int = 256, how: Callable[[str], Column] = F.sum) -> DataFrame:
    """`rows` with before_<value> and all_<value> for each of `values`: its sum over the rows of the same `by` that
    stand before, in the order of the whole numbers `at` and of `tie`, and over all of them; with F.max for `how` the
    largest, 0 at least. Rows are put together by `width` numbers first, so a window holds those, or one row for each
    such group."""
    group = F.floor(F.col(at) / width).cast("bigint")
    totals = rows.groupBy(F.col(by).alias("__by"), group.alias("__g")).agg(*[how(v).alias(f"__{v}") for v in values])
    every = Window.partitionBy("__by")
    earlier = every.orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)
    sums = [(F.coalesce(how(f"__{v}").over(earlier), F.lit(0)).alias(f"__{v}"), how(f"__{v}").over(every).cast("bigint").alias(f"all_{v}")) for v in values]
    bases = totals.select("__by", "__g", *[c for pair in sums for c in pair])
    found = rows.join(bases, rows[by].eqNullSafe(F.col("__by")) & group.eqNullSafe(F.col("__g")))
    within = Window.partitionBy(by, "__g").orderBy(at, *([tie] if tie else [])).rowsBetween(Window.unboundedPreceding, -1)
    put = (lambda a, b: F.greatest(a, b)) if how is F.max else (lambda a, b: a + b)
    own = [put(F.col(f"__{v}"), F.coalesce(how(v).over(within), F.lit(0))).cast("bigint").alias(f"before_{v}") for v in values]
    return found.select(*rows.columns, *own, *[f"all_{v}" for v in values])


@dataclass
class Block:
    """Pieces in their order: the block's own, then those of the next that its chunks can reach."""

    own: int
    at: np.ndarray
    before: np.ndarray
    size: np.ndarray
    #: Pieces of the whole document.
    total: int
    #: All columns of pieces().
    rows: pa.Table

    @cached_property
    def sums(self) -> np.ndarray:
        """The size before each piece, and behind the last."""
        return np.append(self.before, self.before[-1] + self.size[-1])

    @cached_property
    def page(self) -> list:
        return self.rows.column("page").to_pylist()

    @cached_property
    def text(self) -> list:
        return self.rows.column("text").to_numpy().tolist()

    @cached_property
    def known(self) -> np.ndarray:
        return self.rows.column("known").to_numpy()

    @cached_property
    def heading(self) -> np.ndarray:
        """Whether `known` is true of each piece."""
        known = self.rows.column("known")
        return known.fill_null(False).to_numpy() if pa.types.is_boolean(known.type) else np.zeros(len(self.at), bool)

    def ends(self, end: int) -> bool:
        """Whether the document ends before this piece."""
        return int(self.at[0]) + end >= self.total


#: Of a block, for each of its own pieces: the piece at which the next chunk begins, by its index, that of the first
#: one behind for the end, and whether what begins at it is a chunk.
Follow = Callable[[Block], tuple[np.ndarray, np.ndarray]]
#: The chunks (columns of the result after doc_key) of a block's pieces [start, end), number, and carried title.
Emit = Callable[[Block, int, int, int, str | None], Iterator[tuple]]
_PIECES = "doc_key string, block bigint, ahead boolean, edge boolean, at bigint, before bigint, total bigint, page bigint, text string, size int"
#: Cuts texts into pieces: how many each has, and of all in their order texts, sizes and marks.
Cut = Callable[[list[str]], tuple[np.ndarray, list[str] | pa.Array, np.ndarray, pa.Array]]


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about `most` bytes in a column of texts, a row at least, and of 1,000 rows at most."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
        end = min(end, at + 1000, batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def _cut(pages: DataFrame, cut: Cut, mark: str) -> DataFrame:
    """Pages (doc_key, page, text), with their pieces as `p`, how many these are and the sum of their sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                counts, text, size, marks = cut(batch.column("text").fill_null("").to_pylist())
                own = pa.StructArray.from_arrays([pa.array(text, pa.string()), pa.array(size, pa.int32()), marks], names=["text", "size", "mark"])
                edges = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
                sums = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])[edges]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), own), pa.array(np.diff(edges)), pa.array(np.diff(sums))], names=["doc_key", "page", "p", "n", "m"])

    return pages.mapInArrow(run, f"doc_key string, page bigint, p array<struct<text: string, size: int, mark: {mark}>>, n bigint, m bigint")


def pieces(pages: DataFrame, made: Column | Cut, reach: int, block: int = BLOCK, mark: str = "boolean") -> DataFrame:
    """_PIECES of pages (doc_key, page, text), and their mark; `made` is a page's array of (text, size, mark), or cuts texts in batches
    into pieces with marks of the type `mark`. Pieces with `ahead` belong to the next block and are within `reach` of its beginning,
    those with `edge` are a page's first or last. Rows that repeat a page follow each other by their
    content. What a block's chunks can reach has to lie in the next one, so blocks are larger than that."""
    block = max(block, reach + 1)
    page = F.col("page").cast("bigint").alias("page")
    if isinstance(made, Column):
        rows = pages.select("doc_key", page, made.alias("p"))
        rows = rows.withColumn("n", F.size("p").cast("bigint")).withColumn("m", F.aggregate("p", F.lit(0).cast("bigint"), lambda a, x: a + x["size"]))
    else:
        rows = _cut(pages.select("doc_key", page, "text"), made, mark)
    # read for the sums and again for the texts, in two passes; tokens are made once
    rows = stored(rows.withColumn("h", F.xxhash64("p")))
    found = running(rows, "doc_key", "page", "n", "m", tie="h").where("n > 0").select("doc_key", "page", "p", "before_n", "before_m", F.col("all_n").alias("total"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                own = batch.column("p").flatten()
                n = batch.column("p").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                row, place, first = np.repeat(np.arange(len(n)), n), np.arange(n.sum()), np.cumsum(n) - n
                size = own.field("size").to_numpy(zero_copy_only=False)
                sums = np.cumsum(size, dtype=np.int64) - size
                before = (batch.column("before_m").to_numpy() - sums[first])[row] + sums
                at = (batch.column("before_n").to_numpy() - first)[row] + place
                number = before // block
                take = np.concatenate([place, np.flatnonzero((number > 0) & (before - number * block <= reach))])
                ahead = np.arange(len(take)) >= len(place)
                edge = (place == first[row]) | (place == (first + n - 1)[row])
                of, which = (lambda c: batch.column(c).take(pa.array(row[take]))), pa.array(take)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [of("doc_key"), pa.array(number[take] - ahead), pa.array(ahead), pa.array(edge[take]), pa.array(at[take]), pa.array(before[take]), of("total"), of("page"), *(own.field(c).take(which) for c in ("text", "size", "mark"))],
                    names=["doc_key", "block", "ahead", "edge", "at", "before", "total", "page", "text", "size", "mark"],
                )

    kind = rows.schema["p"].dataType.elementType["mark"].dataType.simpleString()
    return found.mapInArrow(run, f"{_PIECES}, mark {kind}")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str | None, int, list[tuple], Block]]:
    """(doc_key, block, entries, pieces) of rows that come by doc_key, block and kind, entries (at, number, title) first."""
    current, held = None, []
    for batch in batches:
        key = batch.column("doc_key").dictionary_encode(null_encoding="encode")
        code, number = key.indices.to_numpy(zero_copy_only=False), batch.column("block").to_numpy()
        edges = [0, *(np.flatnonzero((code[1:] != code[:-1]) | (number[1:] != number[:-1])) + 1).tolist(), batch.num_rows] if batch.num_rows else []
        for a, b in itertools.pairwise(edges):
            own = (batch.column("doc_key")[a].as_py(), int(number[a]))
            if held and own != current:
                yield from _block(*current, held)
                held = []
            current = own
            held.append(batch.slice(a, b - a))
    if held:
        yield from _block(*current, held)


def _block(key: str | None, number: int, parts: list[pa.RecordBatch]) -> Iterator[tuple[str | None, int, list[tuple], Block]]:
    rows = pa.Table.from_batches(parts).combine_chunks()
    n = int((rows.column("kind").to_numpy() == 0).sum())
    entries = list(zip(*(rows.column(c).slice(0, n).to_pylist() for c in ("at", "number", "title")), strict=True))
    rows = rows.slice(n)
    if rows.num_rows and not rows.column("ahead")[0].as_py():  # a long piece can leave a block without its own
        at, before, size = (rows.column(c).to_numpy().astype(np.int64) for c in ("at", "before", "size"))
        yield key, number, entries, Block(int((~rows.column("ahead").to_numpy()).sum()), at, before, size, rows.column("total")[0].as_py(), rows)


def chained(rows: DataFrame, follow: Follow, emit: Emit, schema: str, reach: int, size: int = BLOCK) -> DataFrame:
    """Chunks that `emit` makes of pieces() with the same reach and size, and a column known. `follow` says how chunks
    follow each other, and may look at the texts of pieces with `edge` unless known is boolean; title is the text of the
    last piece before a chunk whose `known` is true."""
    size = max(size, reach + 1)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    dealt = rows.select("doc_key", "block", F.lit(1).alias("kind"), "ahead", "edge", "at", "before", "total", "page", "text", "size", "known", F.lit(None).cast("bigint").alias("number"), F.lit(None).cast("string").alias("title"))

    def leaving(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Where the chain that enters a block at a piece leaves it, and after how many chunks; and its last heading."""
        for key, number, _, block in _blocks(batches):
            following, real = follow(block)
            out, count = following.tolist(), real.astype(int).tolist()
            for i in range(block.own - 1, -1, -1):
                if out[i] < block.own:
                    count[i], out[i] = count[i] + count[out[i]], out[out[i]]
            front = [0, *(np.flatnonzero(block.before[: block.own - 1] < number * size + reach) + 1).tolist()]
            # numbers go on without a gap, also behind the last piece that is seen
            ends = [int(block.at[0]) + out[i] for i in front]
            heading = max(np.flatnonzero(block.heading[: block.own]).tolist(), default=None)
            names = [None] * len(front) + ([block.text[heading]] if heading is not None else [])
            ats = [int(block.at[i]) for i in front] + ([int(block.at[heading])] if heading is not None else [])
            n = len(ats)
            yield pa.RecordBatch.from_arrays([pa.array([key] * n, pa.string()), pa.array([number] * n, pa.int64()), pa.array(ats, pa.int64()), pa.array([*ends, *[None] * (n - len(front))], pa.int64()), pa.array([*(count[i] for i in front), *[0] * (n - len(front))], pa.int64()), pa.array(names, pa.string())], names=["doc_key", "block", "at", "leaves", "chunks", "title"])

    order = ["doc_key", "block", "kind", "at"]
    # the first pass takes no texts along that it doesn't need
    needed = {BooleanType(): F.col("known"), DoubleType(): F.col("edge")}.get(rows.schema["known"].dataType, F.lit(False))
    fronts = dealt.withColumn("text", F.when(needed, F.col("text"))).drop("edge").repartition("doc_key", "block").sortWithinPartitions(*order).mapInArrow(leaving, "doc_key string, block bigint, at bigint, leaves bigint, chunks bigint, title string")

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pieces at which the chain of a document enters its blocks. Rows come by doc_key and place, titles first."""
        current, at, number, title = object(), 0, 0, None
        for batch in batches:
            found: list[tuple] = []
            for key, block, place, leaves, chunks, name in zip(*(batch.column(c).to_pylist() for c in ("doc_key", "block", "at", "leaves", "chunks", "title")), strict=True):
                if key != current:
                    current, at, number, title = key, 0, 0, None
                if leaves is None:
                    title = name
                elif place == at:
                    found.append((key, block, at, number, title))
                    at, number = leaves, number + chunks
            if found:
                keys, blocks, places, numbers, titles = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array(x, pa.int64()) for x in (blocks, places, numbers)), pa.array(titles, pa.string())], names=["doc_key", "block", "at", "number", "title"])

    # a heading's row comes before the entry behind it, after that of its own place
    entered = fronts.repartition("doc_key").sortWithinPartitions("doc_key", "at", F.col("leaves").isNull()).mapInArrow(through, "doc_key string, block bigint, at bigint, number bigint, title string")
    none = {c: F.lit(None).cast(dealt.schema[c].dataType) for c in ("ahead", "before", "total", "page", "text", "size", "known")}
    entries = entered.select("doc_key", "block", F.lit(0).alias("kind"), "at", "number", "title", *[v.alias(k) for k, v in none.items()])
    result = to_arrow_schema(_parse_datatype_string(schema))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, _, entries, block in _blocks(batches):
            if not entries:
                continue
            following, real = follow(block)
            at, number, title = entries[0]
            at -= int(block.at[0])
            last = np.maximum.accumulate(np.where(block.heading, np.arange(len(block.at)), -1))
            seen = 0
            out: list[tuple] = []
            while at < block.own:
                if at and last[at - 1] >= seen:
                    title = block.text[last[at - 1]]
                seen = at
                if real[at]:
                    out += [(key, *chunk) for chunk in emit(block, at, int(following[at]), number, title)]
                    number += 1
                at = int(following[at])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out, strict=True), result, strict=True)], schema=result)

    both = dealt.drop("edge").unionByName(entries)
    return both.repartition("doc_key", "block").sortWithinPartitions(*order).mapInArrow(cut, StructType.fromDDL(schema))
