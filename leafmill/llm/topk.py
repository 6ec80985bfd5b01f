"""Exact top-k by inner product of integer vectors: a Voronoi join of queries and data.

Pivots, chosen from the data by hash, cut the space into cells; every vector belongs to the cell of its nearest
pivot. Cells are cut into blocks of bounded size, and a block is what one task holds at a time. First each
query is solved in its own cell, which gives it a score that its k-th best can't fall below. Then summaries of the
cells (radius, largest norm) and of the queries that live in each (radius, largest norm, lowest such score) bound what
a group of queries can find in a cell: by the triangle inequality a query q and a vector x of the cell with pivot p and
radius r are |q - p| - r apart at least, and 2 qx = |q|^2 + |x|^2 - |q - x|^2. Where the bound of a group
reaches its score, each query is bounded on its own, also by qp + |q| r and by |q| |x|, and those that still reach
theirs are replicated to the cell's blocks. Queries are few beside the data, so they travel and the data doesn't.

Copies of one vector can be a third of a table. Of rows with the same vector only the k + 1 smallest vec_ids can
be results, and the same query vector is searched once, for k + 1 results, of which each query drops its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mapped, saved

#: Rows of a cell that are wanted, the most pivots, and rows of a block, which a task holds.
CELL_ROWS, MOST_PIVOTS, BLOCK_ROWS = 2048, 1024, 16_384
_EXACT = 2.0**53
_QUERY = "qid bigint, qh bigint, vec array<bigint>"


def quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, vec): `vectors` (vec_id, embedding) with each component x as floor(256 x). Vectors that are null
    or hold a null or a component that isn't finite are left out, and so are rows without a vec_id."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    rows = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad)
    return rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("vec"))


def matrix(column: pa.Array, width: int = 0) -> np.ndarray:
    """Lists as rows of a matrix of 64-bit integers; missing components are 0."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    most = max(width, int(lengths.max()) if len(lengths) else 0)
    if len(lengths) and (lengths == most).all():
        return flat.reshape(len(lengths), most)
    out = np.zeros((len(lengths), most), np.int64)
    out[np.arange(most) < lengths[:, None]] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, exact: in doubles where all sums are whole numbers that these hold, else in Python's
    integers, limited to what 64 bits hold."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    most = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * width
    if most < _EXACT:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    limits = np.iinfo(np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, limits.min, limits.max).astype(np.int64)


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest scores of each row, best first, ties to the first column."""
    n = scores.shape[1]
    if n > 4 * k and float(np.abs(scores.astype(float)).max(initial=0)) * n < _EXACT:
        key = scores * n - np.arange(n)
        few = np.argpartition(-key, k, axis=1)[:, :k]
        return np.take_along_axis(few, np.argsort(-np.take_along_axis(key, few, 1), axis=1), 1)
    # the largest stays first when signs are turned, but for the smallest 64-bit integer
    return np.argsort(-np.maximum(scores, -np.iinfo(np.int64).max), axis=1, kind="stable")[:, :k]


@dataclass
class Cells:
    """Pivots and, once known, each cell's radius, largest norm, and blocks."""

    pivots: np.ndarray
    radius: np.ndarray | None = None
    norm: np.ndarray | None = None
    blocks: np.ndarray | None = None

    def __post_init__(self) -> None:
        self.points = self.pivots.astype(float)

    def distances(self, vec: np.ndarray) -> np.ndarray:
        """From every vector to every pivot. Rounding can make them too small or large by a little."""
        vec, points = _even(vec.astype(float), self.points)
        squares = (vec * vec).sum(1)[:, None] + (points * points).sum(1)[None, :] - 2 * (vec @ points.T)
        return np.sqrt(np.maximum(squares, 0.0))

    def first(self) -> np.ndarray:
        """The number of each cell's first block."""
        return np.cumsum(self.blocks) - self.blocks


def _even(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))


def _norms(vec: np.ndarray) -> np.ndarray:
    return np.sqrt((vec.astype(float) ** 2).sum(1))


def assigned(rows: DataFrame, cells: Cells) -> DataFrame:
    """Rows with a column `vec`, and the cell of each, its distance from the pivot, and its norm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = matrix(batch.column("vec"))
            apart = cells.distances(vec)
            cell = apart.argmin(1) if len(vec) else np.empty(0, np.int64)
            far = apart[np.arange(len(vec)), cell]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(far), pa.array(_norms(vec))], names=[*batch.schema.names, "cell", "far", "norm"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return mapped(rows, run, f"{kinds}, cell int, far double, norm double")


def _above(x: np.ndarray) -> np.ndarray:
    """A bound made a little larger than rounding could have made it too small."""
    return x + 1 + np.abs(x) * 1e-9


def reached(queries: DataFrame, cells: Cells, groups: np.ndarray) -> DataFrame:
    """(block, qid, qh, vec): queries (qid, qh, vec, cell, norm, least) for each block of a cell other than their own
    in which they may find a score of `least` or more. Groups are bounded first: groups[cell] is the radius of the
    queries there, their largest norm and their lowest `least`."""
    radius, largest, lowest = groups.T
    between = np.maximum(cells.distances(cells.pivots) - radius[:, None] - cells.radius[None, :], 0.0)
    open_to = _above((largest[:, None] ** 2 + cells.norm[None, :] ** 2 - between**2) / 2) >= lowest[:, None]
    np.fill_diagonal(open_to, False)
    open_to &= cells.blocks[None, :] > 0
    start = cells.first()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                vec, norm = matrix(batch.column("vec")), batch.column("norm").to_numpy()[:, None]
                own, least = batch.column("cell").to_numpy(), batch.column("least").to_numpy()[:, None]
                q, p = _even(vec.astype(float), cells.points)
                near = np.maximum(cells.distances(vec) - cells.radius[None, :], 0.0)
                most = np.minimum(q @ p.T + norm * cells.radius[None, :], norm * cells.norm[None, :])
                most = np.minimum(most, (norm**2 + cells.norm[None, :] ** 2 - near**2) / 2)
                row, cell = np.nonzero(open_to[own] & (_above(most) >= least))
                times = cells.blocks[cell]
                block = np.repeat(start[cell] - np.cumsum(times) + times, times) + np.arange(times.sum())
                row = np.repeat(row, times)
                for part in range(0, len(row), 4096):
                    take = pa.array(row[part : part + 4096])
                    yield pa.RecordBatch.from_arrays([pa.array(block[part : part + 4096], pa.int32()), *[batch.column(c).take(take) for c in ("qid", "qh", "vec")]], names=["block", "qid", "qh", "vec"])

    return mapped(queries, run, f"block int, {_QUERY}")


def solved(data: DataFrame, queries: DataFrame, k: int, blocks: int) -> DataFrame:
    """(qid, qh, vec_id, score): the k best rows of its block (block, vec_id, vec) for every query (block, qid, qh,
    vec). Rows come to a task block by block, the data first, then its queries, a few at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, ids, parts, rows = None, [], [], None
        for batch in batches:
            block, query = batch.column("block").to_numpy(), batch.column("query").to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (query[1:] != query[:-1])])) if len(block) else []
            for b, e in zip(edges, [*edges[1:], len(block)], strict=True):
                part = batch.slice(b, e - b)
                if block[b] != current:
                    current, ids, parts, rows = block[b], [], [], None
                if not query[b]:
                    ids.append(part.column("qid").to_numpy())
                    parts.append(matrix(part.column("vec")))
                    continue
                if not ids:
                    continue
                if rows is None:
                    width = max(x.shape[1] for x in parts)
                    names = np.concatenate(ids)
                    order = np.argsort(names, kind="stable")
                    names, rows = names[order], np.concatenate([np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in parts])[order]
                for at in range(0, part.num_rows, 256):
                    few = part.slice(at, 256)
                    scores = products(matrix(few.column("vec")), rows)
                    take = best(scores, k)
                    again = pa.array(np.repeat(np.arange(few.num_rows), take.shape[1]))
                    yield pa.RecordBatch.from_arrays([few.column("qid").take(again), few.column("qh").take(again), pa.array(names[take].ravel()), pa.array(np.take_along_axis(scores, take, 1).ravel())], names=["qid", "qh", "vec_id", "score"])

    both = data.select("block", F.lit(0).alias("query"), F.col("vec_id").alias("qid"), F.lit(0).cast("bigint").alias("qh"), "vec").unionByName(queries.select("block", F.lit(1).alias("query"), "qid", "qh", "vec"))
    return mapped(both.repartition(blocks, "block").sortWithinPartitions("block", "query"), run, "qid bigint, qh bigint, vec_id bigint, score bigint")


def _first(rows: DataFrame, k: int, *by: str) -> DataFrame:
    """The first k results of each query, with their rank."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def joined(queries: DataFrame, rows: DataFrame, k: int, cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(qid, qh, vec_id, score): the k best of `rows` (vec_id, vec), different ones, for each of `queries` (qid, qh,
    vec), all where there are fewer; scores are inner products, ties go to the smaller vec_id."""
    n = rows.count()
    wanted = max(1, min(MOST_PIVOTS, -(-n // cell_rows)))
    chosen = rows.select("vec").dropDuplicates().orderBy(F.xxhash64("vec"), "vec").limit(wanted)
    found = [r.vec for r in chosen.collect()] or [[]]
    cells = Cells(matrix(pa.array(found, pa.list_(pa.int64()))))
    homes = assigned(rows, cells)
    # a row for each cell, a thousand at most
    summary = homes.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far"), F.max("norm").alias("norm")).collect()
    cells.radius, cells.norm, cells.blocks = (np.zeros(len(found)), np.zeros(len(found)), np.zeros(len(found), np.int64))
    for r in summary:
        cells.radius[r.cell], cells.norm[r.cell], cells.blocks[r.cell] = _above(r.far), _above(r.norm), -(-r.n // block_rows)
    total, start = max(1, int(cells.blocks.sum())), cells.first()
    lookup = F.array(*[F.struct(F.lit(int(s)).alias("s"), F.lit(int(b)).alias("b")) for s, b in zip(start, cells.blocks, strict=True)])
    mine = F.get(lookup, F.col("cell"))
    blocked = homes.select("vec_id", "vec", (mine["s"] + F.pmod(F.xxhash64("vec_id", "vec"), F.greatest(mine["b"], F.lit(1)))).cast("int").alias("block"))
    asked = saved(assigned(queries.select("qid", "qh", "vec"), cells), "queries")
    at_home = asked.withColumn("block", F.explode(F.when(mine["b"] > 0, F.sequence(mine["s"], mine["s"] + mine["b"] - 1))))
    local = saved(_first(solved(blocked, at_home, k, total), k, "qid", "qh"), "local")
    floor = local.where(F.col("rank") == k).select("qid", "qh", F.col("score").cast("double").alias("least"))
    asked = asked.join(floor, ["qid", "qh"], "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    groups = np.tile([0.0, 0.0, np.inf], (len(found), 1))
    for r in asked.groupBy("cell").agg(F.max("far").alias("far"), F.max("norm").alias("norm"), F.min("least").alias("least")).collect():
        groups[r.cell] = _above(r.far), _above(r.norm), r.least
    away = solved(blocked, reached(asked, cells, groups), k, total)
    every = local.select("qid", "qh", "vec_id", "score").unionByName(away)
    return _first(every, k, "qid", "qh").select("qid", "qh", "vec_id", "score")


def search(vectors: DataFrame, k: int = 5, every: int = 50, cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of `vectors` (vec_id, embedding) whose vec_id is divisible by
    `every`, its k best rows with another vec_id, or all if there are fewer, best first, ties to the smaller vec_id.

    Rows that quantised() leaves out take no part. Where vectors differ in length, missing components are 0. Rows
    that repeat both vec_id and vector count once; a vec_id with several vectors stands for each, as a query with
    ranks of its own. Scores beyond 64 bits are the nearest that these hold. Other columns are left aside.
    """
    rows = quantised(vectors)
    copies = Window.partitionBy("vec").orderBy("vec_id")
    data = saved(rows.distinct().withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).drop("copy"), "vectors")
    asking = rows.where(F.col("vec_id") % every == 0).distinct()
    queries = asking.groupBy("vec").agg(F.min("vec_id").alias("qid")).select("qid", F.xxhash64("vec").alias("qh"), "vec")
    found = joined(queries, data, k + 1, cell_rows, block_rows)
    # the same query vector was searched once; its results go to each query that has it
    results = found.groupBy("qid", "qh").agg(F.collect_list(F.struct("score", "vec_id")).alias("found"))
    named = queries.join(results, ["qid", "qh"]).select("vec", "found")
    mine = asking.join(named, "vec").select(F.col("vec_id").alias("query_id"), F.filter("found", lambda x: x["vec_id"] != F.col("vec_id")).alias("found"))
    order = F.array_sort("found", lambda a, b: F.when(a["score"] != b["score"], F.when(a["score"] > b["score"], -1).otherwise(1)).when(a["vec_id"] < b["vec_id"], -1).when(a["vec_id"] > b["vec_id"], 1).otherwise(0))
    ranked = mine.select("query_id", F.posexplode(F.slice(order, 1, k)).alias("i", "x"))
    return ranked.select("query_id", (F.col("i") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def sql(k: int = 5, every: int = 50) -> str:
    """The search in SQL for DuckDB."""
    product = "list_sum(list_transform(list_zip(q.u, c.u), lambda p: p[1] * p[2]))"
    return f"""WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS u FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, coalesce({product}, 0)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {every} = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {k}"""
