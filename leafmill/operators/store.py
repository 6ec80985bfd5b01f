"""A vector store: vectors taken in, searched, written, read and changed by number; exact or by inverted lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import retrieval as R


class VectorStore:
    """Vectors (doc, vec), each in the cell of its centroid. Without centroids there are no cells and searches
    are exact; with them a search sees the cells nearest to the query, and all of them if it probes them all."""

    def __init__(self, rows: DataFrame, centroids: np.ndarray | None, how: str):
        self.rows, self.centroids, self.how = rows, centroids, how

    @classmethod
    def ingest(cls, vectors: DataFrame, how: str = "cosine", lists: int = 0, sample: int = 20_000) -> VectorStore:
        """All vectors, one for each doc. Centroids of `lists` cells are fitted on the driver to `sample` vectors at
        most, the first by a hash of their number; 0 lists is exact."""
        rows = _single(vectors)
        if not lists:
            return cls(rows, None, how)
        taken = rows.orderBy(F.xxhash64("doc"), "doc").limit(sample).select("vec").toArrow().column("vec").combine_chunks()
        if not len(taken):
            return cls(rows, None, how)
        own = taken.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(taken), -1)
        store = cls(rows, _centroids(R.unit(own) if how == "cosine" else own, lists, how == "cosine"), how)
        store.rows = store._dealt(rows)
        return store

    def upsert(self, vectors: DataFrame) -> VectorStore:
        """A store where these vectors replace those of the same number, and others are added. Centroids stay."""
        new = _single(vectors)
        kept = self.rows.join(new.select("doc"), "doc", "left_anti").select(*self.rows.columns)
        return VectorStore(kept.unionByName(new if self.centroids is None else self._dealt(new)), self.centroids, self.how)

    def query(self, queries: DataFrame, k: int, probes: int = 64, block: int = 4096) -> DataFrame:
        """(qid, doc, score, rank): the k best of each query (qid, vec) in the `probes` cells nearest to it.

        A cell is cut into blocks of about `block` vectors, however many it holds; its queries come in blocks too.
        """
        if self.centroids is None:
            return R.nearest(queries, self.rows, k, self.how, block=block)
        parts = self.rows.groupBy("cell").agg(F.ceil(F.count("*") / block).alias("parts"))
        cut = self.rows.join(F.broadcast(parts), "cell").select("cell", F.pmod(F.xxhash64("doc"), "parts").alias("y"), F.struct(F.col("doc").alias("id"), "vec").alias("r"))
        right = cut.groupBy("cell", "y").agg(F.collect_list("r").alias("y_rows"))
        asked = self._probed(queries, probes)
        shares = asked.groupBy("cell").agg(F.ceil(F.count("*") / block).alias("parts"))
        left = asked.join(F.broadcast(shares), "cell").groupBy("cell", F.pmod(F.xxhash64("qid"), "parts").alias("x")).agg(F.collect_list(F.struct(F.col("qid").alias("id"), "vec")).alias("x_rows"))
        return R.top_k(R.block_products(left.join(right, "cell").select("x_rows", "y_rows"), k, self.how), k)

    def save(self, path: str) -> None:
        """Into a new folder: the vectors by cell as Parquet, and the centroids. A folder that is there is an error."""
        rows = self.rows.repartition("cell", F.pmod(F.xxhash64("doc"), F.lit(16))).sortWithinPartitions("cell", "doc") if self.centroids is not None else self.rows
        writer = rows.write.mode("errorifexists")
        (writer if self.centroids is None else writer.partitionBy("cell")).parquet(f"{path}/vectors")
        spark = self.rows.sparkSession
        kept = [] if self.centroids is None else [(i, c.tolist()) for i, c in enumerate(self.centroids)]
        spark.createDataFrame(kept, "cell int, vec array<double>").withColumn("how", F.lit(self.how)).unionByName(spark.createDataFrame([(-1, None, self.how)], "cell int, vec array<double>, how string")).coalesce(1).write.mode("errorifexists").parquet(f"{path}/centroids")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VectorStore:
        kept = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()
        return cls(spark.read.parquet(f"{path}/vectors"), np.array([r.vec for r in kept[1:]]) if kept[1:] else None, kept[0].how)

    def _dealt(self, vectors: DataFrame) -> DataFrame:
        return self._cells(vectors.select("doc", "vec"), "doc", 1)

    def _probed(self, queries: DataFrame, probes: int) -> DataFrame:
        return self._cells(queries.select("qid", "vec"), "qid", min(probes, len(self.centroids)))

    def _cells(self, rows: DataFrame, key: str, n: int) -> DataFrame:
        """Each row once for each of its n nearest cells."""
        centroids, how = self.centroids, self.how

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                vec = batch.column("vec").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
                near = _nearest_cells(R.unit(vec) if how == "cosine" else vec, centroids, n)
                at = pa.array(np.repeat(np.arange(batch.num_rows), n))
                yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns), pa.array(near.ravel(), pa.int32())], [key, "vec", "cell"])

        types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
        return rows.mapInArrow(run, f"{key} {types[key]}, vec {types['vec']}, cell int")


def _single(vectors: DataFrame) -> DataFrame:
    """One vector for each doc, the largest of several; rows without a number or a vector go."""
    return vectors.where(F.col("doc").isNotNull() & F.col("vec").isNotNull()).groupBy("doc").agg(F.max("vec").alias("vec"))


def _nearest_cells(vec: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    far = (centroids * centroids).sum(axis=1)[None, :] - 2 * (vec @ centroids.T)
    return np.argsort(far, axis=1, kind="stable")[:, :n]


def _centroids(vec: np.ndarray, lists: int, sphere: bool, rounds: int = 12) -> np.ndarray:
    """k-means: starts drawn in proportion to the squared distance from those drawn, with a fixed seed."""
    rng = np.random.default_rng(7)
    found = vec[[0]]
    gap = ((vec - found[0]) ** 2).sum(axis=1)
    while len(found) < min(lists, len(vec)) and gap.sum() > 0:
        found = np.vstack([found, vec[[rng.choice(len(vec), p=gap / gap.sum())]]])
        gap = np.minimum(gap, ((vec - found[-1]) ** 2).sum(axis=1))
    for _ in range(rounds):
        cell = _nearest_cells(vec, found, 1)[:, 0]
        sums = np.zeros_like(found)
        np.add.at(sums, cell, vec)
        sizes = np.bincount(cell, minlength=len(found))[:, None]
        found = np.where(sizes > 0, sums / np.maximum(sizes, 1), found)
        found = R.unit(found) if sphere else found
    return found
