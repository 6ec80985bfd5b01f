"""The graph of nearest neighbours, expansion of candidates along it, and reranking by proximity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import stored
from . import pivots
from . import retrieval as R


def knn(vectors: DataFrame, k: int, **sizes: int) -> DataFrame:
    """(src, dst, nbr_rank, sim): the k most alike by cosine of every vector (doc, vec), itself aside, ties by doc; exact."""
    found = pivots.nearest(vectors.select(F.col("doc").alias("qid"), "vec"), vectors, k, itself=False, **sizes)
    return found.select(F.col("qid").alias("src"), F.col("doc").alias("dst"), F.col("rank").alias("nbr_rank"), F.col("score").alias("sim"))


def expand(seeds: DataFrame, edges: DataFrame, hops: int = 1, per_node: int = 4) -> DataFrame:
    """(qid, doc, hop): seeds (qid, doc) at hop 0, then the first `per_node` neighbours of each (0: all), hop by
    hop; the first visit counts."""
    usable = (edges if per_node == 0 else edges.where(F.col("nbr_rank") <= per_node)).select(F.col("src").alias("doc"), "dst")
    visited = seeds.select("qid", "doc").distinct().withColumn("hop", F.lit(0))
    frontier = visited
    for hop in range(1, hops + 1):
        reached = frontier.join(usable, "doc").select("qid", F.col("dst").alias("doc")).distinct()
        frontier = reached.join(visited.select("qid", "doc"), ["qid", "doc"], "left_anti").withColumn("hop", F.lit(hop))
        visited = visited.unionByName(frontier)
    return visited


def expand_from(seeds: DataFrame, vectors: DataFrame, hops: int = 1, per_node: int = 4, **sizes: int) -> DataFrame:
    """(qid, doc, hop): as expand() over the edges of knn(), but neighbours are looked for only of the vectors (doc, vec) that a
    hop sets out from, and no more than `per_node` of each; the rest of the graph isn't made."""
    visited = frontier = stored(seeds.select("qid", "doc").distinct().withColumn("hop", F.lit(0)))
    for hop in range(1, hops + 1):
        asked = stored(vectors.join(frontier.select("doc").distinct(), "doc", "left_semi").select(F.col("doc").alias("qid"), "vec"))
        edges = pivots.nearest(asked, vectors, per_node, itself=False, **sizes).select(F.col("qid").alias("doc"), F.col("doc").alias("dst"))
        reached = frontier.join(edges, "doc").select("qid", F.col("dst").alias("doc")).distinct()
        frontier = stored(reached.join(visited.select("qid", "doc"), ["qid", "doc"], "left_anti").withColumn("hop", F.lit(hop)))
        visited = visited.unionByName(frontier)
    return visited


def rerank(candidates: DataFrame, seeds: DataFrame, queries: DataFrame, vectors: DataFrame, beta: float = 0.25) -> DataFrame:
    """(qid, doc, score): (1 - beta) cos(q, c) + beta times the graph's signal, clipped to 0..1: the cosine to
    the nearest other seed, 0 at least, plus 0.15 / (1 + hop) for candidates that are no seeds."""
    beta = min(max(beta, 0.0), 1.0)
    own = candidates.join(vectors, "doc").join(queries.select("qid", F.col("vec").alias("q")), "qid")
    near = seeds.select("qid", F.col("doc").alias("seed")).join(vectors.select(F.col("doc").alias("seed"), F.col("vec").alias("sv")), "seed")
    prox = own.select("qid", "doc", "vec").join(near, "qid").where("doc <> seed").groupBy("qid", "doc").agg(F.max(V.cosine(F.col("vec"), F.col("sv"))).alias("prox"))
    bonus = F.when(F.col("hop") >= 1, F.lit(0.15) / (F.lit(1.0) + F.col("hop"))).otherwise(0.0)
    signal = F.least(F.greatest(F.greatest(F.coalesce("prox", F.lit(0.0)), F.lit(0.0)) + bonus, F.lit(0.0)), F.lit(1.0))
    return own.join(prox, ["qid", "doc"], "left").select("qid", "doc", (V.cosine(F.col("vec"), F.col("q")) * (1 - beta) + signal * beta).alias("score"))
