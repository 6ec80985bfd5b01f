"""Retrieval over scores (qid, doc, score): top k, hybrid, trees, late chunking, reranking.

Ranks are by score, rounded to nine places so that the order of additions doesn't matter, then by doc.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions import text as T
from . import chains
from . import lexical as L


def ranked(scores: DataFrame) -> DataFrame:
    best = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), "doc")
    return scores.withColumn("rank", F.row_number().over(best))


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """(qid, doc, score, rank), the best k of each query. The planner prunes to k before the shuffle."""
    return ranked(scores).where(F.col("rank") <= k)


def with_zeros(scores: DataFrame, queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """Scores, and zeros for enough documents that share nothing with a query: its top k has k rows if there
    are as many documents. The first k documents are enough, whichever of them have a score."""
    first = docs.select("doc").orderBy("doc").limit(k)
    missing = queries.select("qid").crossJoin(first).join(scores.select("qid", "doc"), ["qid", "doc"], "left_anti")
    return scores.unionByName(missing.withColumn("score", F.lit(0.0)))


def nearest(queries: DataFrame, docs: DataFrame, k: int, how: str = "cosine", itself: bool = True, block: int = 4096) -> DataFrame:
    """(qid, doc, score): the k best documents (doc, vec) of every query vector (qid, vec), by score rounded to
    nine places and then by doc; without `itself`, a query's own number is no result.

    Exact, and no pair of vectors becomes a row: both sides are numbered into blocks, every two blocks meet
    once as arrays, and their matrix product leaves k candidates for each query.
    """

    def blocks(rows: DataFrame, key: str, name: str) -> tuple[int, DataFrame]:
        n = max(1, -(-rows.count() // block))
        dealt = rows.select(F.col(key).alias("id"), "vec", F.pmod(F.xxhash64(key), F.lit(n)).alias(name))
        return n, dealt.groupBy(name).agg(F.collect_list(F.struct("id", "vec")).alias(f"{name}_rows"))

    (n, left), (m, right) = blocks(queries, "qid", "x"), blocks(docs, "doc", "y")
    pairs = left.crossJoin(right).repartition(n * m, "x", "y").select("x_rows", "y_rows")
    return top_k(block_products(pairs, k, how, itself), k)


def block_products(pairs: DataFrame, k: int, how: str = "cosine", itself: bool = True) -> DataFrame:
    """(qid, doc, score): of each row's two blocks (x_rows, y_rows), arrays of (id, vec), the k best of the second
    for each of the first."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column("x_rows"), batch.column("y_rows"), strict=True):
                (a, va), (b, vb) = _matrix(x, how), _matrix(y, how)
                order = np.argsort(b, kind="stable")
                b, sims = b[order], np.round(va @ vb[order].T, 9)
                if not itself:
                    sims[a[:, None] == b[None, :]] = -np.inf
                take = np.argsort(-sims, axis=1, kind="stable")[:, :k]
                qid, doc, score = np.repeat(a, take.shape[1]), b[take].ravel(), np.take_along_axis(sims, take, 1).ravel()
                ok = np.isfinite(score)
                yield pa.RecordBatch.from_arrays([pa.array(qid[ok], x.type.value_type.field("id").type), pa.array(doc[ok], y.type.value_type.field("id").type), pa.array(score[ok])], ["qid", "doc", "score"])

    kind = lambda c: pairs.schema[c].dataType.elementType["id"].dataType.simpleString()
    return pairs.mapInArrow(best, f"qid {kind('x_rows')}, doc {kind('y_rows')}, score double")


def _matrix(rows, how: str) -> tuple[np.ndarray, np.ndarray]:
    values = rows.values
    vec = values.field("vec").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(values), -1)
    return values.field("id").to_numpy(zero_copy_only=False), unit(vec) if how == "cosine" else vec


def unit(vec: np.ndarray) -> np.ndarray:
    """Rows divided by their norms; rows of zeros stay."""
    norm = np.sqrt((vec * vec).sum(axis=1, keepdims=True))
    return np.divide(vec, norm, out=np.zeros_like(vec), where=norm > 0)


def minmax(c: Column, *by: str) -> Column:
    """To 0..1 within a group; all 1 where they hardly differ."""
    w = Window.partitionBy(*by)
    lo, hi = F.min(c).over(w), F.max(c).over(w)
    return F.when(hi - lo < 1e-9, F.lit(1.0)).otherwise(F.try_divide(c - lo, hi - lo))


def hybrid(dense: DataFrame, lexical: DataFrame, k: int = 5, dense_weight: float = 0.5, lexical_weight: float = 0.5, candidates: int | None = None, lexical_of: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(qid, doc, score): both kinds of scores, each brought to 0..1 over the candidates of a query, added up.

    Candidates are the best max(50, 10 k) of either side, which `dense` and `lexical` must hold. A dense score
    is that of the best `candidates` (as many by default), 0 beyond; lexical scores of all candidates, (qid, doc,
    score), are what `lexical_of` makes of them; without it `lexical` holds all, and those missing are 0.
    """
    n = max(50, 10 * k)
    best = top_k(dense, candidates or n).persist()
    both = best.where(F.col("rank") <= n).select("qid", "doc").union(top_k(lexical, n).select("qid", "doc")).distinct().persist()
    every = lexical_of(both) if lexical_of else both.join(lexical, ["qid", "doc"], "left").fillna(0.0, ["score"]).select("qid", "doc", "score")
    filled = every.withColumnRenamed("score", "l").join(best.select("qid", "doc", F.col("score").alias("d")), ["qid", "doc"], "left").fillna(0.0, ["d", "l"])
    normal = filled.select("qid", "doc", minmax(F.round("d", 9), "qid").alias("d"), minmax(F.round("l", 9), "qid").alias("l"))
    return normal.select("qid", "doc", (F.col("d") * dense_weight + F.col("l") * lexical_weight).alias("score"))


def pairs_within(queries: DataFrame, children: DataFrame, parents: DataFrame) -> DataFrame:
    """(qid, doc): the children (doc, parent) of each query's parents (qid, parent); for a query none of whose
    parents has children, all children."""
    allowed = children.select("doc", "parent").join(parents.select("qid", "parent"), "parent").select("qid", "doc")
    without = queries.select("qid").join(allowed, "qid", "left_anti")
    return allowed.unionByName(without.crossJoin(children.select("doc")))


def sub_chunks(pages: DataFrame, size: int = 300, overlap: int = 100) -> DataFrame:
    """(page, sub, text), and what other columns there are: pieces of the pages (doc, text) found, as functions.text.token_windows
    has them. A page is cut into tokens once, in a batch, and not for each of its pieces."""
    step = max(1, size - overlap)
    more = [c for c in pages.columns if c not in ("doc", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chains.slices(whole, "text"):
                tokens = [None if x is None else x.split("\n") if x else [] for x in L.listed(batch.column("text")).to_pylist()]
                rows = [(i, sub, " ".join(t[at : at + size])) for i, t in enumerate(tokens) if t for sub, at in enumerate(range(0, max(0, -(-(len(t) - size) // step)) * step + 1, step))]
                rows += [(i, 0, None) for i, t in enumerate(tokens) if t is None]
                of, sub, text = zip(*rows, strict=True) if rows else ((), (), ())
                own = batch.select([*more, "doc"]).take(pa.array(of, pa.int64()))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(sub, pa.int32()), pa.array(text, pa.string())], names=[*more, "page", "sub", "text"])

    if size <= 0:
        return pages.select(*more, F.col("doc").alias("page"), F.lit(0).alias("sub"), "text")
    kept = [pages.schema[c] for c in more] + [StructField("page", pages.schema["doc"].dataType), *StructType.fromDDL("sub int, text string").fields]
    return pages.select(*more, "doc", "text").mapInArrow(run, StructType(kept))


class PairScorer(Protocol):
    """Scores (question, text) pairs; a model is loaded once for each worker."""

    def __call__(self, questions: pd.Series, texts: pd.Series) -> pd.Series: ...


def overlap(question: Column, text: Column) -> Column:
    """The stand-in for a pair scorer: the share of the question's different lower-cased tokens that the text has."""
    q, t = F.array_distinct(T.tokens(F.lower(question))), F.array_distinct(T.tokens(F.lower(text)))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(q, t)).cast("double"), F.size(q)), F.lit(0.0))


def rerank(candidates: DataFrame, k: int, scorer: Callable[[], PairScorer] | None = None) -> DataFrame:
    """The best k of candidates (qid, doc, question, text) by a pair score. `scorer` makes the model, once for
    each task; without it, token overlap stands in."""
    if scorer is None:
        return top_k(candidates.withColumn("score", overlap(F.col("question"), F.col("text"))), k)

    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = scorer()
        for questions, texts in batches:
            yield model(questions, texts)

    return top_k(candidates.withColumn("score", F.pandas_udf(score, "double")("question", "text")), k)


def shared(a: DataFrame, b: DataFrame) -> DataFrame:
    """(qid, both): how many documents two rankings (qid, doc) have in common."""
    return a.select("qid", "doc").join(b.select("qid", "doc"), ["qid", "doc"]).groupBy("qid").agg(F.count("*").alias("both"))


def agreement(base: DataFrame, other: DataFrame, k: int) -> DataFrame:
    """(qid, agreement): the share of k that a ranking has in common with a base ranking; 0 for k of 0 or less."""
    both = base.select("qid").distinct().join(shared(base, other), "qid", "left")
    return both.select("qid", (F.coalesce("both", F.lit(0)) / F.lit(float(max(k, 1))) * F.lit(int(k > 0))).alias("agreement"))
