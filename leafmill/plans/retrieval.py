"""Retrieval evaluation as one plan: pages to chunks to index to rankings of all questions to metrics."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import noise as N
from ..functions import text as T
from ..operators import chunks as C
from ..operators import embed as E
from ..operators import lexical as L
from ..operators import metrics as M
from ..operators import retrieval as R
from ..session import stored


def cleaned_pages(pages: DataFrame, profile: N.Profile = N.BASIC) -> DataFrame:
    return pages.select("doc_key", "page", N.cleaned(F.col("text"), profile).alias("text"))


def prepared(pages: DataFrame, profile: N.Profile = N.BASIC) -> DataFrame:
    """Cleaned pages and their tokens, stored: cleaned and cut into tokens once for all ways to chunk them. Windows and pages keep the
    tokens, so that their indexes need not cut their texts again."""
    return stored(C.tokenized(cleaned_pages(pages, profile)))


def flat_chunks(pages: DataFrame, config: dict, profile: N.Profile = N.BASIC, ready: DataFrame | None = None) -> DataFrame:
    """(doc, ...) chunks of cleaned pages without noise; trees give their children. `doc`, doc_key and chunk_id, orders ties.
    `ready` is what prepared() has made of the pages, if it has."""
    made = C.build(cleaned_pages(pages, profile) if ready is None else ready, config)
    return N.without_noise(made[1] if isinstance(made, tuple) else made, profile).withColumn("doc", F.concat_ws("|", "doc_key", "chunk_id"))


def expected_pages(pages: DataFrame, questions: DataFrame, block: int = 4 << 20) -> DataFrame:
    """(qid, page): the pages whose text holds a question's text, word for word.

    Questions are a stated set, taken in blocks of `block` characters or one question; a block becomes an
    automaton in each task, which goes over every page once, however many questions it has. An empty question
    is held by every page, a null one by none; a page that holds a question twice does so once.
    """
    texts: dict[str, list] = {}
    for r in questions.select("qid", "text").where("text is not null").collect():
        texts.setdefault(r.text, []).append(r.qid)
    blocks: list[dict[str, list]] = [{}]
    size = 0
    for text in sorted(texts):
        if size and size + len(text) > block:
            blocks.append({})
            size = 0
        blocks[-1][text] = texts[text]
        size += len(text)
    rows = pages.select("page", "text").where("text is not null")
    schema = StructType([questions.schema["qid"], rows.schema["page"]])
    return reduce(DataFrame.unionAll, [rows.mapInArrow(_held(own), schema) for own in blocks])


def _held(texts: dict[str, list]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(qid, page) of the pages of batches (page, text) that hold one of the texts, given with their qids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for text, qids in texts.items():
            if text:
                automaton.add_word(text, qids)
        automaton.make_automaton()
        for batch in batches:
            found: list = []
            row: list[int] = []
            for i, text in enumerate(batch.column("text")):
                own = {id(x): x for _, x in automaton.iter(text.as_py())} if len(automaton) else {}
                qids = [*itertools.chain.from_iterable(own.values()), *texts.get("", [])]
                found += qids
                row += [i] * len(qids)
            yield pa.RecordBatch.from_arrays([pa.array(found, kind), batch.column("page").take(pa.array(row, pa.int64()))], names=["qid", "page"])

    kind = pa.infer_type(list(itertools.chain.from_iterable(texts.values()))) if texts else pa.null()
    return run


def rankings(chunks: DataFrame, questions: DataFrame, config: dict | None = None, k: int = 5, embedder: E.Maker | None = None, scorer: Callable[[], R.PairScorer] | None = None) -> DataFrame:
    """(qid, doc, score, rank) by a retrieval configuration: type dense (cosine of the embedder's vectors, or of
    TF-IDF without one), bm25 or hybrid, with a rewriter and a reranker if it names them, which `scorer` is. Rerankers score the dense candidates, as many as candidate_k;
    with rerank_on anything but candidates, the k results."""
    config = config or {}
    kind = config.get("type", "dense")
    rewriter = config.get("rewriter") or {}
    if rewriter.get("type") == "heuristic":
        questions = questions.withColumn("text", T.rewritten(F.col("text"), rewriter.get("context_hint", "")))
    docs = chunks.select("doc", "text")
    # chunks that were stored with their tokens
    tokens = chunks.select("doc", "t") if "t" in chunks.columns else docs
    wanted = int(config.get("candidate_k", max(50, 10 * k)))
    dense = None
    if kind != "bm25" or config.get("reranker"):
        dense = E.best(docs, questions, embedder, wanted).drop("rank") if embedder else L.TfIdf(docs).best(questions, wanted)
    if kind == "dense":
        scores = dense
    else:
        index = L.Bm25(tokens)
        lexical = index.best(questions, max(wanted, 50, 10 * k))
        weights = [float(config.get(c, 0.5)) for c in ("dense_weight", "bm25_weight")]
        scores = lexical if kind == "bm25" else R.hybrid(dense, lexical, k, *weights, candidates=wanted, lexical_of=lambda pairs: index.scores_of(pairs, questions))
    best = R.top_k(scores, k)
    if config.get("reranker"):
        pool = R.top_k(dense, wanted) if config.get("rerank_on", "candidates") == "candidates" else best
        pairs = pool.select("qid", "doc").join(docs, "doc").join(questions.select("qid", F.col("text").alias("question")), "qid")
        best = R.rerank(pairs, k, scorer)
    return best.select("qid", "doc", "score", "rank")


def tree_rankings(parents: DataFrame, children: DataFrame, questions: DataFrame, k: int = 5, parent_k: int = 3, kind: str = "dense") -> DataFrame:
    """Children of each question's best parents, ranked. Parents are weighed by the fit on them, and so are
    children. For bm25 all children compete, so parents aren't looked at, and for hybrid the lexical side does."""
    if kind == "bm25":
        return R.top_k(L.Bm25(children.select("doc", "text")).best(questions, max(50, 10 * k)), k)
    parents, children = stored(parents), stored(children)
    index = L.TfIdf(parents.select("doc", "text"))
    best = R.top_k(index.best(questions, parent_k), parent_k).select("qid", F.col("doc").alias("parent"))
    docs = children.select("doc", "text")
    dense = index.scores_of(R.pairs_within(questions, children, best), questions, docs)
    if kind == "dense":
        return R.top_k(dense, k)
    found = L.Bm25(docs)
    lexical = found.best(questions, max(50, 10 * k))
    return R.top_k(R.hybrid(dense.persist(), lexical, k, lexical_of=lambda pairs: found.scores_of(pairs, questions)), k)


def late_rankings(pages: DataFrame, questions: DataFrame, k: int = 5, page_k: int = 12, size: int = 300, overlap: int = 100, kind: str = "dense", candidates: int | None = None) -> DataFrame:
    """(qid, page, sub, score, rank): the best pages, cut, their pieces ranked by the pages' TF-IDF fit. Pages are
    found by TF-IDF (dense), bm25 or hybrid, whose dense side is the best `candidates`; no more pieces stay."""
    candidates = candidates or max(50, 10 * k)
    docs = pages.select(F.col("page").alias("doc"), "text")
    index = L.TfIdf(docs)
    if kind == "dense":
        scores = index.best(questions, page_k)
    else:
        found = L.Bm25(docs)
        lexical = found.best(questions, max(50, 10 * page_k))
        scores = lexical if kind == "bm25" else R.hybrid(index.best(questions, candidates), lexical, page_k, candidates=candidates, lexical_of=lambda pairs: found.scores_of(pairs, questions))
    best = stored(R.top_k(scores, page_k).select("qid", "doc"))
    # a few pages for each question, which are sent to where the texts lie; one that several found is cut and weighed once
    few = best.select("doc").distinct()
    cut = R.sub_chunks(docs.join(F.broadcast(few) if best.count() <= L.FEW_PAIRS else few, "doc", "left_semi"), size, overlap)
    cut = stored(cut.withColumn("doc", F.col("page") * (1 << 20) + F.col("sub")))
    subs = best.select("qid", F.col("doc").alias("page")).join(cut.select("doc", "page", "sub"), "page")
    pieces = cut.groupBy("doc").agg(F.first("text").alias("text"))
    weighed = index.scores_of(subs, questions, pieces).join(subs.select("qid", "doc", "page", "sub"), ["qid", "doc"])
    return R.top_k(weighed, min(k, candidates)).select("qid", "page", "sub", "score", "rank")


def evaluate(pages: DataFrame, questions: DataFrame, chunking: dict, profile: N.Profile = N.BASIC, retrieval: dict | None = None, k: int = 5, expected: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(metrics, first ranks) of a run: one row, and one for each question. `expected` is (qid, page); by default
    the pages that hold the question's text."""
    chunks = stored(flat_chunks(pages, chunking, profile))
    best = rankings(chunks, questions, retrieval, k)
    ranks = M.first_ranks(best, chunks, expected if expected is not None else expected_pages(pages, questions), questions)
    return M.ranking_metrics(ranks), ranks


def compared(variants: dict[str, DataFrame], questions: DataFrame, expected: DataFrame, retrieval: dict | None = None, k: int = 5) -> DataFrame:
    """A row of ranking metrics for each variant of the chunks, by its name."""
    out = None
    for name, chunks in variants.items():
        chunks = stored(chunks)
        ranks = M.first_ranks(rankings(chunks, questions, retrieval, k), chunks, expected, questions)
        row = M.ranking_metrics(ranks).withColumn("variant", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def answer_inputs(pages: DataFrame, questions: DataFrame, chunking: dict, k: int = 5, retrieval: dict | None = None) -> DataFrame:
    """(qid, context, context_pages): what a generator is shown for each question."""
    from ..functions import answers as A

    chunks = stored(flat_chunks(pages, chunking))
    got = rankings(chunks, questions, retrieval, k).join(chunks.select("doc", "page_start", "page_end", "text"), "doc")
    rows = F.collect_list(F.struct("rank", "page_start", "page_end", "text"))
    shown = got.groupBy("qid").agg(A.context(rows).alias("context"))
    return shown.join(M.context_pages(got), "qid")
