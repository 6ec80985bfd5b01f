"""The jobs as queries: each runs twice into a new folder, and its output is read back."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill import oracle as O
from leafmill.session import shared_dir
from leafmill.sources.readers import config as read_config

from . import ingest_chunks, leaderboard


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/jobs/{name}-{uuid.uuid4().hex}"


def job1_ingest_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second run finds nothing new. The table may be a folder or one file, which a stream takes by a pattern only."""
    at, config = _folder(spark, "ingest_chunks"), read_config(ingest_chunks.CONFIG)
    for _ in range(2):
        ingest_chunks.run(spark, f"{sf_dir}/documents.parque[t]", f"{at}/out", f"{at}/checkpoint", config)
    rows = ingest_chunks.current(spark, f"{at}/out")
    return rows.select("doc_key", "page", "chunk_id", "kept", *ingest_chunks.RULES, F.length("text").cast("bigint").alias("n"), F.md5("text").alias("md5"))


def job2_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second run replaces what the first one wrote."""
    at, config = _folder(spark, "leaderboard"), read_config(leaderboard.CONFIG)
    for _ in range(2):
        leaderboard.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", at, config)
    wide = {"rank": "bigint", "page_start": "bigint", "page_end": "bigint"}
    figures = [c for c in ("n", "hit_at_1", "hit_at_3", "hit_at_5", "mrr", "avg_first_rank")]
    found = leaderboard.ranks(spark, at).select("run", "qid", "doc", F.round("score", 6).alias("score"), "hit", *[F.col(c).cast(k).alias(c) for c, k in wide.items()])
    board = leaderboard.leaderboard(spark, at).select("run", F.col("n_chunks").cast("bigint").alias("n_chunks"), *[F.round(F.col(c).cast("double"), 9).alias(c) for c in figures])
    return found.join(board, "run")


def _ingested() -> str:
    pages = f"SELECT source AS doc_key, doc_id AS page, {O.cleaned('text', True)} AS text FROM documents"
    rows = f"SELECT doc_key, page_start AS page, chunk_id, text, {O.features('text')} FROM chunks"
    flags = f"SELECT doc_key, page, chunk_id, text, {O.flags('text')} FROM ({rows})"
    return f"""WITH pages AS ({pages}), {O.windows(300, 50)}, flagged AS ({flags})
SELECT doc_key, page, chunk_id, NOT (low_signal OR reference_like OR abbreviation_like) AS kept, low_signal, reference_like, abbreviation_like, length(text)::BIGINT AS n, md5(text) AS md5 FROM flagged"""


def _ranked(name: str, chunks: str, ctes: str, scores: str) -> str:
    figures = ", ".join(f"round(({c})::DOUBLE, 9) AS {c}" for c in ("n", "hit_at_1", "hit_at_3", "hit_at_5", "mrr", "avg_first_rank"))
    return f"""SELECT '{name}' AS run, * FROM (WITH pages AS ({O.BASIC}), questions AS ({O.QUESTIONS}), {chunks}, {O.EXPECTED}, {ctes}, {O.ranks(scores)},
hits AS (SELECT DISTINCT qid, rank, true AS hit FROM found JOIN chunks USING (doc) JOIN expected USING (qid) WHERE page BETWEEN page_start AND page_end),
figures AS (SELECT {O.METRICS} FROM ranks)
SELECT qid, doc, round(score, 6) AS score, coalesce(hit, false) AS hit, rank, page_start, page_end, (SELECT count(*) FROM chunks)::BIGINT AS n_chunks, {figures}
FROM found JOIN chunks USING (doc) LEFT JOIN hits USING (qid, rank), figures)"""


_PAGED = "chunks AS (SELECT doc_key || '|page/' || page AS doc, doc_key, page AS page_start, page AS page_end, text FROM pages)"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_ingest_chunks": job1_ingest_chunks, "job2_leaderboard": job2_leaderboard}
SQL = {
    "job1_ingest_chunks": _ingested(),
    "job2_leaderboard": "\nUNION ALL ".join(
        [
            _ranked("bm25_300", O.windows(300, 50), O.bm25(), "lex"),
            _ranked("bm25_500", O.windows(500, 100), O.bm25(), "lex"),
            _ranked("tfidf_300", O.windows(300, 50), O.tfidf(), "dense"),
            _ranked("bm25_page", _PAGED, O.bm25(), "lex"),
        ]
    ),
}
