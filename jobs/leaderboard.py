"""Compares retrieval configurations over one set of pages and questions.

    spark-submit jobs/leaderboard.py PAGES QUESTIONS OUTPUT [--config jobs/leaderboard.yaml]

Each run of the configuration cleans, cuts and indexes the pages its own way and ranks chunks for every question;
a page that holds a question's text is one that should be found. OUTPUT/ranks has what was found and
OUTPUT/leaderboard the metrics, both in a folder for each run:

    ranks/run=bm25_300/...      leaderboard/run=bm25_300/...

A run replaces its own folders and no others, so a rerun ends with the same result, and runs of earlier
configurations stay on the leaderboard. Runs may have other columns than those before them: readers merge the schemas.
"""

from __future__ import annotations

import argparse
import json
import logging
import os
import re
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from leafmill.functions import noise as N  # noqa: E402
from leafmill.operators import lexical as L  # noqa: E402
from leafmill.operators import metrics as M  # noqa: E402
from leafmill.plans import retrieval as P  # noqa: E402
from leafmill.session import ship, spread, stored  # noqa: E402
from leafmill.sources.readers import config as read_config  # noqa: E402

log = logging.getLogger("leaderboard")
CONFIG = os.path.splitext(os.path.abspath(__file__))[0] + ".yaml"


def _named(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    return rows.select(*[F.col(v).alias(k) for k, v in names.items()])


def _put(rows: DataFrame, run: str, path: str) -> None:
    """Replaces the run's folder, whole, and no other one's; the setting is the writer's own."""
    rows.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)


def run(spark: SparkSession, pages_path: str, questions_path: str, out: str, config: dict) -> list[dict]:
    """Makes every run of the configuration, one after the other, and gives their rows of the leaderboard."""
    names = [str(r["name"]) for r in config["runs"]]
    if bad := [n for n in names if not re.fullmatch(r"[A-Za-z0-9_.-]+", n)] or [n for n in names if names.count(n) > 1]:
        raise ValueError(f"runs need names of their own, of letters, digits and _.-: {bad}")
    pages = _named(spread(spark.read.parquet(pages_path)), config["pages"])
    questions = _named(spark.read.parquet(questions_path), config["questions"])
    k = int(config.get("k", 5))
    log.info("read %d pages of %s and %d questions of %s", pages.count(), pages_path, questions.count(), questions_path)
    profile = N.Profile.of(config.get("cleaning"))
    ready = P.prepared(pages, profile)
    expected = P.expected_pages(ready, questions).persist()
    done: list[dict] = []
    # all runs share the cleaned pages and their tokens, and those that cut them the same way the chunks
    cut: dict[str, DataFrame] = {}
    for settings in config["runs"]:
        name = str(settings["name"])
        way = json.dumps(settings["chunking"], sort_keys=True)
        if way not in cut:
            cut[way] = stored(P.flat_chunks(pages, settings["chunking"], profile, ready))
        chunks = cut[way]
        # k rows for each question, which meet the chunks where these lie
        found = stored(P.rankings(chunks, questions, settings.get("retrieval"), k))
        shown = (F.broadcast(found) if found.count() <= L.FEW_PAIRS else found).join(chunks.select("doc", "page_start", "page_end"), "doc")
        hits = shown.join(expected, "qid").where(F.col("page").between(F.col("page_start"), F.col("page_end"))).select("qid", "rank", F.lit(True).alias("hit")).distinct()
        ranks = shown.join(hits, ["qid", "rank"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
        _put(ranks.select("qid", "rank", "doc", "score", "page_start", "page_end", "hit"), name, f"{out}/ranks")
        mine = spark.read.parquet(f"{out}/ranks").where(F.col("run") == name)
        first = questions.select("qid").distinct().join(mine.where("hit").groupBy("qid").agg(F.min("rank").alias("first_rank")), "qid", "left")
        told = {"strategy": settings["chunking"]["strategy"], "retrieval": (settings.get("retrieval") or {}).get("type", "dense"), "cleaning": profile.name, "k": k} | {c: v for c, v in settings["chunking"].items() if c != "strategy"}
        row = M.ranking_metrics(first).select(*[F.lit(v).alias(c) for c, v in told.items()], F.lit(chunks.count()).alias("n_chunks"), "*")
        _put(row.coalesce(1), name, f"{out}/leaderboard")
        done.append(spark.read.parquet(f"{out}/leaderboard").where(F.col("run") == name).first().asDict())
        log.info("run %s: %d chunks, wrote %d results to %s/ranks; hit@1 %.3f, hit@5 %.3f, mrr %.3f", name, done[-1]["n_chunks"], mine.count(), out, done[-1]["hit_at_1"], done[-1]["hit_at_5"], done[-1]["mrr"])
    expected.unpersist()
    return done


def ranks(spark: SparkSession, out: str) -> DataFrame:
    """(run, qid, rank, doc, score, page_start, page_end, hit) of all runs there are."""
    return spark.read.option("mergeSchema", True).parquet(f"{out}/ranks")


def leaderboard(spark: SparkSession, out: str) -> DataFrame:
    """A row of settings and metrics for each run; settings that a run doesn't have are null."""
    return spark.read.option("mergeSchema", True).parquet(f"{out}/leaderboard")


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    parser.add_argument("pages")
    parser.add_argument("questions")
    parser.add_argument("output")
    parser.add_argument("--config", default=CONFIG)
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("leaderboard").getOrCreate()
    try:
        ship(spark)
        run(spark, args.pages, args.questions, args.output, read_config(args.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
