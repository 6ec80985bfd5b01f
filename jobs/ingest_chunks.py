"""Takes new page files as they come in, and writes their chunks, ready for an index.

    spark-submit jobs/ingest_chunks.py INPUT OUTPUT CHECKPOINT [--config jobs/ingest_chunks.yaml]

INPUT is a folder, or a pattern of paths, that Parquet files of pages are added to. A stream takes the files that its checkpoint
doesn't know, all there are, and ends. Pages are cleaned, cut into token windows, and windows that are noise are
marked with the rules they break. Each batch has a folder of its own in OUTPUT/chunks, by what was kept and by
source:

    chunks/batch=0/kept=true/source=src1/...

OUTPUT/pages lists the pages of each batch, those without a chunk too, and OUTPUT/log has a row for each batch: what
it read and wrote. A batch that was cut off is taken again with the same number and the same files, and its folders
are replaced, so a rerun ends with the same result. A page that comes again in a later batch replaces
its earlier chunks for those who read by `current`; with an empty text it takes them away.
"""

from __future__ import annotations

import argparse
import logging
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from leafmill.functions import noise as N  # noqa: E402
from leafmill.operators import chunks as C  # noqa: E402
from leafmill.sources.readers import config as read_config  # noqa: E402

log = logging.getLogger("ingest_chunks")
CONFIG = os.path.splitext(os.path.abspath(__file__))[0] + ".yaml"
RULES = ("low_signal", "reference_like", "abbreviation_like")
CHUNKS = "batch bigint, kept boolean, source string, doc_key string, page bigint, chunk_id string, ord bigint, text string, low_signal boolean, reference_like boolean, abbreviation_like boolean"
PAGES = "batch bigint, doc_key string, page bigint"
LOG = "batch bigint, pages bigint, kept bigint, noise bigint"


def chunked(pages: DataFrame, config: dict) -> DataFrame:
    """The chunks of pages (doc_key, page, text), those of noise too: a narrow step, which shuffles nothing.

    A null text has no chunk; a null doc_key stays null and shares a folder with the empty one.
    """
    profile = N.Profile.of(config.get("cleaning"))
    cleaned = pages.select("doc_key", "page", N.cleaned(F.col("text"), profile).alias("text"))
    made = C.naive(cleaned, int(config["chunking"]["chunk_size"]), int(config["chunking"]["overlap"]))
    text = F.col("text")
    rules = {"low_signal": N.low_signal(text, profile), "reference_like": N.reference_like(text), "abbreviation_like": N.abbreviation_like(text)}
    rows = made.select("doc_key", F.col("page_start").alias("page"), "chunk_id", "ord", "text", *[v.alias(k) for k, v in rules.items()])
    drops = {k: bool(getattr(profile, f"drop_{k}_chunks")) for k in RULES}
    broken = [F.col(k) for k in RULES if drops[k]]
    kept = ~F.greatest(*broken) if len(broken) > 1 else ~broken[0] if broken else F.lit(True)
    return rows.withColumn("kept", kept).withColumn("source", F.col("doc_key"))


def run(spark: SparkSession, source: str, out: str, checkpoint: str, config: dict) -> list[dict]:
    """Takes what is new in `source`, waits until it is written, and gives a row of the log for each batch."""
    names = config["columns"]
    arriving = spark.readStream.schema(config["schema"]).option("maxFilesPerTrigger", int(config.get("files_at_once", 1000))).parquet(source)
    pages = arriving.select(F.col(names["doc_key"]).alias("doc_key"), F.col(names["page"]).cast("bigint").alias("page"), F.col(names["text"]).alias("text"))
    for name, schema in {"chunks": CHUNKS, "pages": PAGES, "log": LOG}.items():
        # an empty table until the first batch, for readers; nothing where there is one
        spark.createDataFrame([], schema).write.mode("ignore").partitionBy("batch").parquet(f"{out}/{name}")
    done: list[dict] = []

    def take(rows: DataFrame, batch: int) -> None:
        session = rows.sparkSession
        at = f"{out}/chunks/batch={batch}"
        # rows of a folder come together in files of the advised size, and a source of many rows in several
        chunked(rows, config).hint("rebalance", "kept", "source").write.mode("overwrite").partitionBy("kept", "source").parquet(at)
        rows.select("doc_key", "page").write.mode("overwrite").parquet(f"{out}/pages/batch={batch}")
        # counted by what is on disk: folders and footers, no text
        read = listed(session, out).where(F.col("batch") == batch).count()
        wrote = {r.kept: r.n for r in chunks(session, out).where(F.col("batch") == batch).groupBy("kept").agg(F.count("*").alias("n")).collect()}
        figures = [read, wrote.get(True, 0), wrote.get(False, 0)]
        session.createDataFrame([figures], LOG.split(", ", 1)[1]).coalesce(1).write.mode("overwrite").parquet(f"{out}/log/batch={batch}")
        log.info("batch %d: read %d pages of %s, wrote %d chunks and %d of noise to %s", batch, figures[0], source, *figures[1:], at)
        done.append(dict(zip(("batch", "pages", "kept", "noise"), (batch, *figures), strict=True)))

    stream = pages.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
    if not done:
        log.info("nothing new in %s", source)
    return done


def chunks(spark: SparkSession, out: str) -> DataFrame:
    """All chunks as they were written, of every batch."""
    return spark.read.schema(CHUNKS).parquet(f"{out}/chunks")


def listed(spark: SparkSession, out: str) -> DataFrame:
    """(batch, doc_key, page): the pages that each batch brought."""
    return spark.read.schema(PAGES).parquet(f"{out}/pages")


def current(spark: SparkSession, out: str) -> DataFrame:
    """The chunks of each page's latest batch, without the folders' own columns."""
    rows = chunks(spark, out)
    latest = listed(spark, out).groupBy("doc_key", "page").agg(F.max("batch").alias("latest"))
    same = rows["doc_key"].eqNullSafe(latest["doc_key"]) & rows["page"].eqNullSafe(latest["page"]) & (rows["batch"] == latest["latest"])
    return rows.join(latest, same, "left_semi").drop("source", "batch")


def written(spark: SparkSession, out: str) -> DataFrame:
    """The log: (batch, pages, kept, noise)."""
    return spark.read.schema(LOG).parquet(f"{out}/log")


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    parser.add_argument("input")
    parser.add_argument("output")
    parser.add_argument("checkpoint")
    parser.add_argument("--config", default=CONFIG)
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("ingest_chunks").getOrCreate()
    try:
        run(spark, args.input, args.output, args.checkpoint, read_config(args.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
