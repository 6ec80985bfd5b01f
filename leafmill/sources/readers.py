"""Sources: pages, questions, prompts and gold entries as JSON lines; pages from HTML or text files; vectors;
YAML configurations; and the driver's tables in these roles."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.chains import running
from ..session import spread

GOLD = "id string, expected_contains array<string>, forbidden_contains array<string>, expected_regex array<string>, expect_json boolean, json_required_keys array<string>, json_array_key_len map<string, int>, expected_int_list array<int>, pass_threshold double"


def pages_jsonl(spark: SparkSession, path: str, doc_key: str = "document") -> DataFrame:
    """(doc_key, page, text). Blank lines are skipped; a line that is no JSON object with a page fails the job."""
    rows = spark.read.schema("page string, text string").option("mode", "FAILFAST").json(path)
    return rows.select(F.lit(doc_key).alias("doc_key"), F.col("page").cast("bigint").alias("page"), F.coalesce("text", F.lit("")).alias("text"))


def jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, raw) of text files of any size, a line ending with LF: lines count within a file, from 1, blank ones too.

    Files are read in splits as always. Rows of a split come in order and are counted on, so a line's number is its
    place within its split, and the lines of the splits before, which a first pass counts: a row for each split.
    A byte order mark at the beginning of a file goes, and so does the CR of a CR LF.
    """
    rows = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"), "value")
    splits = rows.groupBy("file", "start").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "start", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    line = F.col("before") + F.col("id") - F.col("first") + 1
    value = F.regexp_replace(F.when((F.col("start") == 0) & (line == 1), F.regexp_replace("value", "^\ufeff", "")).otherwise(F.col("value")), r"\r\z", "")
    return rows.join(splits, ["file", "start"]).select("file", line.alias("line"), value.alias("raw"))


def jsonl_tolerant(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, errors): the lines that parse, and (line, raw) of those that don't, by numbered_lines(); blank ones are neither."""
    lines = numbered_lines(spark, path).where(T.strip(F.col("raw")) != "").select("line", "raw", F.from_json("raw", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("x"))
    good = lines.where(F.col("x").isNotNull() & F.col("x._bad").isNull()).select("line", "x.*").drop("_bad")
    return good, lines.where(F.col("x").isNull() | F.col("x._bad").isNotNull()).select("line", "raw")


def questions_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(qid, text, expected_pages); missing expectations are none."""
    rows = spark.read.schema("id string, question string, expected_pages array<int>").json(path)
    return rows.select(F.col("id").alias("qid"), F.col("question").alias("text"), F.coalesce("expected_pages", F.array().cast("array<int>")).alias("expected_pages"))


def normal_id(c: Column) -> Column:
    return F.lower(T.strip(F.regexp_replace(c, "^﻿+", "")))


def gold_index(rows: DataFrame) -> DataFrame:
    """One gold entry for each normalised id, the last by `line`; empty ids go."""
    keyed = rows.withColumn("id", normal_id(F.coalesce("id", F.lit("")))).where("id <> ''")
    best = keyed.groupBy("id").agg(F.max_by(F.struct(*[c for c in keyed.columns if c not in ("id", "line")]), "line").alias("x"))
    return best.select("id", "x.*")


def with_prompt_ids(prompts: DataFrame) -> DataFrame:
    """Blank ids become P and the prompt's number, from 1, in the order of the whole numbers `line`, by running sums."""
    placed = running(prompts.withColumn("__all", F.lit("")).withColumn("__one", F.lit(1)), "__all", "line", "__one")
    number = (F.col("before___one") + 1).cast("string")
    return placed.withColumn("id", F.coalesce(F.nullif(T.strip(F.col("id")), F.lit("")), F.concat(F.lit("P"), number))).select(*prompts.columns)


def html_text(c: Column) -> Column:
    """The text of a page: without scripts, styles, comments and tags, line ends at blocks, common entities read."""
    c = F.regexp_replace(c, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ")
    c = F.regexp_replace(F.regexp_replace(c, r"(?i)<(br|/p|/div|/li|/h[1-6]|/tr|/title)\b[^>]*>", "\n"), r"<[^>]*>", " ")
    for name, char in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("amp", "&")):
        c = F.replace(c, F.lit(f"&{name};"), F.lit(char))
    lines = F.filter(F.transform(F.split(F.regexp_replace(c, r"[ \t\r\f]+", " "), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_join(lines, "\n")


def documents(spark: SparkSession, path: str, extract: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """(doc_key, page, text) of the files in a folder, pages from 1. `extract` gives a file's pages: a PDF
    library's text layer, for one. Without it files are UTF-8 text, their pages divided by form feeds."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("doc_key"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, content in zip(batch.column("doc_key").to_pylist(), batch.column("content").to_pylist(), strict=True):
                pages = extract(content) if extract else content.decode("utf-8", "replace").split("\f")
                yield pa.RecordBatch.from_pydict({"doc_key": [key] * len(pages), "page": pa.array(range(1, len(pages) + 1), pa.int64()), "text": pa.array(pages, pa.string())})

    return files.mapInArrow(run, "doc_key string, page bigint, text string")


def config(path: str) -> dict:
    """A YAML file; an empty one is {}."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def dotenv(path: str) -> None:
    """Sets k=v lines in the environment, never over what is set; a missing file sets nothing."""
    if not os.path.exists(path):
        return
    with open(path, encoding="utf-8") as f:
        for line in f:
            key, eq, value = line.strip().partition("=")
            if eq and not key.startswith("#"):
                os.environ.setdefault(key.strip(), value.strip().strip("\"'"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as pages: (doc_key, page, text)."""
    return spread(table(spark, sf_dir, "documents")).select(F.col("source").alias("doc_key"), F.col("doc_id").alias("page"), "text")


def questions_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """benchmark as questions: (qid, text)."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")


def vectors_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as vectors: (doc, vec)."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vec"))
