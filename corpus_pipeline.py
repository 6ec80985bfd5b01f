"""A corpus pipeline: toxicity, line dedup, near-dedup, decontamination, and BPE, each by its operator.

Each stage takes what the one before kept, written as Parquet and read again. All but the last return the
columns of documents. The rows of run() depend on a fitted model and on hashes that DuckDB lacks, so there
is no SQL; the tests hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafmill.llm import bpe, decontaminate, linededup, simhash, toxicity
from leafmill.llm.common import fresh_path
from leafmill.llm.queries import documents, tokenizer

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5 stay. The fit is on labelled documents that aren't held out.

    Null and empty texts score as what they are, texts without words, and so do very long ones as a whole. Rows that
    repeat fare alike; a row without doc_id is scored and has no label. Other columns stay as they are, whatever their
    names. An empty table gives an empty one.
    """
    machine = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.scored(docs, machine, below=0.5)


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines and passages within lines are cut; documents left without a word by that go.

    Null and empty texts stay; ties and repeated rows go by doc_id, null first, then the text's hash. Rows that
    repeat both are one document. Texts of any length are taken whole, other columns stay, and an empty table gives
    an empty one.
    """
    return linededup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document of the smallest doc_id stays.

    Texts without words, null ones too, are one group. Of rows that repeat one stays; where a doc_id stands in two
    groups each keeps a row. Rows without doc_id all stay. Other columns stay, and an empty table gives an empty one.
    """
    return simhash.deduplicated(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go.

    A null or empty text has no words and stays, as does everything if the benchmark is empty; texts are searched
    whole. Rows that repeat fare alike, rows without doc_id too. Other columns stay, and an empty table gives an empty one.
    """
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of what they decode to, for each document left.

    A null text is an empty one, which has no ids. Every row has a row, those that repeat or lack a doc_id too. Other
    columns are left aside, and an empty table gives an empty one.
    """
    return bpe.encode_documents(docs.select("doc_id", "text"), tokenizer("word_bpe_49k.json"), digests=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", cut_lines),
    ("near-dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
