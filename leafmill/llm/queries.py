"""The queries of this subpackage: each applies its operator, with production parameters, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread
from . import bpe, decontaminate, filteraudit, licenses, linededup, media, pii, secrets, simhash, sql, tokenfiles, topk, toxicity


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(media.load(spark, media.store(documents(spark, sf_dir))))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digests(licenses.scan(documents(spark, sf_dir).select("doc_id", "text")))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    items = F.size("item_ids").cast("bigint").alias("n_items")
    return found.select("doc_id", "n_words", "n_hit", items, decontaminate.items_digest(F.col("item_ids")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = linededup.deduplicated(documents(spark, sf_dir).select("doc_id", "text"), report=True)
    return cut.select("doc_id", "n_lines", "n_cut", "n_left", "n_chars_cut", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = tokenfiles.write_tokens(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"))
    return tokenfiles.read_tokens(spark, manifest)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.scan(documents(spark, sf_dir).select("doc_id", "text")))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return bpe.encode_documents(docs, tokenizer("word_bpe_49k.json"), digests=True)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    machine = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scores = toxicity.scored(docs, machine)
    return scores.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = secrets.train(secrets.default_samples(spark))
    return secrets.digests(secrets.scan(documents(spark, sf_dir).select("doc_id", "text"), table))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(filteraudit.masks(documents(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(spread(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_media": op1_media,
        "op2_licenses": op2_licenses,
        "op3_decontamination": op3_decontamination,
        "op4_line_dedup": op4_line_dedup,
        "op5_token_files": op5_token_files,
        "op6_pii": op6_pii,
        "op7_bpe": op7_bpe,
        "op8_toxicity": op8_toxicity,
        "op9_simhash": op9_simhash,
        "op10_secrets": op10_secrets,
        "op11_filter_audit": op11_filter_audit,
        "op12_topk": op12_topk,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_licenses": sql.licenses(), "op3_decontamination": sql.decontamination(), "op11_filter_audit": filteraudit.sql(), "op12_topk": topk.sql()}
