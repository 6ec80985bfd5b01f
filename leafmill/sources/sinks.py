"""Sinks: JSON lines, one pretty JSON document for small results, and leaderboards that rows are appended to."""

from __future__ import annotations

import json
import os
import shutil

from pyspark.sql import DataFrame


def write_jsonl(df: DataFrame, path: str) -> None:
    """One object a line, characters unescaped, a file for each partition."""
    df.write.mode("overwrite").json(path)


def write_report(rows: DataFrame, path: str, most: int = 10_000) -> None:
    """A small result as one indented JSON file on the driver; more than `most` rows raise."""
    got = rows.limit(most + 1).toJSON().collect()
    if len(got) > most:
        raise ValueError(f"more than {most} rows; write_jsonl takes any number")
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump([json.loads(x) for x in got], f, ensure_ascii=False, indent=2)


def append_leaderboard(rows: DataFrame, path: str, kind: str = "csv") -> None:
    """Appends rows in the order of their columns to a folder of files, each with a header (csv), or Parquet."""
    writer = rows.coalesce(1).write.mode("append")
    writer.option("header", True).csv(path) if kind == "csv" else writer.parquet(path)


def echo_configs(paths: list[str], run_dir: str) -> None:
    os.makedirs(run_dir, exist_ok=True)
    for p in paths:
        shutil.copy(p, run_dir)


def write_vectors(vectors: DataFrame, path: str) -> None:
    """(doc, vec) as Parquet, sorted by doc within files, so that a store can be read and pruned by it."""
    vectors.sortWithinPartitions("doc").write.mode("overwrite").parquet(path)
