"""What the operators of this subpackage share: the shared folder, saved tables, and plain word splitting."""

from __future__ import annotations

import atexit
import re
import shutil
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..session import removed_at_exit

#: Runs of digits, letters and everything beyond ASCII, once A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
_FIND_WORDS = re.compile(WORD).findall


def ascii_lower(text: str) -> str:
    """Lower-cases A-Z only."""
    low = text.lower()
    return low if text.isascii() or len(low) == len(text) and text.translate(_ASCII_LOWER) == low else text.translate(_ASCII_LOWER)


def words(text: str | None) -> list[str]:
    return _FIND_WORDS(ascii_lower(text)) if text else []


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors see.

    It is the one that spark.checkpoint.dir names. Where that is unset, a local master gets a folder of
    its own, removed at exit; on a cluster this raises, as no folder can be assumed to be shared.
    """
    set_to = spark.conf.get("spark.checkpoint.dir", None)
    if set_to:
        return set_to.rstrip("/")
    context = spark.sparkContext
    known = getattr(context, "_leafmill_shared", None)
    if known:
        return known
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = f"/tmp/checkpoints/leafmill-{uuid.uuid4().hex}"
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    context._leafmill_shared = f"file://{made}"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(f"file://{made}/checkpoints")
    return context._leafmill_shared


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/leafmill/{name}-{uuid.uuid4().hex}"


#: Removes the shuffle files of a query from the executors' disks when it ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: its lineage ends in files that outlive any executor.

    What was shuffled on the way goes at once, as nothing reads it any more. The table goes when the driver ends.
    """
    path = fresh_path(df.sparkSession, name)
    conf = df.sparkSession.conf
    before = conf.get(_CLEAN)
    conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(_CLEAN, before)
    removed_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows and bytes of an Arrow batch, unless the session sets others: what a task holds outside the heap.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


def mapped(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(run, schema) with small batches, so that long texts and many rows take bounded memory."""
    conf = df.sparkSession.conf
    given = conf.getAll
    for key, value in BATCH.items():
        if key not in given:
            conf.set(key, value)
    return df.mapInArrow(run, schema)


def filesystem(path: str):
    """(pyarrow file system, path in it) of a URI or local path, for Python code on executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path)


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts or binaries in `column` take about `most` bytes, one row at least."""
    for batch in batches:
        sizes = batch.column(column)
        lengths = pc.fill_null(pc.binary_length(sizes), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, n in enumerate(lengths):
            if i > start and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)
