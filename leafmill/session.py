"""Sessions, and getting this package to the executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("leafmill")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Sends this package's sources to the Python workers, once for each context.

    They are small; workers that have the package on their path already take either copy.
    """
    context = spark.sparkContext
    if getattr(context, "_leafmill_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="leafmill-")
    target = os.path.join(folder, "leafmill.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    context.addPyFile(target)
    context._leafmill_shipped = True


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer splits than the cluster has cores, dealt out to all of them; larger ones as they are.

    Such a table is small, so the shuffle is too, and without it a single task would do all the work on it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which the driver and all executors see. Where it is unset, a local
    master has one of its own, removed at exit; a cluster has none, and this raises."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not getattr(context, "_leafmill_folder", None):
        made = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        context._leafmill_folder = f"file://{made}"
    return context._leafmill_folder


def removed_at_exit(spark: SparkSession, path: str) -> None:
    """Has Hadoop's file system delete a path when the driver ends."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)


def stored(df: DataFrame) -> DataFrame:
    """df, written to the shared folder now and read from there: made once however many branches of a plan read it, at
    the same time too, each the columns that it needs; and what an executor takes along when it is lost isn't in it.
    The table goes when the driver ends."""
    path = f"{shared_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    removed_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
