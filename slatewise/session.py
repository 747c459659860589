"""Session helpers shared by every subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


#: Environment of Python workers: arrays that are freed go back to the system, so that a worker that waits holds little.
WORKER_MEMORY = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_MMAP_THRESHOLD_": "4194304", "MALLOC_TRIM_THRESHOLD_": "33554432", "MALLOC_ARENA_MAX": "2"}
#: Rows of an Arrow batch: whole texts go through batches, and a worker's memory grows with them.
BATCH_ROWS = 1000


def workers_see(spark: SparkSession) -> None:
    """Let Python workers import this package even if only the driver's sys.path names it, and keep their batches small."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    env = spark.sparkContext.environment
    for name, value in WORKER_MEMORY.items():
        env.setdefault(name, value)
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *parts])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of the standard layout."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder all machines share; a local one only where the session names none and runs on one machine (tests)."""
    there = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if there:
        return there
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir isn't set: it must name a folder that all machines share")
    here = spark.conf.get("slatewise.scratch.dir", None)
    if not here:
        here = "file://" + tempfile.mkdtemp(prefix="slatewise-")
        spark.conf.set("slatewise.scratch.dir", here)
    return here


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Cut the lineage of `df`: write it to the shared folder as Parquet and read it again."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what `written` wrote for these frames; what was made of them must have been written itself."""
    for df in frames:
        jvm, path = df.sparkSession._jvm, df._written_at
        path = jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
