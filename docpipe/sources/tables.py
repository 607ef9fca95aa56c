"""Scratch tables in the folder that driver and executors share, and the memory of tasks that read texts."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of an Arrow batch of texts.
TEXT_ROWS, TEXT_BYTES = 1_000, 16 << 20


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a folder of our own where it is unset."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="docpipe-")
        sc.setCheckpointDir(where)
    return where


#: Scratch tables of this process that are still there.
_held: list[str] = []


def written(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """df as a Parquet table in the shared folder, and the table's place. Cuts the lineage; survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/docpipe/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _held.append(path)
    return spark.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table that no later plan reads."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    if path in _held:
        _held.remove(path)


def release(spark: SparkSession) -> None:
    """Deletes all scratch tables of this process. Call it when results are written: what still reads them is lost."""
    for path in [*_held]:
        removed(spark, path)


def folders(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, none if there is no such folder."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in fs.listStatus(place)) if fs.exists(place) else []


def give_back() -> None:
    """Returns memory that a batch no longer needs: Python workers live on from task to task, and would keep it."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:  # glibc has it
        trim(0)


def text_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> None:
    """Lets Arrow carry so many rows at once at most: texts are long, and tasks and Python workers hold whole batches.

    Settings of the session, read when a plan runs, so they stay set.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(TEXT_BYTES))
