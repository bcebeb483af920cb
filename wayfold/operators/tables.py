"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the application's part of the cluster's shared checkpoint
    folder."""
    return f"{_top(spark)}/{uuid.uuid4().hex}"


def remove_intermediates(spark: SparkSession) -> None:
    """Delete all that this application stored; nothing that reads it can run after."""
    _remove(spark, _top(spark))


def removed(table: DataFrame) -> None:
    """Delete one table that stored() returned; nothing that reads it can run after."""
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        _remove(table.sparkSession, folder)


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _top(spark: SparkSession) -> str:
    sc = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not top:
        got = sc._jsc.sc().getCheckpointDir()
        top = got.get() if got.isDefined() else None
    if not top:
        if not sc.master.startswith("local"):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        top = f"{tempfile.gettempdir()}/wayfold-checkpoints"  # driver and tasks are one process
    return f"{top.rstrip('/')}/wayfold-{sc.applicationId}"


def stored(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, and the
    table outlives any executor."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Give what was let go back to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
