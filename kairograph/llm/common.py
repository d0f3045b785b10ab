"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only; every other character stays as it is."""
    return F.translate(col, UPPER, UPPER.lower())


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only in local mode, where the session names none, a folder below the
    driver's temporary folder is used instead.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = os.path.join(tempfile.gettempdir(), "checkpoints", spark.sparkContext.applicationId)
    if own not in _OWN:
        import atexit
        import shutil

        _OWN.add(own)
        spark.sparkContext.setCheckpointDir(own)
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return own


_OWN: set[str] = set()


class Scratch:
    """Tables written to the shared folder to cut lineage; ``drop`` deletes what is no longer read."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
        self.n = 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *dfs: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in dfs:
            path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(conf).delete(path, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let the context cleaner delete shuffle files of finished, unreferenced plans.

    Python's references go in the first round, so the JVM can collect the plans in the second.
    """
    import gc
    import time

    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def give_back() -> None:
    """At the end of a task: memory that is free inside the worker goes back to the machine.

    Python workers outlive their tasks, and the next task may belong to another operator.
    """
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not a libc that trims
        pass
