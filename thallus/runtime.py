"""Where durable intermediate results go, and who clears them away."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Only a local session may fall back to a folder of its own: on a cluster a
    machine-local folder would be lost with its executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="thallus-")
    context.setCheckpointDir(folder)
    return folder


def _stored(df: DataFrame, **options: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/thallus-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to shared storage and read back.

    Every later reader sees the same rows, the plan before it is cut, and a lost executor
    replays nothing of it.  As a table it also prunes columns and tells the optimizer its
    true size.
    """
    return _stored(df)[0]


@contextmanager
def batches_of(spark: SparkSession, size: int) -> Iterator[None]:
    """Jobs run inside hand rows to Python in batches of at most ``size`` bytes: for rows of many kilobytes each."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Scratch:
    """Owner of stored tables: ``keep`` stores one, ``drop`` deletes those no longer needed.

    As a context manager it drops whatever is left on leaving, so what is built from the
    tables must be consumed (written, collected or kept elsewhere) inside the block.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self._held = spark, []

    def keep(self, df: DataFrame, **options: str) -> DataFrame:
        held, path = _stored(df, **options)
        self._held.append((held, path))
        return held

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            for entry in [e for e in self._held if e[0] is table]:
                self._held.remove(entry)
                where = self.spark._jvm.org.apache.hadoop.fs.Path(entry[1])
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def tidy(self) -> None:
        """Let Spark delete the shuffle files of finished steps now: it does so when their plans are collected."""
        gc.collect()
        self.spark._jvm.System.gc()

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *failure) -> None:
        self.drop(*[table for table, _ in self._held])
