"""Helpers shared by the operators: tables, the shared folder, Arrow batches."""

from __future__ import annotations

import gc
import time
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only on one machine (master local) where the session names no shared folder, as in tests.
LOCAL_SHARED = "/tmp/checkpoints/prosemill"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a local one serves on one
    machine; a cluster must name one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = LOCAL_SHARED
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new, unique path under the shared folder."""
    return f"{shared_root(spark)}/prosemill-{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back, which cuts lineage and outlives executors."""
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a path of the shared folder through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Tables of one operator in the shared folder, by name; they can be deleted once nothing reads them."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.root, self.tables = spark, shared_path(spark, tag), {}

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        self.tables[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def settled(self) -> None:
        """Lets go of the shuffle files of plans that have ended, which the written tables stand for. They go when the driver
        collects its garbage, which it is asked to do: else they stay on executors' disks for up to half an hour."""
        for _ in range(2):  # what has just ended is still held by the events that tell of it
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            time.sleep(0.3)

    def cleared(self, *names: str) -> None:
        """Deletes tables that nothing reads any more."""
        for name in names:
            removed(self.spark, self.tables.pop(name))
        self.settled()


def held_out(doc_id: Column) -> Column:
    """Rows whose labels must not be learnt from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def among(rows: DataFrame, keys: DataFrame, columns: list[Column], kept: bool = True, most: int = 8 << 20) -> DataFrame:
    """The rows whose columns are among keys, or with kept=False the others. keys: as many longs a row; null equals null.

    Keys of up to most bytes are broadcast, which spares the rows a shuffle; beyond it both sides are shuffled.
    """
    keys = written(keys.select([F.col(c).cast("long").alias(f"__key{k}") for k, c in enumerate(keys.columns)]).distinct(), "keys")
    side = F.broadcast(keys) if keys.count() * 8 * len(columns) <= most else keys
    same = reduce(Column.__and__, [c.eqNullSafe(side[f"__key{k}"]) for k, c in enumerate(columns)])
    return rows.join(side, same, "left_semi" if kept else "left_anti")
