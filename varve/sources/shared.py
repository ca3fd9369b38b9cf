"""The folder that driver and executors share, and cutting lineage there."""

from __future__ import annotations

import re
import tempfile
import uuid

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; one of our own only on one machine, as in tests."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not re.match(r"local(\[.*\])?$", context.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="varve-"))
    return context.getCheckpointDir()


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing is at yet."""
    return f"{checkpoint_folder(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` read back from the shared folder, so that what uses it several times computes it once."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: With this set, the files that a query shuffled are removed when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, label: str = "stored") -> DataFrame:
    """``df`` read back from compressed columns in the shared folder; what was shuffled for it goes.

    For long relations of narrow columns, of which a checkpoint would keep whole rows.
    """
    folder = fresh_folder(df.sparkSession, label)
    _write(df, folder)
    return df.sparkSession.read.parquet(folder)


def _write(df: DataFrame, folder: str) -> None:
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(folder)
    finally:
        spark.conf.set(CLEANUP, before)


def part_of(df: DataFrame, part: int, parts: int, key: str = "volume_id") -> DataFrame:
    """The rows of one of ``parts`` parts, dealt by ``key``; the parts together are ``df``."""
    return df if parts == 1 else df.where(F.pmod(F.xxhash64(key), F.lit(parts)) == part)


def stored_parts(make: Callable[[int], DataFrame], parts: int, label: str = "stored", merge: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``make(0)`` to ``make(parts - 1)``, stored one after the other as by :func:`stored` and read back together.

    What one part shuffles goes before the next begins, so it takes the room of
    one part. With ``merge`` several parts are stored as one relation by it, and
    go.
    """
    first = make(0)
    spark = first.sparkSession
    folder = fresh_folder(spark, label)
    for part in range(parts):
        _write(make(part) if part else first, f"{folder}/{part}")
    whole = spark.read.schema(first.schema).parquet(*(f"{folder}/{part}" for part in range(parts)))
    if merge is None or parts == 1:
        return whole
    whole = stored(merge(whole), label)
    remove(spark, folder)
    return whole


def remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """What one part of several needs stored while it is made: the next part's takes its place."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark, self.label, self.folder = spark, label, None

    def store(self, df: DataFrame) -> DataFrame:
        """As :func:`stored`; what was stored here before goes."""
        self.clear()
        self.folder = fresh_folder(self.spark, self.label)
        _write(df, self.folder)
        return self.spark.read.parquet(self.folder)

    def clear(self) -> None:
        if self.folder:
            remove(self.spark, self.folder)
        self.folder = None


def keep_together(spark: SparkSession) -> None:
    """From now on joins by several columns use rows that are dealt by one of them as they lie, instead of dealing them out again."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
