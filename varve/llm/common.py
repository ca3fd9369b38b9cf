"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the text contracts: space and the ASCII controls tab to carriage return.
SPACE = " \t\n\x0b\x0c\r"
SPACE_RE = r"[\x20\x09-\x0D]+"
WORD_RE = r"[^\x20\x09-\x0D]+"


#: Rows and bytes of a batch between Spark and Python: whole texts are long, and batches are held on both sides.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def small_batches(spark: SparkSession) -> None:
    """Bound the batches that this session's plans hand to Python from now on."""
    for key, value in BATCHES.items():
        spark.conf.set(key, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    A folder of our own is set only where the session names none and runs on one
    machine, as in tests; a cluster has to name one that its executors share.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not re.match(r"local(\[.*\])?$", context.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="varve-checkpoint-"))
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """``df`` of a few narrow columns, marked for broadcast if it has at most ``rows`` rows; otherwise the join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


_KEPT: dict[str, object] = {}


def kept(key: str, make):
    """What a Python worker keeps from task to task, of one operator at a time: ``make()`` on first use."""
    if key not in _KEPT:
        _KEPT.clear()
        let_go()
        _KEPT[key] = make()
    return _KEPT[key]


def let_go() -> None:
    """Hand memory that this process no longer uses back to the machine, so that the next operator's comes in its place."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not on every platform
        ctypes.CDLL(None).malloc_trim(0)


def crc_part(doc_id: Column, parts: int) -> Column:
    """crc32 of the id's decimal text modulo ``parts``; null ids are in part 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts, F.lit(0))


def task_folder() -> str:
    """A scratch folder of this task's own machine, for spill files only."""
    return os.environ.get("TMPDIR") or tempfile.gettempdir()
