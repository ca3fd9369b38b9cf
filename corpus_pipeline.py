"""A training corpus from ``documents``: five stages, each over all that the last one kept.

Stages: quality classifier, exact dedup, near dedup, mixing by source, packing.
Every stage's result is written as Parquet and reread as the next one's input.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from varve.llm import exact_dedup, mixing, near_dedup, packing, quality
from varve.llm.common import shared_folder, small_batches, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    small_batches(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text, the smallest id."""
    return exact_dedup.exact_dedup(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the smallest id."""
    return near_dedup.near_dedup(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality", good_documents),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("mixing", mixed_sources),
    ("packing", packed_sequences),
]

#: SQL has no attention model and no tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage has read is removed once its result is written."""
    small_batches(spark)
    docs, read = table(spark, sf_dir, "documents"), None
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        remove(spark, read)
        read = f"{folder}/{name}"
        docs = spark.read.parquet(read)
    packed = STAGES[-1][1](spark, docs, sf_dir)
    remove(spark, folder)  # the packer's pieces stand in the checkpoint folder
    return packed


def remove(spark: SparkSession, folder: str | None) -> None:
    if folder:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
