"""Analytical commands as functions: over a volume's folder, over two images' files, and over volumes and their events.

A volume's folder holds what :func:`save` writes: the segments' index, marks and
bodies, the table of segments, log files ``wal/<id>.wal`` and cache files
``caches/<segment>.cache``. Every command returns a DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varve.functions import sketches as sk
from varve.operators import compaction as gc
from varve.operators import events as ev
from varve.operators import intervals as iv
from varve.operators import lineage as li
from varve.operators import reports as re
from varve.operators import similarity as si
from varve.sources import cache_format as cf
from varve.sources import segment_store as ss
from varve.sources import text_formats as tf
from varve.sources import wal_format as wf


def save(entries: DataFrame, segments: DataFrame, bodies: DataFrame, folder: str) -> None:
    """Write a volume's segments, and the bodies ``(segment_id, entry_idx, body)``."""
    ss.write_segments(entries, folder, bodies)
    segments.write.parquet(f"{folder}/segments")


def segments_of(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/segments")


# --- one volume ---


def inspect_segment(spark: SparkSession, folder: str, segment_id: int) -> DataFrame:
    """Entries of one segment with the places of their bytes."""
    return ss.read_index(spark, folder).where(F.col("segment_id") == segment_id)


def inspect(spark: SparkSession, folder: str) -> DataFrame:
    """Entries, blocks and bytes by kind, by tier, and in all."""
    return re.totals(ss.read_index(spark, folder).join(segments_of(spark, folder).select("segment_id", "tier"), "segment_id"))


def verify(spark: SparkSession, folder: str) -> DataFrame:
    """One row: segments, bodies checked, entries without body or not present, mismatches, and segments whose index is not what was written."""
    index = ss.read_index(spark, folder)
    good = ss.intact(index, spark.read.parquet(f"{folder}/marks"))
    rows = index.join(good, "segment_id", "left_semi").join(ss.read_bodies(spark, folder), ["segment_id", "entry_idx"], "left")
    bodied, there = F.col("body").isNotNull(), F.col("present")
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    found = rows.agg(F.countDistinct("segment_id").alias("segments"), count(bodied & there).alias("checked"), count(~bodied).alias("skipped_no_body"), count(bodied & ~there).alias("skipped_not_present"), count(bodied & there & (F.sha2("body", 256) != F.col("hash"))).alias("mismatches"))
    every = index.agg(F.countDistinct("segment_id").alias("all"))
    return found.crossJoin(every).withColumn("scan_errors", F.col("all") - F.col("segments")).drop("all")  # two single rows


def dump_lbamap(spark: SparkSession, folder: str) -> DataFrame:
    return iv.rebuild(ss.read_index(spark, folder), segments_of(spark, folder))


def block_hash(spark: SparkSession, folder: str, volume_id: int, lba: int) -> DataFrame:
    """The run that holds a block; no row if nothing does."""
    return dump_lbamap(spark, folder).where((F.col("volume_id") == volume_id) & (F.col("start_lba") <= lba) & (iv.end() > lba))


def verify_content(spark: SparkSession, folder: str) -> DataFrame:
    """Each hash of the map: ``ok``, ``mismatch`` or ``unresolvable``."""
    index = ss.read_index(spark, folder)
    bodies = index.select("segment_id", "entry_idx", "hash").join(ss.read_bodies(spark, folder), ["segment_id", "entry_idx"]).groupBy("hash").agg(F.min("body").alias("body"))
    hashes = dump_lbamap(spark, folder).select("hash").distinct().join(bodies, "hash", "left")
    state = F.when(F.col("body").isNull(), "unresolvable").when(F.sha2("body", 256) == F.col("hash"), "ok").otherwise("mismatch")
    return hashes.select("hash", state.alias("state"))


def reap(spark: SparkSession, folder: str, floor: int) -> DataFrame:
    """Segments above the floor that nothing reaches, and which of them a pass admits."""
    index, segments = ss.read_index(spark, folder), segments_of(spark, folder)
    return gc.capped(gc.unreachable(index, segments, iv.rebuild(index, segments), floor))


def inspect_wal(spark: SparkSession, folder: str) -> DataFrame:
    return wf.read_logs(spark, f"{folder}/wal")


def inspect_cache(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the cache files up to the first broken one of each."""
    files = spark.read.format("binaryFile").load(f"{folder}/caches")
    return cf.parsed_caches(files.select(F.regexp_extract("path", r"(\d+)\.cache$", 1).cast("long").alias("segment_id"), "content")).drop("data")


def sketch_index(spark: SparkSession, folder: str, least_bytes: int = sk.LEAST_BYTES) -> DataFrame:
    """Counts of the similarity index over the volume's bodies."""
    index = ss.read_index(spark, folder).where("kind in ('data', 'canonical_data')")
    rows = index.select("segment_id", "entry_idx", "hash").join(ss.read_bodies(spark, folder), ["segment_id", "entry_idx"])
    first = rows.groupBy("hash").agg(F.min(F.struct("segment_id", "entry_idx", "body")).alias("f"))
    source = F.col("f.segment_id") * (1 << 20) + F.col("f.entry_idx")
    return si.index_stats(first.select(source.alias("source_id"), "hash", sk.sketch_column(F.col("f.body").cast("binary"), least_bytes=least_bytes).alias("sketch")))


# --- two images: tables (path, body, hash, bytes) ---


def extents(before: DataFrame, after: DataFrame) -> DataFrame:
    return re.class_totals(re.file_classes(before, after))


def rename_analysis(before: DataFrame, after: DataFrame) -> DataFrame:
    return re.renames(before, after)


def sparse_analysis(before: DataFrame, after: DataFrame, block: int = re.BLOCK) -> DataFrame:
    return re.sparse_buckets(before, after, block)


def image_overlap(before: DataFrame, after: DataFrame) -> DataFrame:
    return re.overlap(before, after)


def generate_filemap(files: DataFrame, path: str) -> DataFrame:
    """Write the file map of ``files (path, hash, bytes)`` and read it back."""
    tf.write_filemap(files.select("path", F.lit(0).cast("long").alias("file_offset"), "hash", F.col("bytes").alias("byte_count")), path)
    return tf.read_filemap(files.sparkSession, path)


# --- volumes and their events ---


def volume_list(volumes: DataFrame, which: str = "all") -> DataFrame:
    """``volumes (volume_id, name, readonly)`` as the filter ``all``, ``readonly`` or ``writable`` lists them, in order."""
    return li.listing(volumes).where(F.col("filter") == which).orderBy("place")


def volume_tree(lineage: DataFrame) -> DataFrame:
    return li.tree(lineage).orderBy("path")


def volume_events(events: DataFrame, name: int, limit: int = 20) -> DataFrame:
    """The newest events of one name, newest first."""
    return ev.recent_walk(events.where(F.col("name") == name), limit).orderBy("place")


def volume_status(events: DataFrame) -> DataFrame:
    """Each name's state after its events."""
    return ev.lifecycle(events, ev.transitions(events.sparkSession))
