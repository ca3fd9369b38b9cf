"""Line formats: file maps, rewrite plans, segment heads and traces, as renderers and parsers of DataFrames of lines.

``spark.read.text`` and ``write.text`` carry the lines; the functions here are
plain column expressions, so parsing is distributed where lines stand alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FILEMAP_HEADER = "# filemap v2"
PLAN_HEADER = "# plan v1"
SECTIONS = ("anchor", "added", "superseded", "tombstoned")


def tsv(*columns: Column) -> Column:
    return F.concat_ws("\t", *(c.cast("string") for c in columns))


def filemap_lines(rows: DataFrame) -> DataFrame:
    """``value`` lines sorted by path and offset, after the header (line 0)."""
    body = rows.select(F.struct("path", "file_offset").alias("k"), tsv(F.col("path"), F.col("file_offset"), F.col("hash"), F.col("byte_count")).alias("value"))
    return body.orderBy("k").select("value")


def parse_filemap(lines: DataFrame) -> DataFrame:
    """Rows of a file map; a line of another shape is an error."""
    part = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("#"))
    ok = F.when(F.size(part) == 4, part).otherwise(F.raise_error(F.concat(F.lit("not a filemap line: "), F.col("value"))).cast("array<string>"))
    rows = rows.select(ok.alias("p"))
    return rows.select(F.col("p")[0].alias("path"), F.col("p")[1].cast("long").alias("file_offset"), F.col("p")[2].alias("hash"), F.col("p")[3].cast("long").alias("byte_count"))


def write_filemap(rows: DataFrame, path: str) -> None:
    header = rows.sparkSession.createDataFrame([(FILEMAP_HEADER,)], "value string")
    header.unionByName(filemap_lines(rows)).coalesce(1).write.text(path)


def read_filemap(spark: SparkSession, path: str) -> DataFrame:
    """The file map under ``path``; its first line must be the header of this version."""
    lines = spark.read.text(path)
    if lines.where(F.col("value") == FILEMAP_HEADER).limit(1).count() == 0:
        raise ValueError(f"{path} is not a filemap of a known version")
    return parse_filemap(lines)


def plan_lines(plan: DataFrame) -> DataFrame:
    fields = ("op", "segment_id", "entry_idx", "start_lba", "lba_length", "payload_block_offset")
    return plan.select(F.concat(F.lit("v1\t"), tsv(*(F.col(f) for f in fields))).alias("value"))


def parse_plan(lines: DataFrame) -> DataFrame:
    p = F.split("value", "\t")
    rows = lines.where(F.col("value").startswith("v1\t"))
    return rows.select(p[1].alias("op"), *(p[i + 2].cast("long").alias(n) for i, n in enumerate(("segment_id", "entry_idx", "start_lba", "lba_length", "payload_block_offset"))))


def head_lines(head: DataFrame) -> DataFrame:
    """A head ``(volume_id, section, segment_id)`` as numbered lines: all sections in order, ids sorted."""
    rank = F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("section"))
    names = head.select("volume_id").distinct().select("volume_id", F.explode(F.array(*map(F.lit, SECTIONS))).alias("section"))
    titles = names.select("volume_id", rank.alias("rank"), F.lit(-1).cast("long").alias("id"), F.concat(F.lit("["), F.col("section"), F.lit("]")).alias("value"))
    members = head.select("volume_id", rank.alias("rank"), F.col("segment_id").alias("id"), F.col("segment_id").cast("string").alias("value"))
    order = Window.partitionBy("volume_id").orderBy("rank", "id")
    return titles.unionByName(members).select("volume_id", F.row_number().over(order).alias("line"), "value")


def parse_head(lines: DataFrame) -> DataFrame:
    """Members with the section that the last title before them names."""
    title = F.when(F.col("value").startswith("["), F.regexp_extract("value", r"\[(.*)\]", 1))
    section = F.last(title, ignorenulls=True).over(Window.partitionBy("volume_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    rows = lines.withColumn("section", section).where(~F.col("value").startswith("["))
    return rows.select("volume_id", "section", F.col("value").cast("long").alias("segment_id"))


def parse_trace(lines: DataFrame) -> DataFrame:
    """Reads ``hash start count`` of a trace."""
    p = F.split(F.trim("value"), r"\s+")
    return lines.where(F.trim("value") != "").select(p[0].alias("hash"), p[1].cast("long").alias("start_byte"), p[2].cast("long").alias("byte_count"))
