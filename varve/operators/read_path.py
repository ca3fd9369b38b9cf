"""Read path: resolving probes to bytes, verifying content, chunk trees and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varve.operators import intervals as iv


def range_read(lbamap: DataFrame, requests: DataFrame, bodies: DataFrame, zero_hash: str, block: int) -> DataFrame:
    """``request_id, lba, state, payload``: one row for each block of each probe.

    Gaps and the zero hash read as zeros (an empty payload); a mapped hash
    without a body is ``missing``. Bodies join last and only by the hashes that
    the probes reach.
    """
    runs = iv.extents_in_range(lbamap, requests)
    at = runs.withColumn("lba", F.explode(F.sequence("range_start", F.col("range_end") - 1)))
    at = at.select("request_id", "lba", "hash", (F.col("payload_block_offset") + F.col("lba") - F.col("range_start")).alias("nth"))
    wanted = requests.withColumn("lba", F.explode(F.sequence("start_lba", F.col("end_lba") - 1))).select("request_id", "lba")
    met = wanted.join(at, ["request_id", "lba"], "left").join(bodies.select("hash", "body"), "hash", "left")
    state = F.when(F.col("hash").isNull(), "gap").when(F.col("hash") == zero_hash, "zero").when(F.col("body").isNull(), "missing").otherwise("data")
    payload = F.when(state == "data", F.substring("body", (F.col("nth") * block + 1).cast("int"), F.lit(block))).otherwise("")
    return met.select("request_id", "lba", state.alias("state"), payload.alias("payload"))


def verified_content(lbamap: DataFrame, bodies: DataFrame, zero_hash: str) -> DataFrame:
    """For each hash of the map: ``ok``, ``mismatch`` or ``unresolvable``, and its lowest block."""
    hashes = lbamap.where(F.col("hash") != zero_hash).groupBy("hash").agg(F.min("start_lba").alias("lowest_lba"))
    met = hashes.join(bodies.select("hash", "body"), "hash", "left")
    state = F.when(F.col("body").isNull(), "unresolvable").when(F.sha2("body", 256) == F.col("hash"), "ok").otherwise("mismatch")
    return met.select("hash", "lowest_lba", state.alias("state"))


def chunk_table(items: DataFrame, size: int, key: str = "file_id", body: str = "body") -> DataFrame:
    """Fixed chunks of each body in code points: ``chunk, offset, length, hash``; the last one may be shorter."""
    count = F.ceil(F.length(body) / size)
    rows = items.where(F.length(body) > 0).select(key, body, F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("chunk"))
    piece = F.substring(body, (F.col("chunk") * size + 1).cast("int"), F.lit(size))
    return rows.select(key, "chunk", (F.col("chunk") * size).alias("offset"), F.length(piece).cast("long").alias("length"), F.sha2(piece, 256).alias("hash"))


def chunk_roots(chunks: DataFrame, key: str = "file_id") -> DataFrame:
    """A root for each body: the hash of its chunk hashes in order."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("chunk", "hash"))), lambda c: c["hash"])
    return chunks.groupBy(key).agg(F.sha2(F.concat_ws("", parts), 256).alias("root"), F.count("*").alias("chunks"))


def covering_chunks(reads: DataFrame, size: int) -> DataFrame:
    """First and last chunk that each read ``(start, end)`` needs, and the share of their bytes that it asks for."""
    first, last = F.floor(F.col("start") / size), F.floor((F.col("end") - 1) / size)
    return reads.select("*", first.alias("first_chunk"), last.alias("last_chunk"), ((F.col("end") - F.col("start")) / ((last - first + 1) * size)).alias("used_share"))


def offsets(items: DataFrame, by: str, order: list[str], size: str) -> DataFrame:
    """Start of each item in its group: the running sum of the sizes before it."""
    before = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return items.withColumn("body_offset", F.coalesce(F.sum(size).over(before), F.lit(0)))


def placed(items: DataFrame, stretch: Column, order: list[str], size: str) -> DataFrame:
    """Start of each item in one sequence of all: the running sum of the sizes before it in ``order``.

    ``stretch`` never falls along the order. Sums by stretch come first, so the
    window over all is over one row a stretch and the others run side by side.
    """
    rows = items.withColumn("stretch", stretch)
    sums = rows.groupBy("stretch").agg(F.sum(size).alias("total"))
    sums = sums.select("stretch", (F.sum("total").over(Window.orderBy("stretch")) - F.col("total")).alias("ahead"))
    inside = Window.partitionBy("stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(sums, "stretch").withColumn("body_offset", F.col("ahead") + F.sum(size).over(inside) - F.col(size))
    return rows.drop("stretch", "ahead")


def rate(part: Column, whole: Column) -> Column:
    """``part / whole``, 0 where there is no whole."""
    return F.when(whole == 0, 0.0).otherwise(part / whole)
