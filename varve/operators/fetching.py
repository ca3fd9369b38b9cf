"""Fetch planning: which absent bodies to read together.

Only data entries, canonical ones too, have bodies in the body section; what
lies between two of them there is a gap that one read does not cross.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varve.functions.scalars import is_data

#: Bytes of a coalesced read.
CAP = 256 << 10


def adjacent_runs(entries: DataFrame, broken: Column) -> DataFrame:
    """``entries`` with ``run``: the number of breaks up to each one, in entry order of its segment.

    An entry breaks the run if ``broken`` says so or if its body does not begin
    where the one before it ends.
    """
    order = Window.partitionBy("segment_id").orderBy("entry_idx")
    before = F.lag(F.col("body_offset") + F.col("stored_length")).over(order)
    flag = F.coalesce(broken | (before != F.col("body_offset")), F.lit(True))
    return entries.withColumn("fresh", flag.cast("long")).withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))


def warm_batches(entries: DataFrame, cap: int = CAP) -> DataFrame:
    """``segment_id, batch, first_entry, entries, bytes``: neighbouring absent bodies, up to ``cap`` bytes.

    ``entries`` with ``body_offset``. Entries without a body in the body section
    are passed over, a present one ends a batch, and so does a gap. The first
    entry of a batch is always in. Filling up to the cap is sequential: a
    built-in fold over each run of neighbours, which keeps the open batch apart
    from the closed ones, so an entry costs the same wherever it stands.
    """
    bodies = entries.where(is_data(F.col("kind")) & (F.col("stored_length") > 0))
    order = Window.partitionBy("segment_id").orderBy("entry_idx")
    rows = adjacent_runs(bodies.withColumn("after_present", F.coalesce(F.lag("present").over(order), F.lit(True))), F.col("after_present"))
    rows = rows.where(~F.col("present")).groupBy("segment_id", "run").agg(F.array_sort(F.collect_list(F.struct("entry_idx", F.col("stored_length").alias("n")))).alias("rows"))
    batch = "struct<first_entry:bigint,entries:bigint,bytes:bigint>"
    start = F.struct(F.array().cast(f"array<{batch}>").alias("closed"), F.lit(None).cast(batch).alias("open"))

    def step(s: Column, r: Column) -> Column:
        held = s["open"]
        room = held.isNotNull() & (held["bytes"] + r["n"] <= cap)
        longer = F.struct(held["first_entry"].alias("first_entry"), (held["entries"] + 1).alias("entries"), (held["bytes"] + r["n"]).alias("bytes"))
        fresh = F.struct(r["entry_idx"].alias("first_entry"), F.lit(1).cast("long").alias("entries"), r["n"].alias("bytes"))
        closed = F.when(room | held.isNull(), s["closed"]).otherwise(F.concat(s["closed"], F.array(held)))
        return F.struct(closed.alias("closed"), F.when(room, longer).otherwise(fresh).alias("open"))

    whole = F.aggregate("rows", start, step, lambda s: F.concat(s["closed"], F.array(s["open"])))
    out = rows.select("segment_id", F.explode(whole).alias("b")).select("segment_id", "b.*")
    return out.withColumn("batch", F.row_number().over(Window.partitionBy("segment_id").orderBy("first_entry")).cast("long") - 1)


def forward_reads(entries: DataFrame, targets: DataFrame, cap: int = CAP) -> DataFrame:
    """What one read from each target entry brings: ``segment_id, target, entries, bytes``.

    The target is always read. Entries after it follow while they are absent
    data whose bodies are adjacent, up to ``cap`` bytes in all. ``entries`` with
    ``body_offset``.
    """
    rows = adjacent_runs(entries, ~is_data(F.col("kind")) | F.col("present"))
    t = rows.join(targets.select("segment_id", "entry_idx"), ["segment_id", "entry_idx"], "left_semi")
    t = t.select("segment_id", "run", F.col("entry_idx").alias("target"), F.col("body_offset").alias("from"))
    met = t.join(rows.select("segment_id", "run", "entry_idx", "body_offset", "stored_length"), ["segment_id", "run"])
    stop = F.col("body_offset") + F.col("stored_length")
    met = met.where((F.col("entry_idx") == F.col("target")) | ((F.col("entry_idx") > F.col("target")) & (stop - F.col("from") <= cap)))
    return met.groupBy("segment_id", "target").agg(F.count("*").alias("entries"), F.sum("stored_length").alias("bytes"))


def hint_bits(words: DataFrame, entries_of: DataFrame) -> DataFrame:
    """Set bits below each segment's entry count: ``segment_id, entry_idx``."""
    met = words.join(entries_of, "segment_id")
    bit = met.withColumn("nth", F.explode(F.sequence(F.lit(0), F.lit(31))))
    held = F.expr("shiftright(bits, nth) & 1") == 1
    at = F.col("word") * 32 + F.col("nth")
    return bit.where(held & (at < F.col("count"))).select("segment_id", (at + 1).alias("entry_idx"))


def overlapping_leases(leases: DataFrame) -> DataFrame:
    """Pairs of inclusive ranges of one segment that overlap, the earlier id first."""
    b = leases.select("segment_id", F.col("lease_id").alias("other"), F.col("first").alias("first_b"), F.col("last").alias("last_b"))
    met = leases.join(b, "segment_id").where((F.col("lease_id") < F.col("other")) & (F.col("first") <= F.col("last_b")) & (F.col("first_b") <= F.col("last")))
    return met.select("segment_id", "lease_id", "other")


def full_warm(entries: DataFrame, referenced: DataFrame) -> DataFrame:
    """Absent bodies that the current map refers to, by segment."""
    rows = entries.where(~F.col("present") & (F.col("stored_length") > 0)).join(referenced.select("hash").distinct(), "hash", "left_semi")
    return rows.groupBy("segment_id").agg(F.count("*").alias("entries"), F.sum("stored_length").alias("bytes"))
