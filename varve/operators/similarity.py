"""Similarity search over sketches, and choosing sources of deltas.

An inverted index maps features to the sources that have them, the earliest
``CAP`` of each. Candidates are ranked by the number of features they share.
"""

from __future__ import annotations

from collections import OrderedDict

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Sources that a feature lists, and candidates of a search.
CAP, LIMIT = 32, 4


def postings(sketches: DataFrame, cap: int = CAP) -> DataFrame:
    """``feature, source_id, hash, place``: the earliest ``cap`` sources of each feature, each listed once."""
    rows = sketches.where("sketch is not null").select("source_id", "hash", F.explode(F.array_distinct("sketch")).alias("feature"))
    place = F.row_number().over(Window.partitionBy("feature").orderBy("source_id"))
    return rows.withColumn("place", place).where(F.col("place") <= cap)


def candidates(targets: DataFrame, index: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``target_id, source_id, hash, shared, rank``: most shared features first, then the earliest source.

    Of sources with the same content the best ranked stays, before the limit. A
    target that is in the index itself is a source like others.
    """
    t = targets.where("sketch is not null").select("target_id", F.explode(F.array_distinct("sketch")).alias("feature"))
    met = t.join(index.select("feature", "source_id", "hash"), "feature")
    counts = met.groupBy("target_id", "hash", "source_id").agg(F.count("*").alias("shared"))
    best = counts.groupBy("target_id", "hash").agg(F.max(F.struct("shared", (-F.col("source_id")).alias("minus"))).alias("b"))
    best = best.select("target_id", "hash", F.col("b.shared").alias("shared"), (-F.col("b.minus")).alias("source_id"))
    rank = F.row_number().over(Window.partitionBy("target_id").orderBy(F.desc("shared"), "source_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= limit).select("target_id", "source_id", "hash", "shared", "rank")


def chosen_sources(found: DataFrame, targets: DataFrame, referenced: DataFrame, reserved: DataFrame) -> DataFrame:
    """``target_id, source_id, shared``: the first of each target's candidates that may be its source.

    Skipped within the candidates: the target's own content, and content that
    nothing refers to any more. ``targets (target_id, own)``; a target whose own
    content is ``reserved (hash)`` as a source of others is left out.
    """
    t = targets.join(reserved.select(F.col("hash").alias("own")).distinct(), "own", "left_anti")
    met = found.join(t.select("target_id", "own"), "target_id").where("own <> hash").join(referenced.select("hash").distinct(), "hash", "left_semi")
    best = met.groupBy("target_id").agg(F.min(F.struct("rank", "source_id", "shared")).alias("b"))
    return best.select("target_id", "b.source_id", "b.shared")


def index_stats(sketches: DataFrame, cap: int = CAP) -> DataFrame:
    """Sources, postings, features, the longest list, and features at the cap."""
    p = postings(sketches, cap)
    lists = p.groupBy("feature").agg(F.count("*").alias("n"))
    a = lists.agg(F.count("*").alias("features"), F.sum("n").alias("postings"), F.max("n").alias("longest"), F.sum((F.col("n") == cap).cast("long")).alias("at_cap"))
    return sketches.where("sketch is not null").agg(F.count("*").alias("sources")).crossJoin(a)  # two single rows


def positional_overlap(sketches: DataFrame, cap: int = CAP) -> DataFrame:
    """Pairs of different contents with equal features at equal positions: ``a, b, shared``, the earliest source of each.

    Contents with the same sketch are one class, compared once. A feature at a
    position that more than ``cap`` classes share is no sign of likeness: it
    pairs no classes itself, and counts in the pairs that others make.
    """
    rows = sketches.where("sketch is not null").groupBy("sketch").agg(F.min("source_id").alias("source_id"))
    cells = rows.select("source_id", F.posexplode("sketch").alias("pos", "feature"))
    rare = cells.groupBy("pos", "feature").agg(F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("n") <= cap))
    mine = cells.join(rare.select("pos", "feature"), ["pos", "feature"])
    other = mine.select(F.col("source_id").alias("b"), "pos", "feature")
    pairs = mine.withColumnRenamed("source_id", "a").join(other, ["pos", "feature"]).where("a < b").select("a", "b").distinct()
    side = lambda name, as_name: rows.select(F.col("source_id").alias(name), F.col("sketch").alias(as_name))
    met = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
    same = F.size(F.filter(F.zip_with("x", "y", lambda x, y: x == y), lambda t: t))
    return met.select("a", "b", same.cast("long").alias("shared"))


def same_place_sources(pending: DataFrame, prior: DataFrame, local: DataFrame) -> DataFrame:
    """Single-block pending data and the local content that a prior snapshot has at their address.

    ``pending (entry_id, start_lba, lba_length, kind, hash)``, ``prior (lba, hash)``.
    """
    p = pending.where("kind = 'data' and lba_length = 1")
    met = p.join(prior.select(F.col("lba").alias("start_lba"), F.col("hash").alias("source_hash")), "start_lba").where("hash <> source_hash")
    return met.join(local.select(F.col("hash").alias("source_hash")).distinct(), "source_hash", "left_semi").select("entry_id", "hash", "source_hash")


def cached_reads(reads: DataFrame, budget: int) -> DataFrame:
    """``job, hash, bytes, hit``: reads of sources through a cache of ``budget`` bytes that drops the least recently used.

    ``reads (job, nth, hash, bytes)``. Each job reads in order of ``nth`` with a
    cache of its own, so jobs run side by side. A source above the budget is
    kept alone.
    """

    def played(rows: pd.DataFrame) -> pd.DataFrame:
        held, used, hits = OrderedDict(), 0, []
        rows = rows.sort_values("nth")
        for digest, size in zip(rows["hash"], rows["bytes"], strict=True):
            hits.append(digest in held)
            if hits[-1]:
                held.move_to_end(digest)
                continue
            held[digest] = int(size)
            used += int(size)
            while used > budget and len(held) > 1:
                used -= held.popitem(last=False)[1]
        return rows.assign(hit=hits)[["job", "hash", "bytes", "hit"]]

    nth = F.row_number().over(Window.partitionBy("job").orderBy("nth"))
    return reads.select("job", nth.alias("nth"), "hash", "bytes").groupBy("job").applyInPandas(played, f"job {dict(reads.dtypes)['job']}, hash string, bytes long, hit boolean")


def layout_matches(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changed fragments of files whose fragments have the same places and sizes in both versions.

    ``path, file_offset, byte_count, hash``; a child hash takes its first source in order of path and offset.
    """
    layout = lambda t, name: t.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("file_offset", "byte_count"))).alias(name))
    same = layout(before, "old_layout").join(layout(after, "new_layout"), "path").where(F.col("old_layout") == F.col("new_layout")).select("path")
    old = before.select("path", "file_offset", F.col("hash").alias("source_hash"))
    met = after.join(same, "path", "left_semi").join(old, ["path", "file_offset"]).where("hash <> source_hash")
    first = met.groupBy("hash").agg(F.min(F.struct("path", "file_offset", "source_hash", "byte_count")).alias("m"))
    return first.select("hash", "m.path", "m.file_offset", "m.source_hash", "m.byte_count")


def training_windows(bodies: DataFrame, window: int, budget: int) -> DataFrame:
    """Round-robin samples: the first window of every body, then the second, until ``budget`` bytes: ``body_id, nth, bytes``.

    The budget is a hundred dictionary sizes, so the running sum is over few rows
    of each round; rounds are summed first.
    """
    n = F.ceil(F.col("bytes") / window)
    rows = bodies.where("bytes > 0").select("body_id", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("nth"))
    rows = rows.select("body_id", "nth", F.least(F.lit(window), F.col("bytes") - F.col("nth") * window).alias("bytes"))
    rounds = rows.groupBy("nth").agg(F.sum("bytes").alias("total"))
    ahead = Window.orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    rounds = rounds.withColumn("before", F.coalesce(F.sum("total").over(ahead), F.lit(0))).where(F.col("before") < budget)
    inside = Window.partitionBy("nth").orderBy("body_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(rounds.select("nth", "before"), "nth")
    rows = rows.withColumn("before", F.col("before") + F.coalesce(F.sum("bytes").over(inside), F.lit(0)))
    return rows.where(F.col("before") < budget).select("body_id", "nth", "bytes")
