"""Interval maps over block addresses: overlay, admission rules, lookups, range algebra.

A record claims ``[start_lba, start_lba + lba_length)`` for a content hash. The
operators expand claims to blocks, settle each block with one aggregate (which
combines on the map side), and fold the winners back to runs for each source
record. All keys are block addresses or volumes, so work spreads with the
address space; nothing is collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varve.sources.shared import keep_together, part_of, stored_parts

#: Width of the address buckets that range joins meet in.
BUCKET = 64


def end() -> Column:
    return F.col("start_lba") + F.col("lba_length")


def blocks(records: DataFrame) -> DataFrame:
    """One row for each block of each record, under ``lba``."""
    return records.where("lba_length > 0").withColumn("lba", F.explode(F.sequence(F.col("start_lba"), end() - 1)))


def runs(settled: DataFrame, keys: list[str], anchor: str = "start_lba", by: list[str] | None = None) -> DataFrame:
    """Maximal runs of neighbouring blocks of one source record.

    ``settled`` has one row for each block: ``lba``, the record's own start
    under ``anchor``, and ``keys`` that name the record and go to the result;
    runs stay within ``by`` (a volume). A run never joins two records, even of
    equal hash.
    """
    by = by or []
    record = Window.partitionBy(*by, *keys).orderBy("lba")
    islands = settled.withColumn("island", F.col("lba") - F.row_number().over(record))
    found = islands.groupBy(*by, *keys, "island").agg(F.min("lba").alias("at"), F.count("*").alias("n"), F.min(anchor).alias("anchor"))
    return found.select(*by, F.col("at").alias("start_lba"), F.col("n").alias("lba_length"), (F.col("at") - F.col("anchor")).alias("payload_block_offset"), *keys)


def settled(records: DataFrame, order: list[Column], columns: list[str], by: list[str] | None = None) -> DataFrame:
    """The record that holds each block: the greatest in ``order``."""
    by = by or []
    named = [c.alias(f"o{i}") for i, c in enumerate(order)]
    best = blocks(records).groupBy(*by, "lba").agg(F.max(F.struct(*named, "start_lba", *columns)).alias("top"))
    return best.select(*by, "lba", F.col("top.start_lba").alias("start_lba"), *(F.col(f"top.{c}").alias(c) for c in columns))


def overlay(records: DataFrame, claimant: str = "wal_id", seq: str = "seq") -> DataFrame:
    """Last write wins: ``start_lba, lba_length, payload_block_offset, hash, claimant, seq``."""
    named = records.select("start_lba", "lba_length", "hash", F.col(claimant).alias("claimant"), F.col(seq).alias("seq"))
    return runs(settled(named, [F.col("claimant"), F.col("seq")], ["hash", "claimant", "seq"]), ["hash", "claimant", "seq"])


def overlay_if_newer(records: DataFrame, claimant: str = "wal_id", seq: str = "seq") -> DataFrame:
    """The map after inserting in ``seq`` order where nothing of the same or a higher claimant is: highest claimant, first record."""
    named = records.select("start_lba", "lba_length", "hash", F.col(claimant).alias("claimant"), F.col(seq).alias("seq"))
    return runs(settled(named, [F.col("claimant"), -F.col("seq")], ["hash", "claimant", "seq"]), ["hash", "claimant", "seq"])


def installed_if_newer(records: DataFrame, arrival: str, claimant: str, seq: str) -> DataFrame:
    """``seq, installed``: the blocks each record takes when records arrive in ``arrival`` order."""
    named = records.select("start_lba", "lba_length", F.col(arrival).alias("arrival"), F.col(claimant).alias("claimant"), F.col(seq).alias("seq"))
    before = Window.partitionBy("lba").orderBy("arrival", "seq").rowsBetween(Window.unboundedPreceding, -1)
    found = blocks(named).withColumn("held", F.max("claimant").over(before))
    taken = F.col("held").isNull() | (F.col("held") < F.col("claimant"))
    return found.groupBy("seq").agg(F.sum(taken.cast("long")).alias("installed"))


def insert_consuming(base: DataFrame, outputs: DataFrame, horizon: bool = False) -> DataFrame:
    """One output's claims laid over a map: taken where the holder is an input, the output itself, or the same hash at a lower id.

    With ``horizon`` a holder is overridden if it is not above the greatest
    input, whether or not it is one itself.

    ``base (lba, start_lba, hash, claimant)`` by block; ``outputs`` records with
    ``hash, claimant, inputs``, at most one for each block. Result by block, with
    ``taken``: whether the output holds it.
    """
    new = blocks(outputs).select("lba", F.col("start_lba").alias("new_start"), F.col("hash").alias("new_hash"), F.col("claimant").alias("new_claimant"), "inputs")
    met = base.join(new, "lba", "full")
    seen = F.col("claimant") <= F.array_max("inputs") if horizon else F.array_contains("inputs", F.col("claimant"))
    free = F.col("claimant").isNull() | seen | (F.col("claimant") == F.col("new_claimant"))
    free = free | ((F.col("hash") == F.col("new_hash")) & (F.col("claimant") < F.col("new_claimant")))
    taken = F.col("new_claimant").isNotNull() & F.coalesce(free, F.lit(False))
    pick = lambda new, old: F.when(F.col("taken"), F.col(new)).otherwise(F.col(old))
    met = met.withColumn("taken", taken)
    return met.select("lba", pick("new_start", "start_lba").alias("start_lba"), pick("new_hash", "hash").alias("hash"), pick("new_claimant", "claimant").alias("claimant"), "taken")


def marked(column: str, a: str, b: str) -> list[Column]:
    """128 bits of a hash as two columns, by which hashes are told apart where whole ones would be too long to move."""
    return [F.xxhash64(column).alias(a), F.xxhash64(F.lit("varve"), column).alias(b)]


def held_pieces(entries: DataFrame, segments: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """``volume_id, segment_id, entry_idx, anchor, at, n``: the runs of :func:`rebuild`, cut at the edges of address buckets.

    Claims, not blocks, go to the bucket of their addresses and are spread to
    blocks there. A block's state is the place of its entry and the marks of
    its hash; the hash itself stays with the entries. The records of a ``log``
    with the same columns hold their blocks over all segments, the greatest
    last, and their pieces are marked ``above``.
    """
    claims = entries.where("kind not like 'canonical%' and lba_length > 0").select("volume_id", "segment_id", "entry_idx", "start_lba", "lba_length", *marked("hash", "m1", "m2"))
    claims = claims.join(segments.select("segment_id", F.when(F.size("inputs") > 0, F.array_max("inputs")).alias("horizon")), "segment_id")
    if log is not None:
        over = log.where("lba_length > 0").select("volume_id", "segment_id", "entry_idx", "start_lba", "lba_length", *marked("hash", "m1", "m2"))
        claims = claims.withColumn("above", F.lit(False)).unionByName(over.withColumn("above", F.lit(True)), allowMissingColumns=True)
    else:
        claims = claims.withColumn("above", F.lit(False))
    claims = claims.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start_lba") / BUCKET), F.floor((end() - 1) / BUCKET)))).repartition("volume_id", "bucket")
    low, high = F.greatest("start_lba", F.col("bucket") * BUCKET), F.least(end(), (F.col("bucket") + 1) * BUCKET)
    claims = claims.withColumn("lba", F.explode(F.sequence(low, high - 1)))
    names = {"c": "segment_id", "i": "entry_idx", "m1": "m1", "m2": "m2", "s": "start_lba"}
    state = F.struct(*(F.col(c).alias(k) for k, c in names.items()))
    output = F.struct(*(F.col(c).alias(k) for k, c in names.items()), F.col("horizon").alias("z"))
    found = claims.groupBy("volume_id", "bucket", "lba").agg(
        F.max(F.when(F.col("above"), state)).alias("top"),
        F.max(F.when(F.col("horizon").isNull() & ~F.col("above"), state)).alias("base"),
        F.array_sort(F.collect_list(F.when(F.col("horizon").isNotNull(), output))).alias("outs"),
    )

    def admit(held: Column, new: Column) -> Column:
        same = (held["m1"] == new["m1"]) & (held["m2"] == new["m2"])
        free = held.isNull() | (held["c"] <= new["z"]) | (held["c"] == new["c"]) | (same & (held["c"] < new["c"]))
        return F.when(free, F.struct(*(new[k].alias(k) for k in names))).otherwise(held)

    top = F.col("top").isNotNull()
    won = found.select("volume_id", "bucket", "lba", top.alias("above"), F.when(top, F.col("top")).otherwise(F.aggregate("outs", F.col("base"), admit)).alias("w"))
    won = won.select("volume_id", "bucket", "lba", "above", F.col("w.c").alias("segment_id"), F.col("w.i").alias("entry_idx"), F.col("w.s").alias("anchor"))
    inside = Window.partitionBy("volume_id", "bucket", "above", "segment_id", "entry_idx").orderBy("lba")
    islands = won.withColumn("island", F.col("lba") - F.row_number().over(inside))
    pieces = islands.groupBy("volume_id", "bucket", "above", "segment_id", "entry_idx", "island").agg(F.min("anchor").alias("anchor"), F.min("lba").alias("at"), F.count("*").alias("n"))
    return pieces.select("volume_id", "segment_id", "entry_idx", "anchor", "at", "n", *(["above"] if log is not None else []))


def stored_pieces(entries: DataFrame, segments: DataFrame, parts: int = 1) -> DataFrame:
    """:func:`held_pieces`, stored in ``parts`` parts of the volumes; a segment and its entries are of one volume."""
    return stored_parts(lambda k: held_pieces(part_of(entries, k, parts), part_of(segments, k, parts)), parts, "map")


def rebuilt(entries: DataFrame, segments: DataFrame, parts: int = 1) -> DataFrame:
    """:func:`rebuild` without hashes, by segment: the pieces are stored once, and join across the edges of buckets."""
    return joined(stored_pieces(entries, segments, parts))


def joined(pieces: DataFrame) -> DataFrame:
    """The runs of :func:`held_pieces` without the cuts at the edges of buckets, by segment."""
    pieces = pieces.repartition("segment_id")
    record = Window.partitionBy("volume_id", "segment_id", "entry_idx", "anchor").orderBy("at")
    fresh = F.coalesce((F.lag(F.col("at") + F.col("n")).over(record) != F.col("at")).cast("int"), F.lit(1))
    islands = pieces.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(record))
    whole = islands.groupBy("volume_id", "segment_id", "entry_idx", "anchor", "island").agg(F.min("at").alias("at"), F.sum("n").alias("n"))
    return whole.select("volume_id", F.col("at").alias("start_lba"), F.col("n").alias("lba_length"), (F.col("at") - F.col("anchor")).alias("payload_block_offset"), F.col("segment_id").alias("claimant"), "entry_idx")


def rebuild(entries: DataFrame, segments: DataFrame, parts: int = 1) -> DataFrame:
    """The current map of each volume from its segments, in two phases.

    First entries of segments without inputs: the highest segment id holds a
    block, and of one segment the last entry. Then outputs of compactions in id
    order: each takes a block whose holder is not above the greatest input
    (the horizon of what its pass saw), is itself, or has its hash at a lower
    id. The fold is exact for each block; only outputs that claim the block are
    gathered for it. Canonical entries claim nothing.
    """
    keep_together(entries.sparkSession)
    whole = rebuilt(entries, segments, parts).withColumn("anchor", F.col("start_lba") - F.col("payload_block_offset"))
    named = entries.where("kind not like 'canonical%'").select(F.col("segment_id").alias("claimant"), "volume_id", "entry_idx", F.col("start_lba").alias("anchor"), "hash")
    found = whole.join(named, ["claimant", "volume_id", "entry_idx", "anchor"])
    return found.select("volume_id", "start_lba", "lba_length", "payload_block_offset", "hash", "claimant", "entry_idx")


def overlapping(left: DataFrame, right: DataFrame, left_end: Column, right_end: Column, on: list[str] | None = None, how: str = "inner") -> DataFrame:
    """Range join of ``left [start_lba, left_end)`` with ``right [r_start, right_end)``.

    Both sides meet in buckets of ``BUCKET`` blocks by equality, each pair in
    the first bucket that they share, so there is no nested loop.
    """
    on = on or []
    spread = lambda start, stop: F.explode(F.sequence(F.floor(start / BUCKET), F.floor((stop - 1) / BUCKET)))
    a = left.withColumn("l_end", left_end).where("l_end > start_lba").withColumn("bucket", spread(F.col("start_lba"), F.col("l_end")))
    b = right.withColumn("r_end", right_end).where("r_end > r_start").withColumn("bucket", spread(F.col("r_start"), F.col("r_end")))
    first = F.floor(F.greatest("start_lba", "r_start") / BUCKET) == F.col("bucket")
    met = a.join(b, [*on, "bucket"]).where((F.col("start_lba") < F.col("r_end")) & (F.col("r_start") < F.col("l_end")) & first)
    return met.drop("bucket")


def as_right(table: DataFrame) -> DataFrame:
    return table.withColumnRenamed("start_lba", "r_start").withColumnRenamed("lba_length", "r_length")


def extents_in_range(lbamap: DataFrame, requests: DataFrame) -> DataFrame:
    """Clipped runs for each probe ``[start_lba, end_lba)``; gaps yield nothing."""
    met = overlapping(requests, as_right(lbamap), F.col("end_lba"), F.col("r_start") + F.col("r_length"))
    low, high = F.greatest("start_lba", "r_start"), F.least("l_end", "r_end")
    return met.select("request_id", low.alias("range_start"), high.alias("range_end"), "hash", (F.col("payload_block_offset") + low - F.col("r_start")).alias("payload_block_offset"), "claimant")


def lookup(lbamap: DataFrame, points: DataFrame) -> DataFrame:
    """The run that holds each point ``(request_id, lba)``, or nulls for an unwritten one."""
    probes = points.select("request_id", F.col("lba").alias("start_lba"))
    hit = overlapping(probes, as_right(lbamap), F.col("start_lba") + 1, F.col("r_start") + F.col("r_length"))
    hit = hit.select("request_id", "hash", "claimant", (F.col("payload_block_offset") + F.col("start_lba") - F.col("r_start")).alias("block_offset"))
    return points.join(hit, "request_id", "left").select("request_id", "lba", "hash", "claimant", "block_offset")


def full_matches(lbamap: DataFrame, probes: DataFrame) -> DataFrame:
    """Probes ``(start_lba, lba_length, hash)`` that are a whole run of the map at offset 0."""
    return probes.join(lbamap.where("payload_block_offset = 0").select("start_lba", "lba_length", "hash"), ["start_lba", "lba_length", "hash"], "left_semi")


def claim_refcounts(lbamap: DataFrame) -> DataFrame:
    """Runs, not blocks, that claim each hash."""
    return lbamap.groupBy("hash").agg(F.count("*").alias("claims"), F.sum("lba_length").alias("blocks"))


def promote_claimants(lbamap: DataFrame, updates: DataFrame, consuming: bool = False) -> DataFrame:
    """Runs with the claimant raised where an update ``(start_lba, lba_length, hash, new_claimant[, input])`` overlaps with the same hash.

    Of several updates the highest wins. An update raises a lower claimant, and
    with ``consuming`` also one that is the input it consumes.
    """
    right = as_right(updates.withColumnRenamed("hash", "r_hash"))
    met = overlapping(lbamap.withColumn("run", F.struct("start_lba", "seq")), right, end(), F.col("r_start") + F.col("r_length"))
    may = F.col("claimant") < F.col("new_claimant")
    if consuming:
        may = may | (F.col("claimant") == F.col("input"))
    best = met.where((F.col("hash") == F.col("r_hash")) & may).groupBy("run").agg(F.max("new_claimant").alias("raised"))
    best = best.select(F.col("run.start_lba").alias("start_lba"), F.col("run.seq").alias("seq"), "raised")
    out = lbamap.join(best, ["start_lba", "seq"], "left")
    return out.select("start_lba", "lba_length", "hash", "seq", F.coalesce("raised", "claimant").alias("claimant"), F.col("raised").isNotNull().alias("promoted"))


def normalise_ranges(ranges: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sorted disjoint ``[start_lba, end_lba)``: empties dropped, overlapping and adjacent ranges joined.

    The running maximum is a window for each group ``by`` (a volume); without
    one the ranges are a small relation, the windows of one journal.
    """
    by = by or []
    full = ranges.where("lba_length > 0").select(*by, "start_lba", end().alias("end_lba"))
    order = Window.partitionBy(*by).orderBy("start_lba", "end_lba")
    reach = F.max("end_lba").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = full.withColumn("fresh", F.coalesce((F.col("start_lba") > reach).cast("int"), F.lit(1)))
    marked = marked.withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*by, "island").agg(F.min("start_lba").alias("start_lba"), F.max("end_lba").alias("end_lba")).drop("island")


def contained(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """``points (request_id, lba)`` with ``inside``: whether a range holds the point."""
    right = ranges.select(F.col("start_lba").alias("r_start"), F.col("end_lba").alias("stop"))
    hit = overlapping(points.select("request_id", F.col("lba").alias("start_lba")), right, F.col("start_lba") + 1, F.col("stop"))
    hit = hit.select("request_id").distinct().withColumn("inside", F.lit(True))
    return points.join(hit, "request_id", "left").select("request_id", "lba", F.coalesce("inside", F.lit(False)).alias("inside"))


def boundary_crossers(extents: DataFrame, ranges: DataFrame) -> DataFrame:
    """Extents that have a range's edge strictly inside."""
    edges = ranges.select(F.explode(F.array("start_lba", "end_lba")).alias("r_start")).distinct()
    met = overlapping(extents, edges, end(), F.col("r_start") + 1).where("r_start > start_lba")
    return extents.join(met.select("seq").distinct(), "seq", "left_semi")


def split_at_boundaries(extents: DataFrame, ranges: DataFrame) -> DataFrame:
    """Pieces of each extent (``seq``) that lie wholly in or wholly out of the ranges."""
    edges = ranges.select(F.explode(F.array("start_lba", "end_lba")).alias("r_start")).distinct()
    cuts = overlapping(extents, edges, end(), F.col("r_start") + 1).where("r_start > start_lba").groupBy("seq").agg(F.array_sort(F.collect_set("r_start")).alias("cuts"))
    points = F.concat(F.array("start_lba"), F.coalesce("cuts", F.array().cast("array<bigint>")), F.array(end()))
    pieces = extents.join(cuts, "seq", "left").select("seq", points.alias("points"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("points") - 1), lambda i: F.struct(F.element_at("points", i).alias("a"), F.element_at("points", i + 1).alias("b")))
    pieces = pieces.select("seq", F.explode(pairs).alias("p"))
    return pieces.select("seq", F.col("p.a").alias("start_lba"), (F.col("p.b") - F.col("p.a")).alias("lba_length"))


def partition_span(spans: DataFrame, cuts: DataFrame) -> DataFrame:
    """Parts of each span inside and outside disjoint sorted cuts ``[start_lba, end_lba)``: ``seq, start_lba, end_lba, inside``."""
    right = cuts.select(F.col("start_lba").alias("r_start"), F.col("end_lba").alias("stop"))
    met = overlapping(spans, right, end(), F.col("stop"))
    inside = met.select("seq", F.greatest("start_lba", "r_start").alias("a"), F.least("l_end", "r_end").alias("b"))
    by_span = Window.partitionBy("seq").orderBy("a")
    marks = inside.unionByName(spans.select("seq", end().alias("a"), end().alias("b")))
    gaps = marks.join(spans.select("seq", F.col("start_lba").alias("s0")), "seq").withColumn("from", F.coalesce(F.lag("b").over(by_span), "s0"))
    outside = gaps.where(F.col("from") < F.col("a")).select("seq", F.col("from").alias("a"), F.col("a").alias("b"))
    both = inside.withColumn("inside", F.lit(True)).unionByName(outside.withColumn("inside", F.lit(False)))
    return both.select("seq", F.col("a").alias("start_lba"), F.col("b").alias("end_lba"), "inside")


def coverage(extents: DataFrame) -> DataFrame:
    """Blocks that any extent covers, in words of 64 addresses: ``word, covered``."""
    covered = blocks(extents).select("lba").distinct()
    return covered.groupBy(F.floor(F.col("lba") / 64).alias("word")).agg(F.count("*").alias("covered"))


def changed_runs(before: DataFrame, after: DataFrame) -> DataFrame:
    """Maximal runs of blocks ``(lba, hash)`` that differ between two images, absent blocks included."""
    met = before.select("lba", F.col("hash").alias("old")).join(after.select("lba", F.col("hash").alias("new")), "lba", "full")
    changed = met.where(~F.col("old").eqNullSafe(F.col("new"))).select("lba", F.floor(F.col("lba") / (1 << 20)).alias("stretch"))
    # islands by stretch of the address space, then joined across stretches' edges
    inside = changed.withColumn("island", F.col("lba") - F.row_number().over(Window.partitionBy("stretch").orderBy("lba")))
    parts = inside.groupBy("stretch", "island").agg(F.min("lba").alias("start_lba"), F.count("*").alias("lba_length"))
    edge = ((F.col("start_lba") % (1 << 20) == 0) & (F.col("start_lba") > 0)) | ((F.col("start_lba") + F.col("lba_length")) % (1 << 20) == 0)
    whole, open_ = parts.where(~edge), parts.where(edge)
    joined = normalise_ranges(open_).select("start_lba", (F.col("end_lba") - F.col("start_lba")).alias("lba_length"))
    return whole.select("start_lba", "lba_length").unionByName(joined)


def snapshot_source_map(lbamap: DataFrame, ranges: DataFrame, zero_hash: str) -> DataFrame:
    """``lba, hash`` of the map's blocks, without zero runs and runs that start in the ranges."""
    starts = lbamap.where(F.col("hash") != zero_hash).withColumn("request_id", F.monotonically_increasing_id())
    points = starts.select(F.col("start_lba").alias("request_id"), F.col("start_lba").alias("lba"))
    out = contained(points, ranges).where("not inside").select(F.col("lba").alias("start_lba"))
    return blocks(lbamap.where(F.col("hash") != zero_hash).join(out, "start_lba", "left_semi")).select("lba", "hash")


def fingerprint(lbamap: DataFrame) -> DataFrame:
    """One hash of the whole map: the hash of stretch hashes, each over its runs in address order."""
    part = lbamap.select(F.floor(F.col("start_lba") / 1024).alias("stretch"), F.struct("start_lba", "hash").alias("r"))
    text = lambda rows, f: F.concat_ws(",", F.transform(F.array_sort(rows), f))
    part = part.groupBy("stretch").agg(F.sha2(text(F.collect_list("r"), lambda r: r["hash"]), 256).alias("h"))
    whole = part.agg(F.sha2(text(F.collect_list(F.struct("stretch", "h")), lambda r: r["h"]), 256).alias("snapshot_id"))
    return whole


def union_all(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)
