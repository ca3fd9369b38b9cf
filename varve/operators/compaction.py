"""Liveness, classification and planning of compactions.

An entry's fate follows from the blocks that the current map still resolves to
it. The classification meets by segment, with one aggregate by hash and few
lookups in it; per-segment liveness is one aggregate. Only first-fit packing
is sequential, and it runs for each volume on its own few candidates.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varve.operators import content_index as ci
from varve.operators import intervals as iv
from varve.operators import read_path as rp
from varve.sources.shared import Scratch, keep_together, part_of, stored, stored_parts

#: Bytes and entries of a packed output, share of live bytes below which packing pays, outputs of a pass.
CAP_BYTES, CAP_ENTRIES, SPARSE, MAX_BUCKETS = 32 << 20, 8192, 0.70, 4
#: Entries after which the reaping of data segments stops for a pass.
REAP_CAP = 32_768
#: Ids of a stretch of segments.
STRETCH = 4096
DEAD = ("drop", "drop_and_remove_hash")


def live_hashes(volmap: DataFrame, entries: DataFrame) -> DataFrame:
    """Hashes that the map claims or that any delta names as its source."""
    return volmap.select("hash").union(entries.where("delta_source is not null").select("delta_source")).distinct()


def live_runs(entries: DataFrame, volmap: DataFrame) -> DataFrame:
    """Runs of the map that keep an entry alive: same hash, same anchor, and the entry's segment as claimant.

    They meet by equality on volume, segment and hash; the overlap is tested on
    the few pairs that are left.
    """
    claims = volmap.select("volume_id", F.col("claimant").alias("segment_id"), "hash", F.col("start_lba").alias("r_start"), iv.end().alias("r_end"), "payload_block_offset")
    met = entries.select("volume_id", "segment_id", "entry_idx", "hash", "start_lba", iv.end().alias("l_end")).join(claims, ["volume_id", "segment_id", "hash"])
    low, high = F.greatest("start_lba", "r_start"), F.least("l_end", "r_end")
    anchored = low - F.col("start_lba") == F.col("payload_block_offset") + low - F.col("r_start")
    return met.where((low < high) & anchored).select("segment_id", "entry_idx", low.alias("run_start"), (high - low).alias("run_length"))


def keep_cost() -> Column:
    """Bytes to carry an entry as it is."""
    return F.when(F.col("kind") == "delta", F.col("delta_length")).when(F.col("kind").isin("zero", "dedup_ref"), 0).otherwise(F.col("stored_length"))


def with_runs(entries: DataFrame, volmap: DataFrame) -> DataFrame:
    """Entries with the marks of their hash, the runs of :func:`live_runs` as ``held (run_start, run_length)``, ``live_blocks`` and ``runs``.

    A run comes with the entry that it was cut from; entries of one segment with
    that entry's hash and start share it. Everything meets by segment, once.
    """
    keep_together(entries.sparkSession)
    own = volmap.select(F.col("claimant").alias("segment_id"), "volume_id", "entry_idx", (F.col("start_lba") - F.col("payload_block_offset")).alias("start_lba"), F.struct(F.col("start_lba").alias("a"), iv.end().alias("b")).alias("run"))
    own = own.groupBy("segment_id", "volume_id", "entry_idx", "start_lba").agg(F.collect_list("run").alias("cut"))
    rows = entries.withColumns(dict(zip(("m1", "m2"), iv.marked("hash", "m1", "m2"), strict=True)))
    # canonical entries are none that a run is cut from, but may share one
    rows = rows.withColumn("claims", ~F.col("kind").like("canonical%")).join(own.withColumn("claims", F.lit(True)), ["segment_id", "volume_id", "entry_idx", "start_lba", "claims"], "left")
    alike = Window.partitionBy("segment_id", "volume_id", "m1", "m2", "start_lba")
    rows = rows.withColumn("cut", F.flatten(F.collect_list("cut").over(alike)))
    low, high = lambda r: F.greatest(r["a"], F.col("start_lba")), lambda r: F.least(r["b"], iv.end())
    met = F.transform(F.filter("cut", lambda r: low(r) < high(r)), lambda r: F.struct(low(r).alias("run_start"), (high(r) - low(r)).alias("run_length")))
    rows = rows.withColumn("held", met).drop("cut", "claims")
    blocks = F.aggregate("held", F.lit(0).cast("long"), lambda n, r: n + r["run_length"])
    return rows.withColumns({"live_blocks": blocks, "runs": F.size("held").cast("long")})


def known(entries: DataFrame, segments: DataFrame, volmap: DataFrame, parts: int = 1) -> DataFrame:
    """:func:`content_index.known_hashes` of all entries, stored in parts; ``volmap`` is their map, with or without hashes."""
    told = lambda k: ci.told_hashes(with_runs(part_of(entries, k, parts), part_of(volmap, k, parts)), part_of(segments, k, parts))
    return ci.known_hashes(stored_parts(told, parts, "hashes", ci.least_of))


def classified(entries: DataFrame, segments: DataFrame, volmap: DataFrame, parts: int = 1, then: Callable[[DataFrame], DataFrame] | None = None, known_hashes: DataFrame | None = None) -> DataFrame:
    """Entries with ``class, emit_canonical, live_blocks, runs, held, keep_cost``; ``volmap`` is the map of these entries, with or without hashes.

    What has to be known of a hash is one stored aggregate over the marks of
    hashes. Owners go from it to their segments; only canonical entries, which
    ask whether their hash is live, and deltas, which ask whether their source
    has an owner, are looked up in it.

    Each step is stored in ``parts`` parts of the volumes; a segment and its
    entries are of one volume. With ``then``, which works inside volumes, the
    result is stored in parts too: ``then`` of the classification.
    ``known_hashes`` are those of :func:`known`, where they are at hand.
    """
    hashes = known(entries, segments, volmap, parts) if known_hashes is None else known_hashes

    def asked(k: int) -> DataFrame:
        asks = part_of(entries, k, parts).where("kind in ('canonical_data', 'delta')").withColumn("about", F.when(F.col("kind") == "delta", F.col("delta_source")).otherwise(F.col("hash")))
        asks = asks.select("volume_id", "segment_id", "entry_idx", *iv.marked("about", "m1", "m2"))
        return asks.join(hashes.select("m1", "m2", F.col("is_live").alias("live_asked"), F.col("owner").isNotNull().alias("resolvable")), ["m1", "m2"]).select("volume_id", "segment_id", "entry_idx", "live_asked", "resolvable")

    answers = stored_parts(asked, parts, "asked")
    if then is None:
        return fates(entries, volmap, hashes, answers)
    return stored_parts(lambda k: then(fates(part_of(entries, k, parts), part_of(volmap, k, parts), hashes, part_of(answers, k, parts))), parts, "classes")


def fates(entries: DataFrame, volmap: DataFrame, hashes: DataFrame, told: DataFrame) -> DataFrame:
    """The classification from what is known of ``hashes`` and ``told`` to the entries that ask."""
    rows = with_runs(entries, volmap)
    own = hashes.where("owner is not null or recipe is not null").select(F.coalesce("owner", "recipe").alias("segment_id"), "m1", "m2", F.col("owner").isNull().alias("as_delta"), F.col("is_live").alias("live_own"))
    rows = rows.withColumn("as_delta", F.col("kind") == "delta").join(own, ["segment_id", "m1", "m2", "as_delta"], "left")
    rows = rows.join(told.drop("volume_id"), ["segment_id", "entry_idx"], "left")
    owns, kind, live = F.col("live_own").isNotNull(), F.col("kind"), F.col("live_blocks")
    yes = lambda c: F.coalesce(c, F.lit(False))
    dead = F.when(yes("live_own") & kind.isin("data", "inline", "delta"), "demote_to_canonical").when(owns, "drop_and_remove_hash").otherwise("drop")
    fate = (
        F.when(kind == "zero", "zero_sub_runs")
        .when(kind == "canonical_data", F.when(yes("live_asked"), "fully_live").when(owns, "drop_and_remove_hash").otherwise("drop"))
        .when(live == F.col("lba_length"), "fully_live")
        .when(live == 0, dead)
        .when((kind == "delta") & ~yes("resolvable"), "defer_unresolvable_delta")
        .otherwise("partial_death")
    )
    rows = rows.withColumn("class", fate)
    # a hash that keeps a block alive is live
    canonical = (F.col("class") == "partial_death") & kind.isin("data", "inline", "delta")
    rows = rows.withColumn("emit_canonical", canonical).withColumn("keep_cost", keep_cost())
    return rows.select(*entries.columns, "live_blocks", "runs", "held", "class", "emit_canonical", "keep_cost")


def segment_stats(classes: DataFrame) -> DataFrame:
    """Liveness of each segment: bytes, entries, pool, density and what a rewrite frees."""
    c, cost = F.col("class"), F.col("keep_cost")
    partial = c == "partial_death"
    retained = F.when(c.isin("fully_live", "demote_to_canonical", "defer_unresolvable_delta") | F.col("emit_canonical"), cost).when(partial, F.floor(cost * F.col("live_blocks") / F.col("lba_length"))).otherwise(0)
    moved = F.when(c.isin("fully_live", "demote_to_canonical"), cost).when(partial, F.col("live_blocks") * 4096 + F.when(F.col("emit_canonical"), cost).otherwise(0)).otherwise(0)
    live = F.when(c == "zero_sub_runs", F.col("runs")).when(c.isin(*DEAD), 0).otherwise(1)
    outs = F.when(partial, F.col("runs") + 1).otherwise(live)
    gone = c.isin(*DEAD) | ((c == "zero_sub_runs") & (F.col("runs") == 0))
    t = classes.groupBy("volume_id", "segment_id").agg(
        F.sum(cost).cast("long").alias("total_bytes"),
        F.sum(retained).cast("long").alias("retained_bytes"),
        F.sum(moved).cast("long").alias("materialised_bytes"),
        F.sum(live).cast("long").alias("live_entries"),
        F.sum(outs).cast("long").alias("output_entries"),
        F.sum((c == "drop_and_remove_hash").cast("long")).alias("removed_hashes"),
        (F.bool_or(F.col("kind") == "inline") | (F.sum("stored_length") > 0)).alias("has_body"),
        F.bool_and(F.col("journal") | gone).alias("journal_only"),
    )
    pool = F.when((F.col("live_entries") == 0) & (F.col("removed_hashes") == 0), "tombstone").when(F.col("live_entries") == 0, "stable").when(F.col("journal_only"), "journal").otherwise("stable")
    density = F.when(F.col("total_bytes") > 0, F.col("retained_bytes") / F.col("total_bytes")).otherwise(0.0)
    return t.select(
        "volume_id", "segment_id", "total_bytes", "retained_bytes", "materialised_bytes", "live_entries", "output_entries", "removed_hashes", "has_body",
        pool.alias("pool"), density.alias("density"), F.greatest(F.col("total_bytes") - F.col("retained_bytes"), F.lit(0)).alias("reclaimable_bytes"),
    )


def candidates(stats: DataFrame, sparse: float = SPARSE) -> DataFrame:
    """Stable segments whose rewrite frees bytes, and tombstones."""
    pays = (F.col("pool") == "stable") & (F.col("density") < sparse) & (F.col("reclaimable_bytes") > 0) & F.col("has_body")
    return stats.where(pays | (F.col("pool") == "tombstone"))


def packed(stats: DataFrame, cap_bytes: int = CAP_BYTES, cap_entries: int = CAP_ENTRIES, max_buckets: int = MAX_BUCKETS, sparse: float = SPARSE) -> DataFrame:
    """First-fit-decreasing buckets of each volume: ``volume_id, segment_id, bucket``.

    Sorted by materialised bytes, largest first, then id. What finds no room in
    ``max_buckets`` waits for the next pass; an oversize segment gets a bucket
    of its own. Tombstones ride in the first bucket.
    """

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rooms: list[list[int]] = []
        out = []
        full = rows[rows["pool"] == "stable"].sort_values(["materialised_bytes", "segment_id"], ascending=[False, True])
        for r in full.itertuples():
            at = next((i for i, (b, e) in enumerate(rooms) if r.materialised_bytes <= b and r.output_entries <= e), None)
            if at is None:
                if len(rooms) == max_buckets:
                    continue
                at = len(rooms)
                rooms.append([cap_bytes, cap_entries])
            rooms[at][0] = max(0, rooms[at][0] - r.materialised_bytes)
            rooms[at][1] = max(0, rooms[at][1] - r.output_entries)
            out.append((r.volume_id, r.segment_id, at))
        out += [(r.volume_id, r.segment_id, 0) for r in rows[rows["pool"] == "tombstone"].itertuples()]
        return pd.DataFrame(out, columns=["volume_id", "segment_id", "bucket"])

    slim = candidates(stats, sparse).select("volume_id", "segment_id", "pool", "materialised_bytes", "output_entries")
    return slim.groupBy("volume_id").applyInPandas(pack, "volume_id long, segment_id long, bucket long")


def repack_scan(classes: DataFrame, referenced: DataFrame) -> DataFrame:
    """``volume_id, segment_id, live_bytes, live_entries, all_live, journal`` of each segment.

    Live bytes are those of data and inline entries, in part where an entry is
    dead in part. A segment is all live if every body's hash is referenced,
    wherever the claim is; one journal entry makes it a journal segment.
    ``referenced`` names hashes, or the marks ``m1, m2`` of hashes.
    """
    c = F.col("class")
    data = F.col("kind").isin("data", "inline")
    whole = c.isin("fully_live", "defer_unresolvable_delta", "demote_to_canonical")
    kept = F.when(whole, F.col("stored_length")).when(c == "partial_death", F.floor(F.col("stored_length") * F.col("live_blocks") / F.col("lba_length"))).otherwise(0)
    count = F.when(whole, 1).when(c == "partial_death", F.col("runs") + F.col("emit_canonical").cast("long")).when(c == "zero_sub_runs", F.col("runs")).otherwise(0)
    by = ["hash"] if "hash" in referenced.columns else ["m1", "m2"]
    rows = classes.withColumns(dict(zip(("m1", "m2"), iv.marked("hash", "m1", "m2"), strict=True))).join(referenced.select(*by, F.lit(True).alias("named")), by, "left")
    bodied = F.col("kind").isin("data", "inline", "canonical_data", "canonical_inline")
    return rows.groupBy("volume_id", "segment_id").agg(
        F.sum(F.when(data, kept).otherwise(0)).cast("long").alias("live_bytes"),
        F.sum(count).cast("long").alias("live_entries"),
        F.bool_and(F.when(bodied & (F.col("stored_length") > 0), F.coalesce("named", F.lit(False))).otherwise(True)).alias("all_live"),
        F.bool_or("journal").alias("journal"),
    )


def repacked(scan: DataFrame, cap_bytes: int = CAP_BYTES, cap_entries: int = CAP_ENTRIES) -> DataFrame:
    """``volume_id, segment_id, bucket, action`` for each scanned segment of a volume.

    Data segments go first fit by live bytes, largest first and then by id, into
    as many buckets as they need (``pack``); a bucket of one all-live segment is
    no change (``leave``). All journal segments of a volume merge into one
    output above the others (``journal``, bucket -1), unless a single all-live
    one stands where it is because no data output is made (``leave``).
    """

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rooms: list[list[int]] = []
        held: list[list] = []
        for r in rows[~rows["journal"]].sort_values(["live_bytes", "segment_id"], ascending=[False, True]).itertuples():
            at = next((i for i, (b, e) in enumerate(rooms) if r.live_bytes <= b and r.live_entries <= e), None)
            if at is None:
                at = len(rooms)
                rooms.append([cap_bytes, cap_entries])
                held.append([])
            rooms[at][0] -= r.live_bytes
            rooms[at][1] -= r.live_entries
            held[at].append(r)
        changed = [len(h) > 1 or not h[0].all_live for h in held]
        out = [(r.volume_id, r.segment_id, i, "pack" if c else "leave") for i, (h, c) in enumerate(zip(held, changed, strict=True)) for r in h]
        journal = list(rows[rows["journal"]].itertuples())
        stays = len(journal) == 1 and journal[0].all_live and not any(changed)
        out += [(r.volume_id, r.segment_id, -1, "leave" if stays else "journal") for r in journal]
        return pd.DataFrame(out, columns=["volume_id", "segment_id", "bucket", "action"])

    return scan.groupBy("volume_id").applyInPandas(pack, "volume_id long, segment_id long, bucket long, action string")


def plan_rows(classes: DataFrame, entries_of: DataFrame, volmap: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """Plan records of the chosen segments: keep, canonical, run, zero_split, and drop for a segment without any.

    ``op, segment_id, entry_idx, start_lba, lba_length, payload_block_offset``.
    The runs are those that the classification found; ``volmap`` is not read.
    Columns ``by`` of a segment (its volume) go to its records.
    """
    by = by or []
    chosen = classes.join(entries_of.select("segment_id"), "segment_id", "left_semi")
    none = [F.lit(-1).cast("long").alias(c) for c in ("start_lba", "lba_length", "payload_block_offset")]
    keep = chosen.where(F.col("class").isin("fully_live", "defer_unresolvable_delta")).select(F.lit("keep").alias("op"), *by, "segment_id", "entry_idx", *none)
    canonical = chosen.where((F.col("class") == "demote_to_canonical") | F.col("emit_canonical")).select(F.lit("canonical").alias("op"), *by, "segment_id", "entry_idx", *none)
    split = chosen.where(F.col("class").isin("partial_death", "zero_sub_runs"))
    runs = split.select(*by, "segment_id", "entry_idx", "class", F.col("start_lba").alias("own_start"), F.inline("held"))
    op = F.when(F.col("class") == "zero_sub_runs", "zero_split").otherwise("run")
    runs = runs.select(op.alias("op"), *by, "segment_id", "entry_idx", F.col("run_start").alias("start_lba"), F.col("run_length").alias("lba_length"), (F.col("run_start") - F.col("own_start")).alias("payload_block_offset"))
    some = iv.union_all(keep, canonical, runs)
    dead = chosen.select(*by, "segment_id").distinct().join(some.select("segment_id"), "segment_id", "left_anti")
    return some.unionByName(dead.select(F.lit("drop").alias("op"), *by, "segment_id", F.lit(-1).cast("long").alias("entry_idx"), *none))


def planned(entries: DataFrame, segments: DataFrame, volmap: DataFrame, parts: int = 1, known_hashes: DataFrame | None = None) -> DataFrame:
    """The plan of a pass, with ``volume_id``, stored in parts of the volumes; the classification of one part is stored at a time, without its hashes."""
    scratch = Scratch(entries.sparkSession, "classes")

    def plan(classes: DataFrame) -> DataFrame:
        found = scratch.store(classes.drop("hash", "delta_source", "delta_length", "present"))
        return plan_rows(found, candidates(segment_stats(found)), by=["volume_id"])

    whole = classified(entries, segments, volmap, parts, plan, known_hashes)
    scratch.clear()
    return whole


def unreachable(entries: DataFrame, segments: DataFrame, volmap: DataFrame, floor: int, parts: int = 1) -> DataFrame:
    """Segments above the floor that hold no claim and own no live hash: ``segment_id, entries, journal``.

    Stored in parts of the volumes; ``volmap`` is the map of these entries, with or without hashes.
    """
    hashes = known(entries, segments, volmap, parts)
    owned = hashes.where("is_live").select(F.coalesce("owner", "recipe").alias("segment_id")).distinct()

    def rest(k: int) -> DataFrame:
        rows = part_of(entries, k, parts).where(F.col("segment_id") > floor).groupBy("segment_id").agg(F.sum((F.col("kind") != "dedup_ref").cast("long")).alias("entries"), F.bool_and("journal").alias("journal"))
        rows = rows.join(part_of(volmap, k, parts).select(F.col("claimant").alias("segment_id")).distinct(), "segment_id", "left_anti")
        return rows.join(owned, "segment_id", "left_anti")

    return stored_parts(rest, parts, "unreachable")


def above_floor(segments: DataFrame, floors: DataFrame) -> DataFrame:
    """Segments above their volume's floor, its latest snapshot; a volume without one has none below it."""
    met = segments.join(floors.select("volume_id", "floor"), "volume_id", "left")
    return met.where(F.col("floor").isNull() | (F.col("segment_id") > F.col("floor")))


def capped(reapable: DataFrame, cap: int = REAP_CAP) -> DataFrame:
    """Segments admitted in id order while the total before them is under the cap; journal segments always.

    Sums by stretch of ids come first, so that no window runs over all segments.
    """
    counted = F.when(F.col("journal"), 0).otherwise(F.col("entries"))
    rows = rp.placed(reapable.withColumn("counted", counted), F.floor(F.col("segment_id") / STRETCH), ["segment_id"], "counted")
    return rows.withColumnRenamed("body_offset", "ahead").drop("counted").withColumn("admitted", F.col("journal") | (F.col("ahead") < cap))


def bloated(volmap: DataFrame, owners: DataFrame, min_dead: int, min_ratio: float, min_bytes: int) -> DataFrame:
    """Bodies most of whose blocks the map no longer reaches, worst first.

    The body is at least as long as the furthest block that a claim reaches.
    """
    t = volmap.groupBy("hash").agg(F.min("start_lba").alias("first_lba"), F.max(F.col("start_lba") + F.col("lba_length")).alias("end_lba"), F.sum("lba_length").alias("live_blocks"), F.max(F.col("payload_block_offset") + F.col("lba_length")).alias("logical_blocks"))
    t = t.join(owners.where("kind <> 'inline'").select("hash", "stored_length"), "hash")
    dead = F.greatest(F.col("logical_blocks") - F.col("live_blocks"), F.lit(0))
    t = t.withColumn("dead_blocks", dead).withColumn("dead_ratio", F.col("dead_blocks") / F.col("logical_blocks"))
    return t.where((F.col("dead_blocks") >= min_dead) & (F.col("dead_ratio") >= min_ratio) & (F.col("stored_length") >= min_bytes))


def reached(entries: DataFrame, volmap: DataFrame, parts: int = 1) -> DataFrame:
    """``m1, m2, live_blocks, logical_blocks`` of each hash that the map claims, by its marks: blocks claimed, and the furthest one.

    Stored in parts of the volumes; ``volmap`` is the map of these entries, with or without hashes.
    """
    keep_together(entries.sparkSession)
    furthest = F.col("payload_block_offset") + F.col("lba_length")

    def part(k: int) -> DataFrame:
        record = ["segment_id", "volume_id", "entry_idx", "anchor"]
        runs = part_of(volmap, k, parts).select(F.col("claimant").alias("segment_id"), "volume_id", "entry_idx", (F.col("start_lba") - F.col("payload_block_offset")).alias("anchor"), "lba_length", "payload_block_offset")
        whose = part_of(entries, k, parts).where("kind not like 'canonical%'").select("segment_id", "volume_id", "entry_idx", F.col("start_lba").alias("anchor"), *iv.marked("hash", "m1", "m2"))
        return runs.join(whose, record).groupBy("m1", "m2").agg(F.sum("lba_length").alias("live_blocks"), F.max(furthest).alias("logical_blocks"))

    return stored_parts(part, parts, "reached", lambda t: t.groupBy("m1", "m2").agg(F.sum("live_blocks").alias("live_blocks"), F.max("logical_blocks").alias("logical_blocks")))


def bloated_elsewhere(entries: DataFrame, reach: DataFrame, hashes: DataFrame, chosen: DataFrame, min_dead: int = 1) -> DataFrame:
    """``hash, dead_blocks``: what :func:`bloated` finds among bodies of segments that are not ``chosen (segment_id)``.

    ``reach`` and ``hashes`` are those of :func:`reached` and :func:`known`. Bloat is
    found by marks, and only what is left asks its owner's segment for the hash.
    """
    dead = F.greatest(F.col("logical_blocks") - F.col("live_blocks"), F.lit(0))
    found = reach.select("m1", "m2", dead.alias("dead_blocks")).where(F.col("dead_blocks") >= min_dead)
    found = found.join(hashes.where("owner is not null").select("m1", "m2", F.col("owner").alias("segment_id")), ["m1", "m2"])
    found = stored(found.join(chosen.select("segment_id"), "segment_id", "left_anti"), "bloated")
    bodies = entries.where(F.col("kind").isin(*ci.BODIES) & ~F.col("journal")).select("segment_id", "entry_idx", "kind", "hash")
    # the segments of what is left are few, so their bodies' hashes move and no others
    bodies = bodies.join(found.select("segment_id").distinct(), "segment_id", "left_semi")
    bodies = bodies.withColumns(dict(zip(("m1", "m2"), iv.marked("hash", "m1", "m2"), strict=True)))
    owners = bodies.join(found, ["segment_id", "m1", "m2"]).groupBy("m1", "m2").agg(F.min(F.struct("entry_idx", "kind", "hash", "dead_blocks")).alias("o"))
    return owners.where("o.kind <> 'inline'").select("o.hash", "o.dead_blocks")


def reclaim_ranges(volmap: DataFrame, ranges: DataFrame) -> DataFrame:
    """Hashes all of whose runs lie inside one of the ranges, with what a rewrite of them carries."""
    right = ranges.select(F.col("start_lba").alias("r_start"), F.col("end_lba").alias("stop"))
    met = iv.overlapping(volmap, right, iv.end(), F.col("stop"))
    inside = met.withColumn("whole", (F.col("r_start") <= F.col("start_lba")) & (F.col("l_end") <= F.col("r_end"))).groupBy("volume_id", "claimant", "entry_idx", "start_lba", "hash", "lba_length").agg(F.bool_or("whole").alias("whole"))
    marked = volmap.join(inside.select("volume_id", "start_lba", "whole"), ["volume_id", "start_lba"], "left").fillna(False, ["whole"])
    return marked.groupBy("hash").agg(F.bool_and("whole").alias("all_inside"), F.count("*").alias("runs"), F.sum("lba_length").alias("blocks")).where("all_inside").drop("all_inside")


def reaped_head(head: DataFrame, reaped: DataFrame) -> DataFrame:
    """``volume_id, section, segment_id``: a head after a reap, whose segments move to the tombstoned ones."""
    rows = head.join(reaped.select("segment_id", F.lit(True).alias("gone")), "segment_id", "left")
    return rows.select("volume_id", F.when(F.col("gone"), "tombstoned").otherwise(F.col("section")).alias("section"), "segment_id")


def live_set(manifest: DataFrame, added: DataFrame, superseded: DataFrame, tombstoned: DataFrame) -> DataFrame:
    """``manifest + added - superseded - tombstoned``, each a column ``segment_id``."""
    return manifest.union(added).distinct().join(superseded, "segment_id", "left_anti").join(tombstoned, "segment_id", "left_anti")


def discovered(segments: DataFrame, cutoff: int) -> DataFrame:
    """A fork's segments up to its branch point, in rebuild order: committed tiers, then pending ones.

    Index rows that a compaction output consumed are gone.
    """
    upto = segments.where(F.col("segment_id") <= cutoff)
    consumed = superseded_inputs(upto)
    rows = upto.join(consumed.withColumn("tier", F.lit("index")), ["segment_id", "tier"], "left_anti")
    place = Window.partitionBy("volume_id").orderBy(ci.tier_rank(), "segment_id")
    return rows.select("volume_id", "segment_id", "tier", F.row_number().over(place).alias("place"))


def superseded_inputs(segments: DataFrame) -> DataFrame:
    return segments.where("tier = 'gc'").select(F.explode("inputs").alias("segment_id")).distinct()


def confirmed_edges(segments: DataFrame, anchor: int) -> DataFrame:
    """Inputs of the outputs above the anchor: ``input, output, since``; of several outputs the last."""
    rows = segments.where((F.col("segment_id") > anchor) & (F.col("tier") == "gc")).select(F.explode("inputs").alias("input"), F.col("segment_id").alias("output"), "created")
    return rows.groupBy("input").agg(F.max(F.struct("output", "created")).alias("e")).select("input", "e.output", F.col("e.created").alias("since"))


def expired(edges: DataFrame, now: Column, days: int, local: DataFrame) -> DataFrame:
    """Edges whose retention is over and whose input is not local any more."""
    due = edges.where(F.col("since") + F.expr(f"interval {days} days") <= now)
    return due.join(local.select(F.col("segment_id").alias("input")), "input", "left_anti")
