"""Registered queries of liveness, classification and compaction planning, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from varve.operators import compaction as gc
from varve.operators import content_index as ci
from varve.operators import intervals as iv
from varve.plans import fixtures as fx
from varve.plans.fixtures import prelude

FLOOR = 2000
NOW = "TIMESTAMP '1996-01-01 00:00:00'"


def volmap(s, d):
    return iv.rebuild(fx.entries(s, d), fx.segments(s, d), fx.parts(s, d))


def classes(s, d, then=None):
    e, g, parts = fx.entries(s, d), fx.segments(s, d), fx.parts(s, d)
    return gc.classified(e, g, iv.rebuilt(e, g, parts), parts, then)


def unreachable(s, d):
    e, g, parts = fx.entries(s, d), fx.segments(s, d), fx.parts(s, d)
    return gc.unreachable(e, g, iv.rebuilt(e, g, parts), FLOOR, parts)


def stats(s, d):
    return classes(s, d, gc.segment_stats)


def body_bytes(classes):
    """Bytes of each segment's bodies, and of those that are not dead."""
    return classes.groupBy("segment_id").agg(F.sum("stored_length").alias("stored"), F.sum(F.when(~F.col("class").isin(*gc.DEAD), F.col("stored_length")).otherwise(0)).alias("live"))


def head(s, d):
    """Every segment in its section of its volume's head."""
    section = F.when(F.col("segment_id") % 50 == 7, "tombstoned").when(F.col("tier") == "gc", "superseded").otherwise("added")
    return fx.segments(s, d).select("volume_id", section.alias("section"), "segment_id")


def plan(s, d):
    """The plan records of a pass; the classification is used several times and stored once, without its hashes."""
    found = classes(s, d, lambda c: c.drop("hash", "delta_source", "delta_length", "present"))
    return gc.plan_rows(found, gc.candidates(gc.segment_stats(found)))


STATS = "volume_id, segment_id, total_bytes, retained_bytes, materialised_bytes, live_entries, output_entries, removed_hashes, has_body, pool, density, reclaimable_bytes"
PAYS = "((pool = 'stable' AND density < 0.7 AND reclaimable_bytes > 0 AND has_body) OR pool = 'tombstone')"
REAP = (
    f""", owned AS (SELECT hash, segment_id FROM owners UNION ALL SELECT hash, segment_id FROM delta_owners),
reap AS (SELECT segment_id, CAST(sum(CASE WHEN kind <> 'dedup_ref' THEN 1 ELSE 0 END) AS BIGINT) AS entries, bool_and(journal) AS journal FROM entries WHERE segment_id > {FLOOR} GROUP BY 1
  HAVING segment_id NOT IN (SELECT claimant FROM volmap) AND segment_id NOT IN (SELECT segment_id FROM owned WHERE hash IN (SELECT hash FROM live)))"""
)
RETAIN = 30

QUERIES = {
    "g01_classification": (
        lambda s, d: classes(s, d).select("segment_id", "entry_idx", "kind", "class", "emit_canonical", "live_blocks"),
        prelude("classes") + "SELECT segment_id, entry_idx, kind, class, emit_canonical, live_blocks FROM classes",
    ),
    "g01_class_counts": (
        lambda s, d: classes(s, d).groupBy("kind", "class").agg(F.count("*").alias("n"), F.sum("keep_cost").cast("long").alias("cost")),
        prelude("classes") + "SELECT kind, class, count(*) AS n, CAST(sum(keep_cost) AS BIGINT) AS cost FROM classes GROUP BY ALL",
    ),
    "g02_live_runs": (
        lambda s, d: gc.live_runs(fx.entries(s, d), volmap(s, d)).groupBy("segment_id").agg(F.sum("run_length").alias("live_blocks"), F.count("*").alias("runs")),
        prelude("classes") + "SELECT segment_id, CAST(sum(live_blocks) AS BIGINT) AS live_blocks, CAST(sum(runs) AS BIGINT) AS runs FROM matches GROUP BY segment_id",
    ),
    "g05_snapshot_floor": (
        lambda s, d: gc.above_floor(fx.segments(s, d), fx.segments(s, d).where(F.col("segment_id") <= fx.segment_share(s, d, 4)).groupBy("volume_id").agg(F.max("segment_id").alias("floor"))).groupBy("volume_id", "tier").agg(F.count("*").alias("n"), F.max("floor").alias("floor")),
        prelude("segments") + f", f AS (SELECT volume_id, max(segment_id) AS floor FROM segments WHERE segment_id <= {fx.segment_share_sql(4)} GROUP BY 1) SELECT volume_id, tier, count(*) AS n, max(floor) AS floor FROM segments JOIN f USING (volume_id) WHERE segment_id > floor GROUP BY ALL",
    ),
    "g06_pools": (
        lambda s, d: stats(s, d).groupBy("pool").agg(F.count("*").alias("segments"), F.sum("total_bytes").alias("bytes")),
        prelude("stats") + "SELECT pool, count(*) AS segments, CAST(sum(total_bytes) AS BIGINT) AS bytes FROM stats GROUP BY pool",
    ),
    "g07_residency": (
        lambda s, d: classes(s, d).groupBy("segment_id").agg(F.coalesce(F.bool_and(F.when((F.col("kind") == "data") & ~F.col("class").isin(*gc.DEAD), F.col("present"))), F.lit(True)).alias("resident")),
        prelude("classes") + "SELECT segment_id, coalesce(bool_and(present) FILTER (kind = 'data' AND class NOT IN ('drop', 'drop_and_remove_hash')), TRUE) AS resident FROM classes GROUP BY segment_id",
    ),
    "g08_candidates": (
        lambda s, d: gc.candidates(stats(s, d)).select("volume_id", "segment_id", "pool", "materialised_bytes", "output_entries", "reclaimable_bytes"),
        prelude("stats") + f"SELECT volume_id, segment_id, pool, materialised_bytes, output_entries, reclaimable_bytes FROM stats WHERE {PAYS}",
    ),
    "g09_first_fit_pack": (lambda s, d: gc.packed(stats(s, d), cap_bytes=200_000, cap_entries=60), None),
    "g10_plan": (
        plan,
        prelude("stats")
        + f""", chosen AS (SELECT segment_id FROM stats WHERE {PAYS}), c AS (SELECT * FROM classes WHERE segment_id IN (SELECT segment_id FROM chosen)),
runs AS (SELECT e.segment_id, e.entry_idx, e.class, e.start_lba AS own, greatest(m.start_lba, e.start_lba) AS lo, least(m.start_lba + m.lba_length, e.start_lba + e.lba_length) AS hi FROM c e JOIN volmap m ON m.volume_id = e.volume_id AND m.claimant = e.segment_id AND m.hash = e.hash
  AND m.start_lba < e.start_lba + e.lba_length AND e.start_lba < m.start_lba + m.lba_length AND greatest(m.start_lba, e.start_lba) - e.start_lba = m.payload_block_offset + greatest(m.start_lba, e.start_lba) - m.start_lba WHERE e.class IN ('partial_death', 'zero_sub_runs')),
p AS (SELECT 'keep' AS op, segment_id, entry_idx, -1 AS start_lba, -1 AS lba_length, -1 AS payload_block_offset FROM c WHERE class IN ('fully_live', 'defer_unresolvable_delta')
 UNION ALL SELECT 'canonical', segment_id, entry_idx, -1, -1, -1 FROM c WHERE class = 'demote_to_canonical' OR emit_canonical
 UNION ALL SELECT CASE WHEN class = 'zero_sub_runs' THEN 'zero_split' ELSE 'run' END, segment_id, entry_idx, lo, hi - lo, lo - own FROM runs)
SELECT * FROM p UNION ALL SELECT 'drop', segment_id, -1, -1, -1, -1 FROM chosen WHERE segment_id NOT IN (SELECT segment_id FROM p)""",
    ),
    "g11_plan_inputs": (
        lambda s, d: gc.candidates(stats(s, d)).groupBy("volume_id").agg(F.concat_ws(",", F.array_sort(F.collect_set("segment_id")).cast("array<string>")).alias("inputs")),
        prelude("stats") + f"SELECT volume_id, string_agg(CAST(segment_id AS VARCHAR), ',' ORDER BY segment_id) AS inputs FROM stats WHERE {PAYS} GROUP BY volume_id",
    ),
    "g15_unreachable": (
        lambda s, d: unreachable(s, d),
        prelude("live", "owners") + REAP + " SELECT * FROM reap",
    ),
    "g16_reap_cap": (
        lambda s, d: gc.capped(unreachable(s, d), 2000).select("segment_id", "ahead", "admitted"),
        prelude("live", "owners")
        + REAP
        + ", a AS (SELECT *, CAST(coalesce(sum(CASE WHEN journal THEN 0 ELSE entries END) OVER (ORDER BY segment_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ahead FROM reap) SELECT segment_id, ahead, journal OR ahead < 2000 AS admitted FROM a",
    ),
    "g18_reclaim_ranges": (
        lambda s, d: gc.reclaim_ranges(volmap(s, d), iv.normalise_ranges(fx.window(s, d))),
        prelude("volmap", "ranges")
        + """, w AS (SELECT m.*, EXISTS (SELECT 1 FROM ranges r WHERE r.start_lba <= m.start_lba AND m.start_lba + m.lba_length <= r.end_lba) AS whole FROM volmap m)
SELECT hash, count(*) AS runs, CAST(sum(lba_length) AS BIGINT) AS blocks FROM w GROUP BY hash HAVING bool_and(whole)""",
    ),
    "g19_retention": (
        lambda s, d: gc.expired(gc.confirmed_edges(fx.segments(s, d), FLOOR), F.expr(NOW), RETAIN, fx.segments(s, d).where("tier = 'pending'")).select("input", "output"),
        prelude("segments")
        + f""", e AS (SELECT unnest(inputs) AS input, segment_id AS output, created FROM segments WHERE segment_id > {FLOOR} AND tier = 'gc'), l AS (SELECT input, max(output) AS output, arg_max(created, output) AS since FROM e GROUP BY input)
SELECT input, output FROM l WHERE since + INTERVAL {RETAIN} DAY <= {NOW} AND input NOT IN (SELECT segment_id FROM segments WHERE tier = 'pending')""",
    ),
    "g20_live_set": (
        lambda s, d: gc.live_set(fx.segments(s, d).where(F.col("segment_id") <= fx.segment_share(s, d, 6)).select("segment_id"), fx.segments(s, d).where((F.col("segment_id") > fx.segment_share(s, d, 5)) & (F.col("tier") != "pending")).select("segment_id"), gc.superseded_inputs(fx.segments(s, d)), fx.segments(s, d).where("segment_id % 50 = 7").select("segment_id")),
        prelude("segments")
        + f"SELECT segment_id FROM segments WHERE (segment_id <= {fx.segment_share_sql(6)} OR (segment_id > {fx.segment_share_sql(5)} AND tier <> 'pending')) AND segment_id % 50 <> 7 AND segment_id NOT IN (SELECT unnest(inputs) FROM segments WHERE tier = 'gc')",
    ),
    "g22_confirmed_edges": (
        lambda s, d: gc.confirmed_edges(fx.segments(s, d), FLOOR).select("input", "output"),
        prelude("segments") + f", e AS (SELECT unnest(inputs) AS input, segment_id AS output FROM segments WHERE segment_id > {FLOOR} AND tier = 'gc') SELECT input, max(output) AS output FROM e GROUP BY input",
    ),
    "g24_generations": (
        lambda s, d: fx.wal(s, d).groupBy(F.floor(F.col("wal_id") / 8).alias("generation")).agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.sum("data_length").alias("bytes"), F.countDistinct("wal_id").alias("logs")),
        prelude("wal") + "SELECT wal_id // 8 AS generation, min(seq) AS first_seq, max(seq) AS last_seq, CAST(sum(data_length) AS BIGINT) AS bytes, count(DISTINCT wal_id) AS logs FROM wal GROUP BY 1",
    ),
    "s09_fork_segments": (
        lambda s, d: gc.discovered(fx.segments(s, d), fx.segment_share(s, d, 6)),
        prelude("segments")
        + f""", u AS (SELECT * FROM segments WHERE segment_id <= {fx.segment_share_sql(6)}), x AS (SELECT DISTINCT unnest(inputs) AS i FROM u WHERE tier = 'gc'), k AS (SELECT * FROM u WHERE NOT (tier = 'index' AND segment_id IN (SELECT i FROM x)))
SELECT volume_id, segment_id, tier, CAST(row_number() OVER (PARTITION BY volume_id ORDER BY CASE WHEN tier = 'pending' THEN 1 ELSE 0 END, segment_id) AS INTEGER) AS place FROM k""",
    ),
    "s10_superseded_inputs": (lambda s, d: gc.superseded_inputs(fx.segments(s, d)), prelude("segments") + "SELECT DISTINCT unnest(inputs) AS segment_id FROM segments WHERE tier = 'gc'"),
    "s11_rebuild_order": (
        lambda s, d: fx.segments(s, d).select("volume_id", "segment_id", F.when(F.col("tier") == "gc", 0).otherwise(1).alias("rank")).orderBy("volume_id", "rank", "segment_id"),
        prelude("segments") + "SELECT volume_id, segment_id, CASE WHEN tier = 'gc' THEN 0 ELSE 1 END AS rank FROM segments ORDER BY volume_id, rank, segment_id",
    ),
    "s12_committed": (
        lambda s, d: fx.segments(s, d).where("tier in ('gc', 'index')").groupBy("volume_id").agg(F.countDistinct("segment_id").alias("committed"), F.max("segment_id").alias("newest")),
        prelude("segments") + "SELECT volume_id, count(DISTINCT segment_id) AS committed, max(segment_id) AS newest FROM segments WHERE tier IN ('gc', 'index') GROUP BY volume_id",
    ),
    "a01_segment_stats": (stats, prelude("stats") + f"SELECT {STATS} FROM stats"),
    "a02_density": (
        lambda s, d: stats(s, d).select("segment_id", "density", "reclaimable_bytes").where("density < 0.7"),
        prelude("stats") + "SELECT segment_id, density, reclaimable_bytes FROM stats WHERE density < 0.7",
    ),
    "a03_output_entries": (
        lambda s, d: stats(s, d).groupBy("volume_id").agg(F.sum("output_entries").alias("output_entries"), F.sum("live_entries").alias("live_entries")),
        prelude("stats") + "SELECT volume_id, CAST(sum(output_entries) AS BIGINT) AS output_entries, CAST(sum(live_entries) AS BIGINT) AS live_entries FROM stats GROUP BY volume_id",
    ),
    "a06_bloat": (
        lambda s, d: gc.bloated(volmap(s, d), ci.data_owners(fx.entries(s, d), fx.segments(s, d)), 1, 0.2, 1000),
        prelude("volmap", "owners")
        + """, t AS (SELECT m.hash, min(start_lba) AS first_lba, max(start_lba + lba_length) AS end_lba, CAST(sum(lba_length) AS BIGINT) AS live_blocks, max(payload_block_offset + lba_length) AS logical_blocks FROM volmap m GROUP BY m.hash),
b AS (SELECT t.*, stored_length, greatest(logical_blocks - live_blocks, 0) AS dead_blocks, greatest(logical_blocks - live_blocks, 0) / CAST(logical_blocks AS DOUBLE) AS dead_ratio FROM t JOIN owners o ON o.hash = t.hash AND o.kind <> 'inline')
SELECT * FROM b WHERE dead_blocks >= 1 AND dead_ratio >= 0.2 AND stored_length >= 1000""",
    ),
    "a08_body_bytes": (
        lambda s, d: classes(s, d, body_bytes),
        prelude("classes") + "SELECT segment_id, CAST(sum(stored_length) AS BIGINT) AS stored, CAST(sum(CASE WHEN class NOT IN ('drop', 'drop_and_remove_hash') THEN stored_length ELSE 0 END) AS BIGINT) AS live FROM classes GROUP BY segment_id",
    ),
    "g21_apply_reap_to_head": (
        lambda s, d: gc.reaped_head(head(s, d), unreachable(s, d)),
        prelude("live", "owners")
        + REAP
        + " SELECT volume_id, CASE WHEN segment_id IN (SELECT segment_id FROM reap) OR segment_id % 50 = 7 THEN 'tombstoned' WHEN tier = 'gc' THEN 'superseded' ELSE 'added' END AS section, segment_id FROM segments",
    ),
}
