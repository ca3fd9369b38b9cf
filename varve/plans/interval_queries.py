"""Registered queries of the interval-map family, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from varve.operators import intervals as iv
from varve.plans import fixtures as fx
from varve.plans.fixtures import LOG_SPACE_SQL, ZERO_HASH, prelude

MAP = "start_lba, lba_length, payload_block_offset, hash, claimant, seq"


def lbamap(spark, d):
    return iv.overlay(fx.wal(spark, d))


def ranges(spark, d):
    return iv.normalise_ranges(fx.window(spark, d))


def points(spark, d):
    e = fx.read(spark, d, "events")
    return e.select(F.col("event_id").alias("request_id"), ((F.col("event_id") * 13) % (fx.log_space(spark, d) + 64)).alias("lba"))


POINTS = f"points AS (SELECT event_id AS request_id, (event_id * 13) % ({LOG_SPACE_SQL} + 64) AS lba FROM events)"


def outputs(spark, d):
    """A compaction's claims: every fourth log re-states some of its records at a new id, naming earlier logs."""
    w = fx.wal(spark, d)
    o = w.where("seq % 23 = 0").groupBy("start_lba").agg(F.max(F.struct("seq", "lba_length", "hash", "wal_id")).alias("r"))
    o = o.select("start_lba", F.lit(1).cast("long").alias("lba_length"), F.col("r.hash").alias("hash"), F.col("r.wal_id").alias("w"))
    return o.select("start_lba", "lba_length", "hash", (F.col("w") + 1).alias("claimant"), F.array(F.col("w") - 1, F.col("w")).alias("inputs"))


OUTPUTS = """outputs AS (SELECT start_lba, CAST(1 AS BIGINT) AS lba_length, arg_max(hash, seq) AS hash, arg_max(wal_id, seq) + 1 AS claimant,
  [arg_max(wal_id, seq) - 1, arg_max(wal_id, seq)] AS inputs FROM wal WHERE seq % 23 = 0 GROUP BY start_lba)"""

UPDATES = "updates AS (SELECT start_lba, lba_length, hash, wal_id + 5 AS new_claimant, wal_id + 2 AS input FROM wal WHERE seq % 17 = 0)"


def updates(spark, d):
    return fx.wal(spark, d).where("seq % 17 = 0").select("start_lba", "lba_length", "hash", (F.col("wal_id") + 5).alias("new_claimant"), (F.col("wal_id") + 2).alias("input"))


def block_image(spark, d, upto):
    w = fx.wal(spark, d)
    return iv.blocks(iv.overlay(w if upto is None else w.where(F.col("wal_id") < upto))).select("lba", "hash")


def promoted_sql(extra: str) -> str:
    return (
        prelude("lbamap")
        + ", "
        + UPDATES
        + f""", best AS (SELECT m.start_lba, m.seq, max(u.new_claimant) AS raised FROM lbamap m JOIN updates u ON m.hash = u.hash AND m.start_lba < u.start_lba + u.lba_length AND u.start_lba < m.start_lba + m.lba_length
  AND (m.claimant < u.new_claimant {extra}) GROUP BY ALL)
SELECT m.start_lba, m.lba_length, m.hash, m.seq, coalesce(raised, claimant) AS claimant, raised IS NOT NULL AS promoted FROM lbamap m LEFT JOIN best USING (start_lba, seq)"""
    )


QUERIES = {
    "i01_overlay": (lbamap, prelude("lbamap") + f"SELECT {MAP} FROM lbamap"),
    "i02_overlay_if_newer": (
        lambda s, d: iv.overlay_if_newer(fx.wal(s, d)),
        prelude("wal")
        + f""", b AS (SELECT w.*, unnest(range(start_lba, start_lba + lba_length)) AS lba FROM wal w),
t AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY lba ORDER BY wal_id DESC, seq) = 1),
i AS (SELECT *, lba - row_number() OVER (PARTITION BY seq ORDER BY lba) AS island FROM t)
SELECT min(lba) AS start_lba, count(*) AS lba_length, min(lba) - any_value(start_lba) AS payload_block_offset, any_value(hash) AS hash, any_value(wal_id) AS claimant, seq FROM i GROUP BY seq, island""",
    ),
    "i02_installed_blocks": (
        lambda s, d: iv.installed_if_newer(fx.wal(s, d).withColumn("arrival", F.col("seq") % 101), "arrival", "wal_id", "seq"),
        prelude("wal")
        + """, b AS (SELECT seq, wal_id, seq % 101 AS arrival, unnest(range(start_lba, start_lba + lba_length)) AS lba FROM wal),
h AS (SELECT *, max(wal_id) OVER (PARTITION BY lba ORDER BY arrival, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM b)
SELECT seq, CAST(sum(CASE WHEN held IS NULL OR held < wal_id THEN 1 ELSE 0 END) AS BIGINT) AS installed FROM h GROUP BY seq""",
    ),
    "i03_insert_consuming": (
        lambda s, d: iv.insert_consuming(iv.settled(fx.wal(s, d).select("start_lba", "lba_length", "hash", F.col("wal_id").alias("claimant"), "seq"), [F.col("claimant"), F.col("seq")], ["hash", "claimant"]), outputs(s, d)),
        prelude("lbamap")
        + ", "
        + OUTPUTS
        + """, j AS (SELECT coalesce(t.lba, o.start_lba) AS lba, t.start_lba, t.hash, t.wal_id AS claimant, o.start_lba AS ns, o.hash AS nh, o.claimant AS nc,
  o.claimant IS NOT NULL AND coalesce(t.wal_id IS NULL OR list_contains(o.inputs, t.wal_id) OR t.wal_id = o.claimant OR (t.hash = o.hash AND t.wal_id < o.claimant), FALSE) AS taken
  FROM tops t FULL JOIN outputs o ON t.lba = o.start_lba)
SELECT lba, CASE WHEN taken THEN ns ELSE start_lba END AS start_lba, CASE WHEN taken THEN nh ELSE hash END AS hash, CASE WHEN taken THEN nc ELSE claimant END AS claimant, taken FROM j""",
    ),
    "i05_claims_by_kind": (
        lambda s, d: fx.entries(s, d).groupBy("kind").agg(F.sum(F.when(F.col("kind").like("canonical%"), 0).otherwise(F.col("lba_length"))).alias("claimed_blocks"), F.count("*").alias("entries")),
        prelude("entries") + "SELECT kind, CAST(sum(CASE WHEN kind LIKE 'canonical%' THEN 0 ELSE lba_length END) AS BIGINT) AS claimed_blocks, count(*) AS entries FROM entries GROUP BY kind",
    ),
    "i06_rebuild_segments": (
        lambda s, d: iv.rebuild(fx.entries(s, d), fx.segments(s, d)),
        prelude("volmap") + "SELECT volume_id, start_lba, lba_length, payload_block_offset, hash, claimant, entry_idx FROM volmap",
    ),
    "i07_rebuild_ceiling": (
        lambda s, d: fx.entries(s, d).groupBy("volume_id").agg(F.max("segment_id").alias("ceiling"), F.countDistinct("segment_id").alias("segments")),
        prelude("entries") + "SELECT volume_id, max(segment_id) AS ceiling, count(DISTINCT segment_id) AS segments FROM entries GROUP BY volume_id",
    ),
    "i08_wal_replay_on_map": (
        lambda s, d: iv.overlay(
            iv.union_all(
                fx.entries(s, d).where("volume_id = 0 and kind not like 'canonical%'").select("start_lba", "lba_length", "hash", F.lit(0).cast("long").alias("tier"), (F.col("segment_id") * 100 + F.col("entry_idx")).alias("ord")),
                fx.wal(s, d).select("start_lba", "lba_length", "hash", F.lit(1).cast("long").alias("tier"), F.col("seq").alias("ord")),
            ),
            "tier",
            "ord",
        ),
        prelude("wal", "entries")
        + """, u AS (SELECT start_lba, lba_length, hash, CAST(0 AS BIGINT) AS tier, segment_id * 100 + entry_idx AS ord FROM entries WHERE volume_id = 0 AND kind NOT LIKE 'canonical%'
  UNION ALL SELECT start_lba, lba_length, hash, 1, seq FROM wal),
b AS (SELECT u.*, unnest(range(start_lba, start_lba + lba_length)) AS lba FROM u),
t AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY lba ORDER BY tier DESC, ord DESC) = 1),
i AS (SELECT *, lba - row_number() OVER (PARTITION BY tier, ord ORDER BY lba) AS island FROM t)
SELECT min(lba) AS start_lba, count(*) AS lba_length, min(lba) - any_value(start_lba) AS payload_block_offset, any_value(hash) AS hash, tier AS claimant, ord AS seq FROM i GROUP BY tier, ord, island""",
    ),
    "i10_extents_in_range": (
        lambda s, d: iv.extents_in_range(lbamap(s, d), fx.requests(s, d)),
        prelude("lbamap", "requests")
        + """SELECT request_id, greatest(r.start_lba, m.start_lba) AS range_start, least(r.end_lba, m.start_lba + m.lba_length) AS range_end, hash,
payload_block_offset + greatest(r.start_lba, m.start_lba) - m.start_lba AS payload_block_offset, claimant FROM requests r JOIN lbamap m ON r.start_lba < m.start_lba + m.lba_length AND m.start_lba < r.end_lba""",
    ),
    "i11_point_lookup": (
        lambda s, d: iv.lookup(lbamap(s, d), points(s, d)).fillna(-1, ["claimant", "block_offset"]),
        prelude("lbamap") + ", " + POINTS + " SELECT request_id, p.lba, hash, coalesce(claimant, -1) AS claimant, coalesce(payload_block_offset + p.lba - m.start_lba, -1) AS block_offset FROM points p LEFT JOIN lbamap m ON m.start_lba <= p.lba AND p.lba < m.start_lba + m.lba_length",
    ),
    "i12_hash_and_claimant_at": (
        lambda s, d: iv.lookup(lbamap(s, d), points(s, d)).fillna(-1, ["claimant"]).groupBy("hash", "claimant").agg(F.count("*").alias("points")),
        prelude("lbamap") + ", " + POINTS + " SELECT hash, coalesce(claimant, -1) AS claimant, count(*) AS points FROM points p LEFT JOIN lbamap m ON m.start_lba <= p.lba AND p.lba < m.start_lba + m.lba_length GROUP BY ALL",
    ),
    "i13_full_match": (
        lambda s, d: iv.full_matches(lbamap(s, d), fx.wal(s, d).select("seq", "start_lba", "lba_length", "hash")),
        prelude("lbamap") + "SELECT seq, start_lba, lba_length, hash FROM wal w WHERE EXISTS (SELECT 1 FROM lbamap m WHERE m.start_lba = w.start_lba AND m.lba_length = w.lba_length AND m.hash = w.hash AND m.payload_block_offset = 0)",
    ),
    "i14_runs_for_hash": (
        lambda s, d: lbamap(s, d).join(fx.wal(s, d).where("seq % 200 = 1").select("hash").distinct(), "hash", "left_semi").select("hash", "start_lba", "lba_length", "payload_block_offset"),
        prelude("lbamap") + "SELECT hash, start_lba, lba_length, payload_block_offset FROM lbamap WHERE hash IN (SELECT hash FROM wal WHERE seq % 200 = 1)",
    ),
    "i15_claim_refcounts": (
        lambda s, d: iv.claim_refcounts(lbamap(s, d)),
        prelude("lbamap") + "SELECT hash, count(*) AS claims, CAST(sum(lba_length) AS BIGINT) AS blocks FROM lbamap GROUP BY hash",
    ),
    "i16_recount_agrees": (
        lambda s, d: iv.claim_refcounts(lbamap(s, d)).select(F.col("hash"), "claims").join(iv.blocks(lbamap(s, d)).groupBy("hash").agg(F.countDistinct("seq", F.col("lba") - F.col("lba") % 1).alias("blocks")), "hash").agg(F.count("*").alias("hashes"), F.sum("claims").alias("claims"), F.sum("blocks").alias("blocks")),
        prelude("lbamap") + "SELECT count(DISTINCT hash) AS hashes, count(*) AS claims, CAST(sum(lba_length) AS BIGINT) AS blocks FROM lbamap",
    ),
    "i17_referenced_hashes": (
        lambda s, d: fx.wal(s, d).select("hash").distinct().join(lbamap(s, d).select("hash").distinct().withColumn("referenced", F.lit(True)), "hash", "left").select("hash", F.coalesce("referenced", F.lit(False)).alias("referenced")),
        prelude("lbamap") + "SELECT DISTINCT hash, hash IN (SELECT hash FROM lbamap) AS referenced FROM wal",
    ),
    "i18_referenced_or_source": (
        lambda s, d: iv.rebuild(fx.entries(s, d), fx.segments(s, d)).select("hash").union(fx.entries(s, d).where("delta_source is not null").select("delta_source")).distinct(),
        prelude("live") + "SELECT hash FROM live",
    ),
    "i19_promote_claimants": (lambda s, d: iv.promote_claimants(lbamap(s, d), updates(s, d)), promoted_sql("")),
    "i19_promote_consuming": (lambda s, d: iv.promote_claimants(lbamap(s, d), updates(s, d), consuming=True), promoted_sql("OR m.claimant = u.input")),
    "i20_dump": (
        lambda s, d: lbamap(s, d).select("start_lba", (F.col("start_lba") + F.col("lba_length")).alias("end_lba"), F.substring("hash", 1, 12).alias("short_hash"), "payload_block_offset", "claimant").orderBy("start_lba"),
        prelude("lbamap") + "SELECT start_lba, start_lba + lba_length AS end_lba, substr(hash, 1, 12) AS short_hash, payload_block_offset, claimant FROM lbamap ORDER BY start_lba",
    ),
    "i21_normalise_ranges": (ranges, prelude("ranges") + "SELECT start_lba, end_lba FROM ranges"),
    "i22_ranges_contain": (
        lambda s, d: iv.contained(points(s, d), ranges(s, d)),
        prelude("ranges") + ", " + POINTS + " SELECT request_id, lba, EXISTS (SELECT 1 FROM ranges r WHERE r.start_lba <= lba AND lba < r.end_lba) AS inside FROM points",
    ),
    "i23_ranges_total": (
        lambda s, d: ranges(s, d).agg(F.sum(F.col("end_lba") - F.col("start_lba")).alias("blocks"), F.count("*").alias("ranges")),
        prelude("ranges") + "SELECT CAST(sum(end_lba - start_lba) AS BIGINT) AS blocks, count(*) AS ranges FROM ranges",
    ),
    "i24_boundary_crossers": (
        lambda s, d: iv.boundary_crossers(fx.wal(s, d), ranges(s, d)).select("seq", "start_lba", "lba_length"),
        prelude("wal", "ranges")
        + ", edges AS (SELECT start_lba AS x FROM ranges UNION SELECT end_lba FROM ranges) SELECT seq, start_lba, lba_length FROM wal WHERE EXISTS (SELECT 1 FROM edges WHERE x > start_lba AND x < start_lba + lba_length)",
    ),
    "i25_split_at_boundaries": (
        lambda s, d: iv.split_at_boundaries(fx.wal(s, d), ranges(s, d)),
        prelude("wal", "ranges")
        + """, edges AS (SELECT start_lba AS x FROM ranges UNION SELECT end_lba FROM ranges),
pts AS (SELECT seq, start_lba AS x FROM wal UNION SELECT seq, start_lba + lba_length FROM wal UNION SELECT seq, x FROM wal JOIN edges ON x > start_lba AND x < start_lba + lba_length),
nx AS (SELECT seq, x, lead(x) OVER (PARTITION BY seq ORDER BY x) AS y FROM pts)
SELECT seq, x AS start_lba, y - x AS lba_length FROM nx WHERE y IS NOT NULL""",
    ),
    "i26_partition_span": (
        lambda s, d: iv.partition_span(fx.wal(s, d), ranges(s, d)),
        prelude("wal", "ranges")
        + """, b AS (SELECT seq, unnest(range(start_lba, start_lba + lba_length)) AS lba FROM wal),
f AS (SELECT seq, lba, EXISTS (SELECT 1 FROM ranges r WHERE r.start_lba <= lba AND lba < r.end_lba) AS inside FROM b),
i AS (SELECT *, lba - row_number() OVER (PARTITION BY seq, inside ORDER BY lba) AS g FROM f)
SELECT seq, min(lba) AS start_lba, max(lba) + 1 AS end_lba, inside FROM i GROUP BY seq, inside, g""",
    ),
    "i28_coverage": (
        lambda s, d: iv.coverage(fx.wal(s, d).where("kind = 'data'")),
        prelude("wal") + ", b AS (SELECT DISTINCT unnest(range(start_lba, start_lba + lba_length)) AS lba FROM wal WHERE kind = 'data') SELECT lba // 64 AS word, count(*) AS covered FROM b GROUP BY 1",
    ),
    "i29_changed_runs": (
        lambda s, d: iv.changed_runs(block_image(s, d, 60), block_image(s, d, None)),
        prelude("lbamap")
        + """, old AS (SELECT lba, hash FROM blocks WHERE wal_id < 60 QUALIFY row_number() OVER (PARTITION BY lba ORDER BY wal_id DESC, seq DESC) = 1),
c AS (SELECT coalesce(o.lba, t.lba) AS lba FROM old o FULL JOIN tops t ON o.lba = t.lba WHERE o.hash IS DISTINCT FROM t.hash),
i AS (SELECT lba, lba - row_number() OVER (ORDER BY lba) AS g FROM c) SELECT min(lba) AS start_lba, count(*) AS lba_length FROM i GROUP BY g""",
    ),
    "i30_snapshot_source_map": (
        lambda s, d: iv.snapshot_source_map(lbamap(s, d), ranges(s, d), ZERO_HASH),
        prelude("lbamap", "ranges")
        + f"SELECT unnest(range(start_lba, start_lba + lba_length)) AS lba, hash FROM lbamap m WHERE hash <> '{ZERO_HASH}' AND NOT EXISTS (SELECT 1 FROM ranges r WHERE r.start_lba <= m.start_lba AND m.start_lba < r.end_lba)",
    ),
    "i31_snapshot_identity": (
        lambda s, d: iv.fingerprint(lbamap(s, d)),
        prelude("lbamap")
        + ", p AS (SELECT start_lba // 1024 AS stretch, sha256(string_agg(hash, ',' ORDER BY start_lba)) AS h FROM lbamap GROUP BY 1) SELECT sha256(string_agg(h, ',' ORDER BY stretch)) AS snapshot_id FROM p",
    ),
}
