"""Registered queries of the content index, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from varve.operators import content_index as ci
from varve.operators import intervals as iv
from varve.plans import fixtures as fx
from varve.plans.fixtures import prelude


def owners(s, d):
    return ci.data_owners(fx.entries(s, d), fx.segments(s, d))


def deltas(s, d):
    return ci.delta_owners(fx.entries(s, d), fx.segments(s, d), owners(s, d))


def output(s, d):
    """The compaction outputs' bodies: each gc segment's entries under its inputs; of one hash the lowest output."""
    g = fx.entries(s, d).where("kind in ('data', 'inline', 'canonical_data')").join(fx.segments(s, d).where("tier = 'gc'").select("segment_id", "inputs"), "segment_id")
    return g.groupBy("hash").agg(F.min(F.struct("segment_id", "inputs")).alias("o")).select("hash", "o.segment_id", "o.inputs")


def retried(s, d):
    """The write log with every purchase sent twice, as after a lost reply."""
    w = fx.wal(s, d).join(fx.read(s, d, "events").select(F.col("event_id").alias("seq"), "event_type"), "seq")
    sent = F.when(F.col("event_type") == "purchase", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return w.withColumn("again", F.explode(sent)).select((F.col("seq") * 2 + F.col("again")).alias("seq"), "start_lba", "lba_length", "hash")


def sources(s, d):
    """Volumes that others take extents from, with the greatest snapshot of each: ``volume_id, source, cutoff``."""
    v = fx.segments(s, d).select("volume_id").distinct()
    shares = F.array(*(F.struct((F.col("volume_id") - back).alias("source"), F.lit(fx.segment_share(s, d, tenths)).cast("long").alias("cutoff")) for back, tenths in ((1, 4), (2, 7), (1, 6))))
    return v.select("volume_id", F.explode(shares).alias("x")).select("volume_id", "x.*").where("source >= 0").groupBy("volume_id", "source").agg(F.max("cutoff").alias("cutoff"))


def moves(s, d):
    """Moves of owners: an entry of a pending segment goes from where its caller last saw it to the segment's promoted form; some saw it elsewhere."""
    e = fx.entries(s, d).where("kind in ('data', 'inline', 'canonical_data') and not journal").join(fx.segments(s, d).where("tier = 'pending'").select("segment_id"), "segment_id")
    m = e.groupBy("hash").agg(F.min(F.struct("segment_id", "entry_idx")).alias("m"))
    return m.select("hash", F.col("m.segment_id").alias("expected_segment"), F.col("m.entry_idx").alias("expected_entry"), (F.col("m.segment_id") + PROMOTED).alias("new_segment"))


#: Promoted segments' ids begin here.
PROMOTED = 1_000_000_000
OUTPUT = """output AS (SELECT hash, arg_min(segment_id, segment_id) AS segment_id, arg_min(inputs, segment_id) AS inputs FROM entries JOIN (SELECT segment_id, inputs FROM segments WHERE tier = 'gc') USING (segment_id)
  WHERE kind IN ('data', 'inline', 'canonical_data') GROUP BY hash)"""

QUERIES = {
    "d01_data_owners": (owners, prelude("owners") + "SELECT hash, segment_id, entry_idx, kind, stored_length, tier FROM owners"),
    "d03_owner_counts": (
        lambda s, d: owners(s, d).groupBy("segment_id").agg(F.count("*").alias("owned"), F.sum("stored_length").alias("owned_bytes")),
        prelude("owners") + "SELECT segment_id, count(*) AS owned, CAST(sum(stored_length) AS BIGINT) AS owned_bytes FROM owners GROUP BY segment_id",
    ),
    "d04_registration_routes": (
        lambda s, d: fx.entries(s, d)
        .join(owners(s, d).select("hash", F.lit(True).alias("has_body")), "hash", "left")
        .withColumn("route", F.when(F.col("kind").isin("dedup_ref", "zero"), "none").when(F.col("journal") & F.col("kind").isin(*ci.BODIES), "journal").when(F.col("kind") == "delta", F.when(F.col("has_body"), "refused").otherwise("delta")).otherwise("data"))
        .groupBy("kind", "route")
        .agg(F.count("*").alias("n")),
        prelude("owners")
        + """SELECT kind, CASE WHEN kind IN ('dedup_ref', 'zero') THEN 'none' WHEN journal AND kind IN ('data', 'inline', 'canonical_data') THEN 'journal' WHEN kind = 'delta' THEN CASE WHEN hash IN (SELECT hash FROM owners) THEN 'refused' ELSE 'delta' END ELSE 'data' END AS route, count(*) AS n FROM entries GROUP BY ALL""",
    ),
    "d06_consuming_takeover": (
        lambda s, d: ci.taken_over(owners(s, d), output(s, d)),
        prelude("owners")
        + ", "
        + OUTPUT
        + """, j AS (SELECT coalesce(w.hash, o.hash) AS hash, w.segment_id AS old, o.segment_id AS new, o.segment_id IS NOT NULL AND coalesce(w.segment_id IS NULL OR list_contains(o.inputs, w.segment_id), FALSE) AS taken FROM owners w FULL JOIN output o ON w.hash = o.hash)
SELECT hash, CASE WHEN taken THEN new ELSE old END AS segment_id, taken FROM j""",
    ),
    "d07_resolution": (
        lambda s, d: ci.resolved(fx.entries(s, d), owners(s, d), deltas(s, d)),
        prelude("owners")
        + """, jo AS (SELECT DISTINCT segment_id, hash FROM entries WHERE journal AND kind IN ('data', 'inline', 'canonical_data'))
SELECT e.segment_id, e.entry_idx, e.hash, CASE WHEN j.hash IS NOT NULL THEN 'journal' WHEN o.hash IS NOT NULL THEN 'data' WHEN d.hash IS NOT NULL THEN 'delta' ELSE 'missing' END AS found_in,
CASE WHEN j.hash IS NOT NULL THEN e.segment_id ELSE coalesce(o.segment_id, d.segment_id, -1) END AS found_at
FROM entries e LEFT JOIN jo j ON j.segment_id = e.segment_id AND j.hash = e.hash LEFT JOIN owners o ON o.hash = e.hash LEFT JOIN delta_owners d ON d.hash = e.hash WHERE e.kind <> 'zero'""",
    ),
    "d08_delta_owners": (deltas, prelude("owners") + "SELECT hash, segment_id, entry_idx, delta_source, delta_length FROM delta_owners"),
    "d09_journal_owners": (
        lambda s, d: ci.journal_owners(fx.entries(s, d)),
        prelude("entries") + "SELECT segment_id, hash, min(entry_idx) AS entry_idx FROM entries WHERE journal AND kind IN ('data', 'inline', 'canonical_data') GROUP BY ALL",
    ),
    "d11_remove_owner_at": (
        lambda s, d: owners(s, d).join(fx.entries(s, d).where("entry_idx = 2").select("hash", "segment_id"), ["hash", "segment_id"], "left_anti").select("hash", "segment_id"),
        prelude("owners") + "SELECT hash, segment_id FROM owners o WHERE NOT EXISTS (SELECT 1 FROM entries e WHERE e.entry_idx = 2 AND e.hash = o.hash AND e.segment_id = o.segment_id)",
    ),
    "d12_remove_uncarried": (
        lambda s, d: ci.removed_uncarried(owners(s, d), fx.segments(s, d).where("tier = 'gc'").select(F.explode("inputs").alias("segment_id")).distinct(), fx.entries(s, d).where("kind <> 'dedup_ref'").join(fx.segments(s, d).where("tier = 'gc'").select("segment_id"), "segment_id", "left_semi")),
        prelude("owners")
        + """, ins AS (SELECT DISTINCT unnest(inputs) AS segment_id FROM segments WHERE tier = 'gc'), carried AS (SELECT DISTINCT hash FROM entries JOIN segments USING (segment_id) WHERE tier = 'gc' AND kind <> 'dedup_ref')
SELECT segment_id, count(*) AS removed FROM owners WHERE segment_id IN (SELECT segment_id FROM ins) AND hash NOT IN (SELECT hash FROM carried) GROUP BY segment_id""",
    ),
    "d13_named_delta_sources": (
        lambda s, d: ci.named_sources(fx.entries(s, d)),
        prelude("entries") + "SELECT delta_source AS hash, count(*) AS encodings, count(DISTINCT segment_id) AS segments FROM entries WHERE delta_source IS NOT NULL GROUP BY 1",
    ),
    "d15_purge_segment_sources": (
        lambda s, d: ci.named_sources(fx.entries(s, d).where("segment_id % 3 <> 0")).select("hash", "encodings"),
        prelude("entries") + "SELECT delta_source AS hash, count(*) AS encodings FROM entries WHERE delta_source IS NOT NULL AND segment_id % 3 <> 0 GROUP BY 1",
    ),
    "d17_formation_dedup": (
        lambda s, d: ci.formation_dedup(fx.entries(s, d), fx.segments(s, d)),
        prelude("owners")
        + """, p AS (SELECT e.*, e.kind IN ('data', 'inline') AND NOT e.journal AND o.hash IS NOT NULL AND NOT (o.segment_id = e.segment_id AND o.entry_idx = e.entry_idx) AS dup FROM entries e JOIN segments s USING (segment_id) LEFT JOIN owners o ON o.hash = e.hash WHERE s.tier = 'pending')
SELECT segment_id, CAST(sum(CASE WHEN dup THEN 1 ELSE 0 END) AS BIGINT) AS deduped, CAST(sum(CASE WHEN dup THEN stored_length ELSE 0 END) AS BIGINT) AS bytes_saved, count(*) AS entries FROM p GROUP BY segment_id""",
    ),
    "d19_presence_bits": (
        lambda s, d: ci.presence_words(fx.entries(s, d)),
        prelude("entries") + "SELECT segment_id, (entry_idx - 1) // 32 AS word, CAST(sum(CASE WHEN present THEN 1 << ((entry_idx - 1) % 32) ELSE 0 END) AS BIGINT) AS bits, CAST(sum(CASE WHEN present THEN 1 ELSE 0 END) AS BIGINT) AS set_bits FROM entries GROUP BY ALL",
    ),
    "d20_dedup_stats": (
        lambda s, d: ci.dedup_stats(fx.files(s, d)),
        prelude("files") + "SELECT count(*) AS n_items, count(DISTINCT hash) AS n_unique, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS total_bytes, CASE WHEN count(DISTINCT hash) = 0 THEN 1.0 ELSE count(*) / CAST(count(DISTINCT hash) AS DOUBLE) END AS ratio FROM files",
    ),
    # joins in their relational reading
    "j01_as_of": (
        lambda s, d: iv.lookup(iv.overlay(fx.wal(s, d)), fx.requests(s, d).select("request_id", F.col("start_lba").alias("lba"))).fillna(-1, ["claimant", "block_offset"]),
        prelude("lbamap", "requests") + "SELECT request_id, r.start_lba AS lba, hash, coalesce(claimant, -1) AS claimant, coalesce(payload_block_offset + r.start_lba - m.start_lba, -1) AS block_offset FROM requests r LEFT JOIN lbamap m ON m.start_lba <= r.start_lba AND r.start_lba < m.start_lba + m.lba_length",
    ),
    "j02_semi_referenced": (
        lambda s, d: fx.entries(s, d).join(iv.rebuild(fx.entries(s, d), fx.segments(s, d)).select("hash"), "hash", "left_semi").groupBy("kind").agg(F.count("*").alias("referenced")),
        prelude("volmap") + "SELECT kind, count(*) AS referenced FROM entries WHERE hash IN (SELECT hash FROM volmap) GROUP BY kind",
    ),
    "j03_anti_unreferenced": (
        lambda s, d: fx.entries(s, d).join(iv.rebuild(fx.entries(s, d), fx.segments(s, d)).select("hash"), "hash", "left_anti").select("segment_id", "entry_idx", "kind"),
        prelude("volmap") + "SELECT segment_id, entry_idx, kind FROM entries WHERE hash NOT IN (SELECT hash FROM volmap)",
    ),
    "d10_rekey_owner": (
        lambda s, d: ci.replaced_if_matching(owners(s, d), moves(s, d)),
        prelude("owners")
        + f""", m AS (SELECT hash, min(struct_pack(s := e.segment_id, i := e.entry_idx)) AS m FROM entries e JOIN segments USING (segment_id) WHERE tier = 'pending' AND kind IN ('data', 'inline', 'canonical_data') AND NOT journal GROUP BY hash)
SELECT o.hash, CASE WHEN m.hash IS NOT NULL AND o.segment_id = m.m.s AND o.entry_idx = m.m.i THEN o.segment_id + {PROMOTED} ELSE o.segment_id END AS segment_id, coalesce(o.segment_id = m.m.s AND o.entry_idx = m.m.i, FALSE) AS replaced FROM owners o LEFT JOIN m ON m.hash = o.hash""",
    ),
    "d16_journal_rekey": (
        lambda s, d: ci.rekeyed_journal(ci.journal_owners(fx.entries(s, d)), fx.segments(s, d).where("tier = 'gc'").select(F.explode("inputs").alias("segment_id"), F.col("segment_id").alias("output"))),
        prelude("entries", "segments")
        + """, r AS (SELECT i AS segment_id, max(output) AS output FROM (SELECT unnest(inputs) AS i, segment_id AS output FROM segments WHERE tier = 'gc') GROUP BY i),
j AS (SELECT segment_id, hash, min(entry_idx) AS entry_idx FROM entries WHERE journal AND kind IN ('data', 'inline', 'canonical_data') GROUP BY ALL), k AS (SELECT coalesce(r.output, j.segment_id) AS segment_id, hash, struct_pack(s := j.segment_id, i := entry_idx) AS spot FROM j LEFT JOIN r ON r.segment_id = j.segment_id)
SELECT segment_id, hash, (max(spot)).s AS was_in, (max(spot)).i AS entry_idx FROM k GROUP BY segment_id, hash""",
    ),
    "d18_noop_writes": (
        lambda s, d: ci.noop_writes(retried(s, d)),
        prelude("wal")
        + """, w AS (SELECT seq * 2 + again AS seq, start_lba, lba_length, hash FROM (SELECT w.*, unnest(CASE WHEN e.event_type = 'purchase' THEN [0, 1] ELSE [0] END) AS again FROM wal w JOIN events e ON e.event_id = w.seq)), b AS (SELECT *, unnest(range(start_lba, start_lba + lba_length)) AS lba FROM w),
l AS (SELECT *, lag(hash) OVER p = hash AND lag(lba - start_lba) OVER p = lba - start_lba AS same FROM b WINDOW p AS (PARTITION BY lba ORDER BY seq)) SELECT seq, bool_and(coalesce(same, FALSE)) AS skipped FROM l GROUP BY seq""",
    ),
    "d21_lineage_dedup": (
        lambda s, d: ci.lineage_owners(fx.entries(s, d), fx.segments(s, d), sources(s, d)),
        prelude("owners")
        + f""", vols AS (SELECT DISTINCT volume_id FROM segments), src AS (SELECT volume_id, unnest([volume_id - 1, volume_id - 2, volume_id - 1]) AS source, unnest([4, 7, 6]) AS tenth FROM vols), cut AS (SELECT volume_id, source, max(tenth) * (SELECT max(o_orderkey) FROM orders) // 10 AS cutoff FROM src WHERE source >= 0 GROUP BY ALL),
seen AS (SELECT c.volume_id, e.hash, min(struct_pack(r := CASE WHEN s.tier = 'pending' THEN 1 ELSE 0 END, s := e.segment_id, i := e.entry_idx)) AS w FROM cut c JOIN segments s ON s.volume_id = c.source AND s.segment_id <= c.cutoff JOIN entries e ON e.segment_id = s.segment_id WHERE e.kind IN ('data', 'inline', 'canonical_data') AND NOT e.journal AND s.tier <> 'pending' GROUP BY ALL),
own AS (SELECT s.volume_id, e.hash, min(struct_pack(r := CASE WHEN s.tier = 'pending' THEN 1 ELSE 0 END, s := e.segment_id, i := e.entry_idx)) AS w FROM segments s JOIN entries e USING (segment_id) WHERE e.kind IN ('data', 'inline', 'canonical_data') AND NOT e.journal GROUP BY ALL)
SELECT coalesce(o.volume_id, n.volume_id) AS volume_id, coalesce(o.hash, n.hash) AS hash, coalesce(o.w.s, n.w.s) AS segment_id, o.hash IS NULL AS foreign_body, o.hash IS NOT NULL AND n.hash IS NOT NULL AS deduplicable FROM own o FULL JOIN seen n ON n.volume_id = o.volume_id AND n.hash = o.hash""",
    ),
}
