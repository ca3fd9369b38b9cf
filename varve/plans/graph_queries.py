"""Registered queries of lineage, journals and fetch planning, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from varve.functions import scalars as sc
from varve.operators import content_index as ci
from varve.operators import events as ev
from varve.operators import fetching as fe
from varve.operators import intervals as iv
from varve.operators import lineage as li
from varve.operators import read_path as rp
from varve.operators import snapshots as sn
from varve.plans import fixtures as fx
from varve.plans import storage_queries as sq
from varve.plans.fixtures import prelude

CLOSURE = """, up(id, ancestor, depth) AS (SELECT volume_id, parent_id, 1 FROM lineage WHERE parent_id IS NOT NULL UNION ALL SELECT u.id, l.parent_id, u.depth + 1 FROM up u JOIN lineage l ON l.volume_id = u.ancestor WHERE l.parent_id IS NOT NULL)"""
KEYS = "keys AS (SELECT DISTINCT conv_id AS key_name, conv_id % 11 AS mark FROM conversations WHERE conv_id % 6 <> 5)"


def keys(s, d):
    return fx.read(s, d, "conversations").where("conv_id % 6 <> 5").select(F.col("conv_id").alias("key_name"), (F.col("conv_id") % 11).alias("mark")).distinct()


def leases(s, d):
    e = fx.entries(s, d)
    return e.select("segment_id", F.col("entry_idx").alias("lease_id"), (F.col("start_lba") % 50).alias("first"), (F.col("start_lba") % 50 + F.col("lba_length") * 3).alias("last"))


def named_puts(s, d):
    """Puts under a conversation's name: created, updated, deleted, created again; some writers expect a version that is gone."""
    t, stale = F.col("event_id"), (F.col("name") + F.col("event_id")) % 7 == 0
    verb = F.when(t % 5 == 0, "create").when(t % 5 == 4, "delete").otherwise("update")
    return fx.journal(s, d).select("name", "event_id", verb.alias("verb"), F.when(verb == "update", t - F.when(stale, 2).otherwise(1)).otherwise(-1).cast("long").alias("expected"))


PUTS = """, ops AS (SELECT name, event_id, CASE event_id % 5 WHEN 0 THEN 'create' WHEN 4 THEN 'delete' ELSE 'update' END AS verb, CASE WHEN event_id % 5 IN (0, 4) THEN -1 ELSE event_id - CASE WHEN (name + event_id) % 7 = 0 THEN 2 ELSE 1 END END AS expected FROM journal),
nth AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY event_id) AS k FROM ops),
st(name, k, event_id, verb, outcome, version) AS (SELECT DISTINCT name, CAST(0 AS BIGINT), CAST(-1 AS BIGINT), '', '', CAST(-1 AS BIGINT) FROM nth UNION ALL
SELECT n.name, n.k, n.event_id, n.verb, CASE WHEN n.verb = 'delete' OR (n.verb = 'create' AND version = -1) OR (n.verb = 'update' AND version <> -1 AND version = expected) THEN 'ok' ELSE 'precondition_failed' END,
  CASE WHEN n.verb = 'delete' THEN -1 WHEN (n.verb = 'create' AND version = -1) OR (n.verb = 'update' AND version <> -1 AND version = expected) THEN n.event_id ELSE version END FROM st JOIN nth n ON n.name = st.name AND n.k = st.k + 1)"""


def timed(s, d):
    """Events with a ULID of their time and the time that their record states, which some have wrong."""
    j = fx.journal(s, d)
    minted = sc.ulid_of(F.lit(1_700_000_000_000) + F.col("stamp") * 1000, F.col("event_id"))
    return j.select("name", "event_id", minted.alias("ulid"), (F.lit(1_700_000_000_000) + F.col("stamp") * 1000 + (F.col("event_id") % 9 == 8).cast("long")).alias("stamp"))


def volumes(s, d):
    return fx.lineage(s, d).select("volume_id", F.when(F.col("role") != "skeleton", F.concat_ws("-", "role", F.col("volume_id").cast("string"))).alias("name"), (F.col("role") != "anchor").alias("readonly"))


def missing_indexes(s, d):
    """Segments that a volume's layers name and whose index is not here: nothing of them is present."""
    named = sq.manifest(s, d).withColumnRenamed("volume_id", "layer")
    needed = sn.layers(sq.parents(s, d)).join(named, "layer").select("volume_id", "layer", "segment_id")
    return needed.join(fx.entries(s, d).where("present").select("segment_id").distinct(), "segment_id", "left_anti")


def placed(s, d):
    """Entries with the place of their bytes in their segment; what is no data leaves gaps between bodies."""
    return rp.offsets(fx.entries(s, d), "segment_id", ["entry_idx"], "stored_length")


PLACED = ", placed AS (SELECT *, CAST(coalesce(sum(stored_length) OVER (PARTITION BY segment_id ORDER BY entry_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS body_offset FROM entries)"


def machine_cells() -> str:
    return "m(state, verb, outcome, next_state) AS (VALUES " + ", ".join(str(t) for t in ev.TRANSITIONS) + ")"


QUERIES = {
    "l01_ancestor_walk": (
        lambda s, d: li.ancestor_walk(fx.lineage(s, d), 97),
        prelude("lineage", recursive=True)
        + ", w(volume_id, parent_id, branch_snapshot, cutoff, depth) AS (SELECT volume_id, parent_id, branch_snapshot, CAST(NULL AS BIGINT), 0 FROM lineage WHERE volume_id = 97 UNION ALL SELECT l.volume_id, l.parent_id, l.branch_snapshot, w.branch_snapshot, w.depth + 1 FROM w JOIN lineage l ON l.volume_id = w.parent_id) SELECT volume_id, coalesce(cutoff, -1) AS cutoff, CAST(max(depth) OVER () - depth AS BIGINT) AS layer FROM w",
    ),
    "l02_source_cutoffs": (
        lambda s, d: li.source_cutoffs(fx.lineage(s, d)),
        prelude("lineage", recursive=True)
        + CLOSURE
        + ", own AS (SELECT volume_id, unnest(sources) AS source, coalesce(branch_snapshot, -1) AS cutoff FROM lineage), every AS (SELECT * FROM own UNION ALL SELECT u.id, o.source, o.cutoff FROM up u JOIN own o ON o.volume_id = u.ancestor) SELECT volume_id, source, max(cutoff) AS cutoff FROM every GROUP BY ALL",
    ),
    "l03_lineage_set": (
        lambda s, d: li.lineage_set(fx.lineage(s, d)),
        prelude("lineage", recursive=True)
        + CLOSURE
        + ", src AS (SELECT volume_id, unnest(sources) AS member, 1000 + unnest(range(len(sources))) AS place FROM lineage), every AS (SELECT id AS volume_id, ancestor AS member, CAST(depth AS BIGINT) AS place FROM up UNION ALL SELECT * FROM src) SELECT volume_id, member, min(place) AS place FROM every GROUP BY ALL",
    ),
    "l04_chain_verify": (
        lambda s, d: li.chain_check(fx.lineage(s, d), F.col("volume_id") % 17 != 3),
        prelude("lineage", recursive=True)
        + CLOSURE
        + " SELECT id AS volume_id, CAST(max(depth) AS BIGINT) AS depth, CAST(sum(CASE WHEN l.volume_id IS NULL OR l.volume_id % 17 = 3 THEN 1 ELSE 0 END) AS BIGINT) AS missing FROM up LEFT JOIN lineage l ON l.volume_id = ancestor GROUP BY id",
    ),
    "l05_forest": (
        lambda s, d: li.forest(fx.lineage(s, d).where("volume_id % 31 <> 7")),
        prelude("lineage", recursive=True)
        + ", k AS (SELECT * FROM lineage WHERE volume_id % 31 <> 7)"
        + CLOSURE.replace("FROM lineage", "FROM k").replace("JOIN lineage", "JOIN k")
        + """, nodes AS (SELECT volume_id, parent_id, role FROM k UNION ALL SELECT DISTINCT parent_id, NULL, 'missing' FROM k WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT volume_id FROM k)),
alive AS (SELECT volume_id FROM k WHERE role = 'anchor' UNION SELECT ancestor FROM up JOIN k ON k.volume_id = up.id WHERE k.role = 'anchor')
SELECT volume_id, coalesce(parent_id, -1) AS parent_id, role, volume_id IN (SELECT volume_id FROM alive) AS live FROM nodes""",
    ),
    "l06_who_references": (
        lambda s, d: li.referencing_anchors(fx.lineage(s, d)),
        prelude("lineage", recursive=True) + CLOSURE + " SELECT ancestor AS volume_id, count(*) AS anchors, min(id) AS first_anchor FROM up JOIN lineage l ON l.volume_id = id WHERE l.role = 'anchor' GROUP BY ancestor",
    ),
    "l07_liveness_pass": (
        lambda s, d: li.liveness_pass(li.forest(fx.lineage(s, d)), fx.lineage(s, d).where("volume_id % 3 = 0").select("volume_id"), False),
        prelude("lineage", recursive=True)
        + CLOSURE
        + ", alive AS (SELECT volume_id FROM lineage WHERE role = 'anchor' UNION SELECT ancestor FROM up JOIN lineage k ON k.volume_id = up.id WHERE k.role = 'anchor') SELECT volume_id, CASE WHEN volume_id % 3 = 0 THEN 'swept' ELSE 'condemned' END AS action FROM lineage WHERE volume_id NOT IN (SELECT volume_id FROM alive)",
    ),
    "l08_fork_create": (
        lambda s, d: fx.lineage(s, d).where("volume_id % 100 = 5").select((F.col("volume_id") + 1_000_000).alias("volume_id"), F.col("volume_id").alias("parent_id"), (F.coalesce("branch_snapshot", F.lit(0)) + 1).alias("branch_snapshot")),
        prelude("lineage") + "SELECT volume_id + 1000000 AS volume_id, volume_id AS parent_id, coalesce(branch_snapshot, 0) + 1 AS branch_snapshot FROM lineage WHERE volume_id % 100 = 5",
    ),
    "l10_tree": (
        lambda s, d: li.tree(fx.lineage(s, d)),
        prelude("lineage", recursive=True)
        + ", t(volume_id, path, depth) AS (SELECT volume_id, lpad(CAST(volume_id AS VARCHAR), 8, '0'), 0 FROM lineage WHERE parent_id IS NULL UNION ALL SELECT l.volume_id, t.path || '/' || lpad(CAST(l.volume_id AS VARCHAR), 8, '0'), t.depth + 1 FROM t JOIN lineage l ON l.parent_id = t.volume_id) SELECT volume_id, path, repeat('  ', depth) || volume_id AS line FROM t",
    ),
    "e01_recent_walk": (
        lambda s, d: ev.recent_walk(fx.journal(s, d), 12, 3),
        prelude("journal", recursive=True)
        + """, h AS (SELECT name, event_id, prev_id, row_number() OVER (PARTITION BY name ORDER BY event_id DESC) AS place FROM journal QUALIFY place <= 3),
w(name, event_id, prev_id, place) AS (SELECT * FROM h WHERE place = 3 UNION ALL SELECT j.name, j.event_id, j.prev_id, w.place + 1 FROM w JOIN journal j ON j.name = w.name AND j.event_id = w.prev_id WHERE w.place < 12)
SELECT name, event_id, place FROM h UNION SELECT name, event_id, place FROM w""",
    ),
    "e02_list_verified": (
        lambda s, d: ev.verified(fx.journal(s, d), keys(s, d)),
        prelude("journal") + ", " + KEYS + " SELECT name, event_id, CASE WHEN payload IS NULL THEN 'unparseable' WHEN key_name IS NULL THEN 'key_unavailable' WHEN (payload + event_id) % 11 = mark THEN 'invalid' ELSE 'valid' END AS status FROM journal LEFT JOIN keys ON key_name = name",
    ),
    "e03_head_windows": (
        lambda s, d: ev.head_windows(fx.journal(s, d), 4),
        prelude("journal") + ", h AS (SELECT name, event_id FROM journal QUALIFY row_number() OVER (PARTITION BY name ORDER BY event_id DESC) <= 4) SELECT name, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id DESC) AS \"window\", count(*) AS n FROM h GROUP BY name",
    ),
    "e04_skips": (
        lambda s, d: ev.skips(fx.journal(s, d)),
        prelude("journal") + ", b AS (SELECT *, lag(event_id) OVER (PARTITION BY name ORDER BY event_id) AS before FROM journal) SELECT name, event_id, coalesce(prev_id, -1) AS prev_id, coalesce(before, -1) AS before FROM b WHERE prev_id IS DISTINCT FROM before",
    ),
    "e06_transitions": (
        lambda s, d: fx.journal(s, d).withColumn("state", F.element_at(F.array(*map(F.lit, ev.STATES)), (F.col("name") % 5 + 1).cast("int"))).withColumnRenamed("kind", "verb").join(F.broadcast(ev.transitions(s)), ["state", "verb"]).groupBy("state", "verb", "outcome", "next_state").agg(F.count("*").alias("n")),
        prelude("journal") + ", " + machine_cells() + " SELECT m.state, m.verb, outcome, next_state, count(*) AS n FROM journal j JOIN m ON m.verb = j.kind AND m.state = ['live', 'stopped', 'released', 'readonly', 'importing'][j.name % 5 + 1] GROUP BY ALL",
    ),
    "e07_latest_record": (
        lambda s, d: ev.latest(fx.journal(s, d)),
        prelude("journal") + "SELECT name, max(event_id) AS event_id, arg_max(kind, event_id) AS kind, arg_max(stamp, event_id) AS stamp FROM journal GROUP BY name",
    ),
    "e08_lifecycle": (
        lambda s, d: ev.lifecycle(fx.journal(s, d), ev.transitions(s)),
        prelude("journal", recursive=True)
        + ", "
        + machine_cells()
        + """, o AS (SELECT name, kind, row_number() OVER (PARTITION BY name ORDER BY event_id) AS nth FROM journal), st(name, nth, state, p, r) AS (SELECT DISTINCT name, CAST(0 AS BIGINT), 'live', CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM journal UNION ALL
SELECT st.name, o.nth, m.next_state, p + CASE WHEN outcome = 'proceed' THEN 1 ELSE 0 END, r + CASE WHEN outcome = 'refuse' THEN 1 ELSE 0 END FROM st JOIN o ON o.name = st.name AND o.nth = st.nth + 1 JOIN m ON m.state = st.state AND m.verb = o.kind)
SELECT name, arg_max(state, nth) AS state, max(p) AS proceeded, max(r) AS refused, max(nth) AS events FROM st GROUP BY name""",
    ),
    "f01_forward_reads": (
        lambda s, d: fe.forward_reads(placed(s, d), fx.entries(s, d).where("entry_idx % 3 = 1 and kind in ('data', 'canonical_data')"), 9000),
        prelude("entries", recursive=True)
        + PLACED
        + """, t AS (SELECT segment_id, entry_idx AS target FROM entries WHERE entry_idx % 3 = 1 AND kind IN ('data', 'canonical_data')),
w(segment_id, target, pos, n, bytes, stop) AS (SELECT t.segment_id, target, target, CAST(1 AS BIGINT), e.stored_length, e.body_offset + e.stored_length FROM t JOIN placed e ON e.segment_id = t.segment_id AND e.entry_idx = target UNION ALL
SELECT w.segment_id, target, e.entry_idx, n + 1, bytes + e.stored_length, e.body_offset + e.stored_length FROM w JOIN placed e ON e.segment_id = w.segment_id AND e.entry_idx = w.pos + 1 WHERE NOT e.present AND e.kind IN ('data', 'canonical_data') AND e.body_offset = w.stop AND bytes + e.stored_length <= 9000)
SELECT segment_id, target, max(n) AS entries, max(bytes) AS bytes FROM w GROUP BY ALL""",
    ),
    "f02_warm_batches": (
        lambda s, d: fe.warm_batches(placed(s, d), 6000),
        prelude("entries", recursive=True)
        + PLACED
        + """, d AS (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY entry_idx) AS k FROM placed WHERE kind IN ('data', 'canonical_data') AND stored_length > 0),
w(segment_id, k, batch, first, stop) AS (SELECT DISTINCT segment_id, CAST(0 AS BIGINT), CAST(-1 AS BIGINT), CAST(0 AS BIGINT), CAST(-1 AS BIGINT) FROM d UNION ALL
SELECT w.segment_id, d.k, CASE WHEN present OR (stop = body_offset AND stop + stored_length - first <= 6000) THEN batch ELSE batch + 1 END,
  CASE WHEN present OR (stop = body_offset AND stop + stored_length - first <= 6000) THEN first ELSE body_offset END, CASE WHEN present THEN -1 ELSE body_offset + stored_length END
  FROM w JOIN d ON d.segment_id = w.segment_id AND d.k = w.k + 1)
SELECT w.segment_id, batch, min(entry_idx) AS first_entry, count(*) AS entries, CAST(sum(stored_length) AS BIGINT) AS bytes FROM w JOIN d USING (segment_id, k) WHERE NOT present GROUP BY ALL""",
    ),
    "f03_hint_bits": (
        lambda s, d: fe.hint_bits(ci.presence_words(fx.entries(s, d)), fx.entries(s, d).groupBy("segment_id").agg(F.count("*").alias("count"))),
        prelude("entries") + "SELECT segment_id, entry_idx FROM entries WHERE present",
    ),
    "f05_lease_overlap": (
        lambda s, d: fe.overlapping_leases(leases(s, d)),
        prelude("entries")
        + ", l AS (SELECT segment_id, entry_idx AS lease_id, start_lba % 50 AS f, start_lba % 50 + lba_length * 3 AS t FROM entries) SELECT a.segment_id, a.lease_id, b.lease_id AS other FROM l a JOIN l b ON a.segment_id = b.segment_id AND a.lease_id < b.lease_id AND a.f <= b.t AND b.f <= a.t",
    ),
    "f06_full_warm": (
        lambda s, d: fe.full_warm(fx.entries(s, d), iv.rebuild(fx.entries(s, d), fx.segments(s, d))),
        prelude("volmap") + "SELECT segment_id, count(*) AS entries, CAST(sum(stored_length) AS BIGINT) AS bytes FROM entries WHERE NOT present AND stored_length > 0 AND hash IN (SELECT hash FROM volmap) GROUP BY segment_id",
    ),
    "l09_walks_agree": (
        lambda s, d: li.walks_agree(fx.lineage(s, d)),
        prelude("lineage", recursive=True) + CLOSURE + " SELECT l.volume_id, count(u.id) AS ancestors, TRUE AS agree FROM lineage l LEFT JOIN up u ON u.id = l.volume_id GROUP BY 1",
    ),
    "l11_volume_listing": (
        lambda s, d: li.listing(volumes(s, d)),
        prelude("lineage")
        + """, v AS (SELECT volume_id, CASE WHEN role <> 'skeleton' THEN role || '-' || volume_id END AS name, role <> 'anchor' AS readonly FROM lineage), r AS (SELECT *, unnest(['all', 'readonly', 'writable']) AS filter FROM v),
k AS (SELECT * FROM r WHERE CASE WHEN name IS NOT NULL THEN filter = 'all' OR (filter = 'readonly') = readonly ELSE readonly AND filter <> 'writable' END)
SELECT filter, row_number() OVER (PARTITION BY filter ORDER BY name IS NULL, name, volume_id) AS place, coalesce(name, '-') AS name, volume_id FROM k""",
    ),
    "e05_time_consistency": (
        lambda s, d: ev.consistent_times(timed(s, d), sc.ulid_millis(F.col("ulid"))),
        prelude("journal") + "SELECT name, event_id, event_id % 9 <> 8 AS consistent FROM journal",
    ),
    "e07_name_store": (lambda s, d: ev.conditional(named_puts(s, d)), prelude("journal", recursive=True) + PUTS + " SELECT name, event_id, verb, outcome, version FROM st WHERE k > 0"),
    "k09_conditional_puts": (
        lambda s, d: ev.conditional(named_puts(s, d)).groupBy("name").agg(F.sum((F.col("outcome") == "ok").cast("long")).alias("done"), F.sum((F.col("outcome") != "ok").cast("long")).alias("refused"), F.max(F.struct("event_id", "version")).alias("last")).select("name", "done", "refused", F.col("last.version").alias("version")),
        prelude("journal", recursive=True) + PUTS + " SELECT name, count(*) FILTER (outcome = 'ok') AS done, count(*) FILTER (outcome <> 'ok') AS refused, arg_max(version, event_id) AS version FROM st WHERE k > 0 GROUP BY name",
    ),
    "f04_missing_indexes": (
        missing_indexes,
        prelude("entries", "segments", recursive=True)
        + sq.MANIFEST
        + """, chain(volume_id, layer, depth) AS (SELECT DISTINCT volume_id, volume_id, 0 FROM segments UNION ALL SELECT volume_id, (layer - 1) // 2, depth + 1 FROM chain WHERE layer > 0)
SELECT c.volume_id, c.layer, m.segment_id FROM chain c JOIN manifest m ON m.volume_id = c.layer WHERE m.segment_id NOT IN (SELECT segment_id FROM entries WHERE present)""",
    ),
}
