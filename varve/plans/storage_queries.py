"""Registered queries of stored segments, caches, snapshots, layers and rewrites, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from varve.operators import compaction as gc
from varve.operators import intervals as iv
from varve.operators import rewrite as rw
from varve.operators import snapshots as sn
from varve.plans import compaction_queries as cq
from varve.plans import fixtures as fx
from varve.plans import io_queries as io
from varve.plans.fixtures import prelude
from varve.sources import cache_format as cf
from varve.sources import segment_store as ss

#: Share of a volume's segments, in tenths, that its snapshot names.
SNAPSHOT = 6
INDEX = "segment_id, entry_idx, kind, hash, start_lba, lba_length"


def stored(s, d):
    """A folder with the segments of the entries, written by this query."""
    folder = io.shared(s, "segments")
    ss.write_segments(fx.entries(s, d), folder, fx.entry_bodies(s, d).select("segment_id", "entry_idx", "body"))
    return folder


def checked(s, d):
    """Entries of the segments whose index is as it was written; every thirteenth has been changed since."""
    folder = stored(s, d)
    spoiled = (F.col("segment_id") % 13 == 5) & (F.col("entry_idx") == 1)
    index = ss.read_index(s, folder).withColumn("hash", F.when(spoiled, F.lit(fx.ZERO_HASH + "0")).otherwise(F.col("hash")))
    return index.join(ss.intact(index, s.read.parquet(f"{folder}/marks")), "segment_id", "left_semi")


def verify_counts(s, d):
    """By tier: segments, bodies checked, what has no body or is not present, mismatches, and segments whose index can't be read."""
    folder = stored(s, d)
    tiers = fx.segments(s, d).select("segment_id", "tier", (F.col("segment_id") % 13 == 5).alias("broken"))
    rows = ss.read_index(s, folder).join(ss.read_bodies(s, folder), ["segment_id", "entry_idx"], "left").join(tiers, "segment_id").where("not broken")
    bodied, there = F.col("body").isNotNull(), F.col("present")
    bad = F.sha2("body", 256) != F.col("hash")
    count = lambda c: F.sum(c.cast("long"))
    found = rows.groupBy("tier").agg(F.countDistinct("segment_id").alias("segments"), count(bodied & there).alias("checked"), count(~bodied).alias("skipped_no_body"), count(bodied & ~there).alias("skipped_not_present"), count(bodied & there & bad).alias("mismatches"))
    errors = tiers.join(ss.read_index(s, folder).select("segment_id").distinct(), "segment_id", "left_semi").groupBy("tier").agg(count(F.col("broken")).alias("scan_errors"))
    return found.join(errors, "tier")


def promoted_counts(s, d):
    """A segment's parts as they are read back from where they were written."""
    folder, parts = stored(s, d), io.shared(s, "promoted")
    for name, part in zip(("index", "extents", "present"), ss.promoted(ss.read_index(s, folder)), strict=True):
        part.write.parquet(f"{parts}/{name}")
    part = lambda name: s.read.parquet(f"{parts}/{name}").groupBy("segment_id")
    found = part("index").agg(F.count("*").alias("index_rows"))
    found = found.join(part("extents").agg(F.count("*").alias("body_rows"), F.max(F.col("section_offset") + F.col("section_length")).alias("body_bytes")), "segment_id", "left")
    found = found.join(part("present").agg(F.sum(F.col("present").cast("long")).alias("present_rows")), "segment_id", "left")
    return found.fillna(0, ["body_rows", "body_bytes", "present_rows"])


def twice_drained(s, d):
    """Pending segments drained in two epochs, the second of which is run again as after a failure."""
    store = io.shared(s, "store")
    pending = fx.segments(s, d).where("tier = 'pending'").select("segment_id", "volume_id", "bytes")
    early = pending.where(F.col("segment_id") <= fx.segment_share(s, d, 5))
    for epoch, part in ((0, early), (1, pending), (1, pending)):
        ss.drain(part, store, epoch)
    return ss.drained(s, store).select("segment_id", "volume_id", "bytes", F.col("epoch").cast("long").alias("epoch"))


def caches(s, d):
    """Caches of the delta entries of every segment, in which every fourth file has lost its last three bytes."""
    rows = fx.entries(s, d).where("kind = 'delta'").select("segment_id", "entry_idx", F.col("hash").alias("body"))
    files = cf.encoded_caches(rows)
    return files.select("segment_id", F.when(F.col("segment_id") % 4 == 1, F.expr("substring(content, 1, length(content) - 3)")).otherwise(F.col("content")).alias("content"))


def read_through(s, d):
    """Every delta entry read twice through the caches: what the first round adds, the second one finds."""
    wanted = fx.entries(s, d).where("kind = 'delta'").select("segment_id", "entry_idx", F.col("hash").alias("body"))
    files = caches(s, d)
    first, added = cf.read_through(wanted.select("segment_id", "entry_idx"), files, wanted)
    more = cf.encoded_caches(added)
    tail = F.expr(f"substring(more, {len(cf.MAGIC) + 1})")
    whole = cf.parsed_caches(files).groupBy("segment_id").agg(F.max(F.col("record_offset") + cf.HEAD.size + F.col("stored_length")).alias("stop"))
    kept = files.join(whole, "segment_id", "left").select("segment_id", F.expr(f"substring(content, 1, cast(coalesce(stop, {len(cf.MAGIC)}) as int))").alias("content"))
    grown = kept.join(more.withColumnRenamed("content", "more"), "segment_id", "left").select("segment_id", F.when(F.col("more").isNull(), F.col("content")).otherwise(F.concat("content", tail)).alias("content"))
    second, _ = cf.read_through(wanted.select("segment_id", "entry_idx"), grown, wanted.limit(0))
    met = first.select("segment_id", "entry_idx", F.col("hit").alias("first_hit")).join(second.select("segment_id", "entry_idx", F.col("hit").alias("second_hit"), "body"), ["segment_id", "entry_idx"])
    return met


def parents(s, d):
    """Volumes as a tree of forks: the parent of a volume is half of it."""
    v = fx.segments(s, d).select("volume_id").distinct()
    return v.select("volume_id", F.when(F.col("volume_id") > 0, F.floor((F.col("volume_id") - 1) / 2)).alias("parent_id"))


def manifest(s, d):
    g = fx.segments(s, d)
    return sn.manifests(g, sn.cuts(g, SNAPSHOT))


def stored_manifests(s, d):
    """Manifests written as tables and read back, with a hash over each."""
    folder = io.shared(s, "manifests")
    manifest(s, d).write.parquet(folder)
    return sn.manifest_lines(s.read.parquet(folder))


MANIFEST = f""", cuts AS (SELECT volume_id, segment_id AS cut FROM (SELECT volume_id, segment_id, row_number() OVER (PARTITION BY volume_id ORDER BY segment_id) AS k, count(*) OVER (PARTITION BY volume_id) AS n FROM segments) WHERE k = greatest(1, n * {SNAPSHOT} // 10)),
manifest AS (SELECT s.volume_id, s.segment_id FROM segments s JOIN cuts USING (volume_id) WHERE s.tier <> 'pending' AND s.segment_id <= cut)"""


def volume_wal(s, d):
    """The write log dealt to the volumes, in their address space."""
    w = fx.wal(s, d)
    return w.select((F.col("wal_id") % fx.volumes(s, d)).alias("volume_id"), "wal_id", "seq", (F.col("start_lba") % fx.volume_space(s, d)).alias("start_lba"), "lba_length", "hash")


LIVE_MAP = f""", vwal AS (SELECT wal_id % {fx.VOLUMES_SQL} AS volume_id, wal_id, seq, start_lba % {fx.VOLUME_SPACE_SQL} AS start_lba, lba_length, hash FROM wal),
wtop AS (SELECT * FROM (SELECT *, unnest(range(start_lba, start_lba + lba_length)) AS lba FROM vwal) QUALIFY row_number() OVER (PARTITION BY volume_id, lba ORDER BY wal_id DESC, seq DESC) = 1),
lmap AS (SELECT coalesce(t.volume_id, f.volume_id) AS volume_id, coalesce(t.lba, f.lba) AS lba, CASE WHEN t.lba IS NULL THEN f.w.s ELSE t.start_lba END AS start_lba, CASE WHEN t.lba IS NULL THEN 'segment' ELSE 'wal' END AS source,
  coalesce(t.wal_id, f.w.c) AS claimant, coalesce(t.seq, f.w.i) AS entry_idx, coalesce(t.hash, f.w.h) AS hash FROM wtop t FULL JOIN folded f ON f.volume_id = t.volume_id AND f.lba = t.lba)"""


def image_layers(s, d):
    """Layers of images, one for each language: files of four layers, some written again, some removed above, some directories emptied."""
    f = fx.files(s, d)
    layer = (F.col("file_id") % 3).cast("long")
    base = f.select(F.col("path"), "hash", layer.alias("layer"), "file_id")
    image = F.element_at(F.split("path", "/"), 3)
    again = base.where("file_id % 5 = 0").select("path", F.sha2(F.concat("hash", F.lit("+")), 256).alias("hash"), F.lit(3).cast("long").alias("layer"), "file_id")
    files = base.unionByName(again).select(image.alias("image"), "layer", "path", "hash", F.lit(False).alias("whiteout"), F.lit(False).alias("opaque"))
    gone = base.where("file_id % 7 = 2").select(image.alias("image"), (F.col("layer") + 1).alias("layer"), "path", F.lit("").alias("hash"), F.lit(True).alias("whiteout"), F.lit(False).alias("opaque"))
    directory = F.regexp_replace("path", "/[^/]*$", "")
    emptied = base.where("file_id % 100 = 50").select(image.alias("image"), F.lit(2).cast("long").alias("layer"), directory.alias("path"), F.lit("").alias("hash"), F.lit(False).alias("whiteout"), F.lit(True).alias("opaque"))
    return files.unionByName(gone).unionByName(emptied)


LAYERS = """, base AS (SELECT path, string_split(path, '/')[3] AS image, hash, file_id % 3 AS layer, file_id FROM files),
lay AS (SELECT image, layer, path, hash, FALSE AS whiteout FROM base UNION ALL SELECT image, 3, path, sha256(hash || '+'), FALSE FROM base WHERE file_id % 5 = 0 UNION ALL SELECT image, layer + 1, path, '', TRUE FROM base WHERE file_id % 7 = 2),
emptied AS (SELECT DISTINCT image, regexp_replace(path, '/[^/]*$', '') AS dir FROM base WHERE file_id % 100 = 50),
top AS (SELECT * FROM lay QUALIFY row_number() OVER (PARTITION BY image, path ORDER BY layer DESC, whiteout DESC, hash DESC) = 1)"""


def plan_outputs(s, d):
    """The output entries of a pass's plan, made from bodies of which some are damaged and some are gone."""
    return rw.materialised(cq.plan(s, d), fx.entries(s, d), fx.block_bodies(s, d), fx.ZERO_HASH)


#: The plan, its entries and bodies, and each record's output entry.
OUTPUTS_SQL = (
    "WITH plan AS ("
    + cq.QUERIES["g10_plan"][1]
    + "), "
    + fx.SQL["entries"]
    + ", "
    + fx.SQL["block_bodies"]
    + f""", made AS (SELECT p.segment_id, p.entry_idx, p.op, p.segment_id + {rw.FRESH} AS output_id, CASE WHEN p.op = 'run' THEN 'data' WHEN p.op = 'zero_split' THEN 'zero' WHEN p.op = 'canonical' AND NOT starts_with(e.kind, 'canonical_') THEN 'canonical_' || e.kind ELSE e.kind END AS kind,
  CASE WHEN p.op = 'run' THEN sha256(substr(b.body, p.payload_block_offset * {rw.BLOCK} + 1, p.lba_length * {rw.BLOCK})) WHEN p.op = 'zero_split' THEN repeat('0', 64) ELSE e.hash END AS hash,
  CASE WHEN p.op IN ('run', 'zero_split') THEN p.start_lba WHEN p.op = 'canonical' THEN 0 ELSE e.start_lba END AS start_lba, CASE WHEN p.op IN ('run', 'zero_split') THEN p.lba_length WHEN p.op = 'canonical' THEN 0 ELSE e.lba_length END AS lba_length,
  CASE WHEN NOT (p.op = 'run' OR (p.op IN ('keep', 'canonical') AND e.kind IN ('data', 'inline', 'canonical_data', 'canonical_inline'))) THEN 'ok' WHEN b.segment_id IS NULL THEN 'cancelled' WHEN b.sound THEN 'ok' ELSE 'io_error' END AS state
  FROM plan p JOIN entries e USING (segment_id, entry_idx) LEFT JOIN block_bodies b ON b.segment_id = p.segment_id AND b.entry_idx = p.entry_idx WHERE p.op <> 'drop'),
good AS (SELECT * FROM made WHERE segment_id NOT IN (SELECT segment_id FROM made WHERE state <> 'ok')),
ins AS (SELECT DISTINCT segment_id FROM plan WHERE segment_id NOT IN (SELECT segment_id FROM made WHERE state <> 'ok'))"""
)


def with_outputs(*names: str) -> str:
    """``OUTPUTS_SQL`` after what ``names`` need; the plan's own expressions are its own."""
    return prelude(*names) + ", " + OUTPUTS_SQL.removeprefix("WITH ").replace(", " + fx.SQL["entries"], "", 1)


def applied_map(s, d):
    """The live map after the pass's outputs, with the log's writes in between."""
    e, g, parts = fx.entries(s, d), fx.segments(s, d), fx.parts(s, d)
    plan = gc.planned(e, g, iv.rebuilt(e, g, parts), parts)
    return rw.live_after(e, g, volume_wal(s, d), plan, fx.block_bodies(s, d), fx.ZERO_HASH, parts)


def applied_owners(s, d):
    e, g, parts = fx.entries(s, d), fx.segments(s, d), fx.parts(s, d)
    volmap = iv.rebuilt(e, g, parts)
    known = gc.known(e, g, volmap, parts)
    plan = gc.planned(e, g, volmap, parts, known)
    return rw.owners_after(e, known, plan, fx.block_bodies(s, d), fx.ZERO_HASH, parts)


QUERIES = {
    "s03_index_scan": (lambda s, d: ss.read_index(s, stored(s, d)).select(*INDEX.split(", ")), prelude("entries") + f"SELECT {INDEX} FROM entries"),
    "s04_checked_index_scan": (lambda s, d: checked(s, d).select(*INDEX.split(", ")), prelude("entries") + f"SELECT {INDEX} FROM entries WHERE segment_id % 13 <> 5"),
    "s13_snapshot_open": (
        lambda s, d: sn.open_snapshot(fx.entries(s, d), manifest(s, d), sn.layers(parents(s, d))),
        prelude("entries", "segments", recursive=True)
        + MANIFEST
        + """, chain(volume_id, layer, depth) AS (SELECT DISTINCT volume_id, volume_id, 0 FROM segments UNION ALL SELECT volume_id, (layer - 1) // 2, depth + 1 FROM chain WHERE layer > 0),
b AS (SELECT c.volume_id, c.depth, e.segment_id, e.entry_idx, e.hash, e.start_lba, unnest(range(e.start_lba, e.start_lba + e.lba_length)) AS lba FROM chain c JOIN manifest m ON m.volume_id = c.layer JOIN entries e USING (segment_id) WHERE e.kind NOT LIKE 'canonical%'),
t AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY volume_id, lba ORDER BY depth, segment_id DESC, entry_idx DESC) = 1),
i AS (SELECT *, lba - row_number() OVER (PARTITION BY volume_id, segment_id, entry_idx ORDER BY lba) AS g FROM t)
SELECT volume_id, min(lba) AS start_lba, count(*) AS lba_length, min(lba) - any_value(start_lba) AS payload_block_offset, any_value(hash) AS hash, segment_id AS claimant, entry_idx FROM i GROUP BY volume_id, segment_id, entry_idx, g""",
    ),
    "s14_live_open": (
        lambda s, d: sn.open_live(fx.entries(s, d), fx.segments(s, d), volume_wal(s, d), fx.parts(s, d)),
        prelude("volmap", "wal")
        + LIVE_MAP
        + """, i AS (SELECT *, lba - row_number() OVER (PARTITION BY volume_id, source, claimant, entry_idx ORDER BY lba) AS g FROM lmap)
SELECT volume_id, min(lba) AS start_lba, count(*) AS lba_length, min(lba) - any_value(start_lba) AS payload_block_offset, source, claimant, entry_idx, any_value(hash) AS hash FROM i GROUP BY volume_id, source, claimant, entry_idx, g""",
    ),
    "s24_damaged_scan": (
        lambda s, d: cf.parsed_caches(caches(s, d)).select("segment_id", "entry_idx", "record_offset", "stored_length", "is_truncated"),
        prelude("entries")
        + f""", r AS (SELECT segment_id, entry_idx, {len(cf.MAGIC)} + (row_number() OVER (PARTITION BY segment_id ORDER BY entry_idx) - 1) * {cf.HEAD.size + 64} AS record_offset, CAST(64 AS BIGINT) AS stored_length, max(entry_idx) OVER (PARTITION BY segment_id) AS last FROM entries WHERE kind = 'delta')
SELECT segment_id, entry_idx, record_offset, stored_length, segment_id % 4 = 1 AS is_truncated FROM r WHERE NOT (segment_id % 4 = 1 AND entry_idx = last)""",
    ),
    "r06_cache_read_through": (
        read_through,
        prelude("entries")
        + ", r AS (SELECT *, max(entry_idx) OVER (PARTITION BY segment_id) AS last FROM entries WHERE kind = 'delta') SELECT segment_id, entry_idx, NOT (segment_id % 4 = 1 AND entry_idx = last) AS first_hit, TRUE AS second_hit, hash AS body FROM r",
    ),
    "r08_verify_counts": (
        verify_counts,
        prelude("entries", "segments", "entry_bodies")
        + """, t AS (SELECT s.tier, s.segment_id, s.segment_id % 13 = 5 AS broken, e.present, e.hash, b.body FROM segments s JOIN entries e USING (segment_id) LEFT JOIN entry_bodies b ON b.segment_id = e.segment_id AND b.entry_idx = e.entry_idx)
SELECT tier, count(DISTINCT segment_id) FILTER (NOT broken) AS segments, count(*) FILTER (NOT broken AND body IS NOT NULL AND present) AS checked, count(*) FILTER (NOT broken AND body IS NULL) AS skipped_no_body, count(*) FILTER (NOT broken AND body IS NOT NULL AND NOT present) AS skipped_not_present,
count(*) FILTER (NOT broken AND body IS NOT NULL AND present AND sha256(body) <> hash) AS mismatches, count(DISTINCT segment_id) FILTER (broken) AS scan_errors FROM t GROUP BY tier""",
    ),
    "k02_body_offsets": (
        lambda s, d: ss.read_index(s, stored(s, d)).select("segment_id", "entry_idx", "section", "section_offset", "section_length"),
        prelude("entries")
        + """, x AS (SELECT *, CASE WHEN kind IN ('data', 'canonical_data') THEN 'body' WHEN kind IN ('inline', 'delta') THEN kind ELSE 'none' END AS section FROM entries),
y AS (SELECT *, CAST(CASE section WHEN 'delta' THEN delta_length WHEN 'none' THEN 0 ELSE stored_length END AS BIGINT) AS section_length FROM x)
SELECT segment_id, entry_idx, section, CAST(coalesce(sum(section_length) OVER (PARTITION BY segment_id, section ORDER BY entry_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS section_offset, section_length FROM y""",
    ),
    "k04_promote_split": (
        promoted_counts,
        prelude("entries")
        + "SELECT segment_id, count(*) AS index_rows, count(*) FILTER (kind IN ('data', 'canonical_data') AND stored_length > 0) AS body_rows, CAST(coalesce(sum(stored_length) FILTER (kind IN ('data', 'canonical_data')), 0) AS BIGINT) AS body_bytes, count(*) FILTER (kind IN ('data', 'canonical_data') AND present) AS present_rows FROM entries GROUP BY segment_id",
    ),
    "k08_drain": (
        twice_drained,
        prelude("segments") + f"SELECT segment_id, volume_id, bytes, CAST(CASE WHEN segment_id <= {fx.segment_share_sql(5)} THEN 0 ELSE 1 END AS BIGINT) AS epoch FROM segments WHERE tier = 'pending'",
    ),
    "k10_snapshot_manifest": (
        stored_manifests,
        prelude("segments") + MANIFEST + ", m AS (SELECT volume_id, string_agg(CAST(segment_id AS VARCHAR), chr(10) ORDER BY segment_id) AS body FROM manifest GROUP BY volume_id) SELECT volume_id, sha256(body) AS manifest, CAST(length(body) AS BIGINT) AS bytes FROM m",
    ),
    "s29_layer_merge": (
        lambda s, d: sn.merged_layers(image_layers(s, d)),
        prelude("files") + LAYERS + " SELECT image, path, layer, hash FROM top t WHERE NOT whiteout AND NOT EXISTS (SELECT 1 FROM emptied e WHERE e.image = t.image AND e.dir = regexp_replace(t.path, '/[^/]*$', '') AND t.layer < 2)",
    ),
    "g12_materialise": (plan_outputs, OUTPUTS_SQL + " SELECT * FROM made"),
    "g13_apply": (
        applied_map,
        with_outputs("volmap", "wal")
        + LIVE_MAP
        + """, claims_out AS (SELECT s.volume_id, g.segment_id, g.output_id, g.hash, unnest(range(g.start_lba, g.start_lba + g.lba_length)) AS lba FROM good g JOIN segments s USING (segment_id) WHERE g.lba_length > 0)
SELECT l.volume_id, l.lba, l.source, coalesce(o.output_id, l.claimant) AS claimant, coalesce(o.hash, l.hash) AS hash, o.output_id IS NOT NULL AS moved FROM lmap l LEFT JOIN claims_out o ON l.source = 'segment' AND o.volume_id = l.volume_id AND o.lba = l.lba AND o.segment_id = l.claimant""",
    ),
    "g13_apply_owners": (
        applied_owners,
        with_outputs("owners")
        + f""", car AS (SELECT hash, min(output_id) AS least, list(DISTINCT segment_id) AS seg FROM good WHERE kind IN ('data', 'inline', 'delta', 'canonical_data', 'canonical_inline', 'canonical_delta') GROUP BY hash),
j AS (SELECT coalesce(o.hash, c.hash) AS hash, o.segment_id AS old, c.least, c.seg, o.segment_id IN (SELECT segment_id FROM ins) AS consumed FROM owners o FULL JOIN car c ON c.hash = o.hash),
k AS (SELECT *, CASE WHEN old IS NULL THEN 'new' WHEN coalesce(list_contains(seg, old), FALSE) THEN 'rekeyed' WHEN consumed AND seg IS NULL THEN 'removed' WHEN consumed THEN 'taken' ELSE 'kept' END AS change FROM j)
SELECT hash, CASE change WHEN 'rekeyed' THEN old + {rw.FRESH} WHEN 'new' THEN least WHEN 'taken' THEN least WHEN 'removed' THEN -1 ELSE old END AS owner, change FROM k""",
    ),
}
