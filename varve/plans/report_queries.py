"""Registered queries of reports, similarity and scalar functions, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from varve.functions import scalars as sc
from varve.functions import sketches as sk
from varve.operators import compaction as gc
from varve.operators import content_index as ci
from varve.operators import intervals as iv
from varve.operators import read_path as rp
from varve.operators import reports as re
from varve.operators import similarity as si
from varve.plans import compaction_queries as cq
from varve.plans import fixtures as fx
from varve.plans import io_queries as io
from varve.plans.fixtures import prelude

AGE = "CASE WHEN secs < 60 THEN '1m' WHEN secs < 300 THEN '5m' WHEN secs < 900 THEN '15m' WHEN secs < 3600 THEN '1h' WHEN secs < 21600 THEN '6h' WHEN secs < 86400 THEN '24h' ELSE 'older' END"


def aged(s, d):
    return cq.stats(s, d).withColumn("age", re.age_bucket((F.col("segment_id") * 13) % 100_000))


AGED = f", aged AS (SELECT *, {AGE} AS age FROM (SELECT *, (segment_id * 13) % 100000 AS secs FROM stats))"


def marks(s, d):
    """Resemblance sketches of all files' whole bodies."""
    f = fx.files(s, d)
    return f.select(F.col("file_id").alias("source_id"), F.col("file_id").alias("target_id"), "hash", sk.sketch_column(F.col("body").cast("binary"), least_bytes=LEAST).alias("sketch"))


#: Bytes from which a body has a sketch here; the files of these tables are smaller than those of a disk.
LEAST = 1024


def index_and_sketches(s, d):
    """Owners of all contents and the postings of their sketches from one pass over the bodies."""
    f = fx.files(s, d).select("file_id", "hash", "bytes", sk.sketch_column(F.col("body").cast("binary"), least_bytes=LEAST).alias("sketch"))
    folder = io.shared(s, "rebuild")
    f.groupBy("hash").agg(F.min(F.struct("file_id", "bytes", "sketch")).alias("o")).select("hash", F.col("o.file_id").alias("source_id"), "o.bytes", "o.sketch").write.parquet(folder)
    owned = s.read.parquet(folder)  # bodies are hashed and sketched once, for both outputs
    listed = si.postings(owned).groupBy("source_id").agg(F.count("*").alias("postings"))
    return owned.join(listed, "source_id", "left").select("hash", "source_id", "bytes", F.col("sketch").isNotNull().alias("sketched"), F.coalesce("postings", F.lit(0)).alias("postings"))


def fragments(s, d, side):
    """Files as fragments of 1000 code points."""
    t = rp.chunk_table(fx.image(s, d, side).select("path", "body"), 1000, key="path")
    return t.select("path", F.col("offset").alias("file_offset"), F.col("length").alias("byte_count"), "hash")


def fragment_sql(side):
    return f"""frag_{side} AS (SELECT path, chunk * 1000 AS file_offset, CAST(length(substr(body, chunk * 1000 + 1, 1000)) AS BIGINT) AS byte_count, sha256(substr(body, chunk * 1000 + 1, 1000)) AS hash
  FROM (SELECT path, body, unnest(range(0, CAST(ceil(length(body) / 1000.0) AS BIGINT))) AS chunk FROM image_{side} WHERE length(body) > 0))"""


def changed_pairs(s, d):
    a, b = fx.image(s, d, "a"), fx.image(s, d, "b")
    met = b.join(a.select("path", F.col("body").alias("old"), F.col("hash").alias("old_hash")), "path").where("hash <> old_hash")
    raw = met.select("path", "bytes", F.col("body").cast("binary").alias("new"), F.col("old").cast("binary").alias("old"))
    return raw.select("path", "bytes", sk.compressed_length(F.col("new"), 3).alias("stored"), sk.compressed_length(F.col("new"), 9).alias("plain"), sk.delta_length(F.col("old"), F.col("new"), 3).alias("delta"))


def resemblance(s, d):
    """The resemblance tier: the first usable candidate of each body of the newer image, and whether its delta is kept."""
    new, old = fx.image(s, d, "b").where(F.col("bytes") >= LEAST), fx.image(s, d, "a").where(F.col("bytes") >= LEAST)
    cut = lambda t, name: t.select(F.col("file_id").alias(name), "hash", sk.sketch_column(F.col("body").cast("binary"), least_bytes=LEAST).alias("sketch"))
    found = si.candidates(cut(new, "target_id"), si.postings(cut(old, "source_id")))
    # what the newer image still holds is referenced; same-path sources are taken by an earlier tier
    reserved = old.join(new.select("path", F.col("hash").alias("h")), "path").where("hash <> h").select("hash")
    best = si.chosen_sources(found, new.select(F.col("file_id").alias("target_id"), F.col("hash").alias("own")), fx.image(s, d, "b"), reserved)
    raw = lambda t, name, body: t.select(F.col("file_id").alias(name), F.col("body").cast("binary").alias(body))
    met = best.join(raw(new, "target_id", "new"), "target_id").join(raw(old, "source_id", "old"), "source_id")
    sized = met.select("target_id", "source_id", "shared", sk.compressed_length(F.col("new"), 3).alias("stored"), sk.compressed_length(F.col("new"), 9).alias("plain"), sk.delta_length(F.col("old"), F.col("new")).alias("delta"))
    return sized.withColumn("kept", sk.worth_storing(F.col("delta"), F.col("stored"), F.col("plain")))


def cold_boot(s, d):
    """Reads of a boot by what the older image has of them: exact, changed, new, or not mapped by the newer image.

    The trace reads every file of either image, in the newer image's place.
    """
    a, b = fx.image(s, d, "a"), fx.image(s, d, "b")
    trace = a.select("path").union(b.select("path")).distinct()
    met = trace.join(b.select("path", "hash", "bytes"), "path", "left").join(a.select("path", F.col("hash").alias("old")), "path", "left").join(a.select("hash", F.lit(True).alias("held")).distinct(), "hash", "left")
    kind = F.when(F.col("hash").isNull(), "unmapped").when(F.col("held"), "exact").when(F.col("old").isNotNull(), "changed").otherwise("new")
    return met.select("path", "hash", "bytes", kind.alias("class"))


def boot_strategies(s, d):
    """Bytes that a warm and a cold boot fetch: compressed, with unchanged blocks left out, with deltas, with both.

    No fetch is above the body itself. A cold boot adds exact files uncompressed.
    """
    reads = cold_boot(s, d).join(fx.image(s, d, "b").select("path", F.col("body").alias("new")), "path", "left").join(fx.image(s, d, "a").select("path", F.col("body").alias("old")), "path", "left")
    raw = lambda c: F.col(c).cast("binary")
    size = 512
    cuts = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length("new") / size).cast("int") - 1, F.lit(0))), lambda i: F.when(F.substring("new", i * size + 1, F.lit(size)) != F.substring("old", i * size + 1, F.lit(size)), F.substring("new", i * size + 1, F.lit(size))).otherwise(""))
    rows = reads.where("class in ('exact', 'changed', 'new')").select("class", "bytes", raw("new").alias("new"), F.when(F.col("class") == "changed", raw("old")).alias("old"), F.when(F.col("class") == "changed", F.array_join(cuts, "").cast("binary")).alias("sparse"))
    capped = lambda c: F.least(c, F.col("bytes"))
    rows = rows.select("class", "bytes", sk.compressed_length(F.col("new"), 3).alias("z"), sk.compressed_length(F.col("sparse"), 3).alias("sp"), sk.delta_length(F.col("old"), F.col("new")).alias("dl"), sk.delta_length(F.col("old"), F.col("sparse")).alias("both"))
    rows = rows.select("class", "bytes", capped(F.col("z")).alias("zstd"), capped(F.coalesce("sp", "z")).alias("sparse"), capped(F.coalesce("dl", "z")).alias("delta"), capped(F.least(F.coalesce("both", "z"), F.coalesce("sp", "z"), F.coalesce("dl", "z"))).alias("both"))
    kinds = ("zstd", "sparse", "delta", "both")
    warm = rows.where("class <> 'exact'").agg(F.lit("warm").alias("boot"), *(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in kinds))
    cold = rows.agg(F.lit("cold").alias("boot"), *(F.coalesce(F.sum(F.when(F.col("class") == "exact", F.col("bytes")).otherwise(F.col(k))), F.lit(0)).alias(k) for k in kinds))
    return warm.unionByName(cold)


def delta_simulation(s, d):
    """Changed and new files of the newer image by tier: same path, then resemblance, then alone; with what each tier stores."""
    a, b = fx.image(s, d, "a"), fx.image(s, d, "b")
    fresh = b.join(a.select("hash").distinct(), "hash", "left_anti")
    same = a.select("path", F.col("body").alias("same"))
    alike = resemblance(s, d).where("kept").select(F.col("target_id").alias("file_id"), F.col("delta").alias("by_likeness"))
    raw = lambda c: F.col(c).cast("binary")
    rows = fresh.join(same, "path", "left").join(alike, "file_id", "left")
    rows = rows.select("bytes", "by_likeness", sk.compressed_length(raw("body"), 3).alias("stored"), sk.compressed_length(raw("body"), 9).alias("plain"), sk.delta_length(raw("same"), raw("body")).alias("by_path"))
    path_wins = F.coalesce(sk.worth_storing(F.col("by_path"), F.col("stored"), F.col("plain")), F.lit(False))
    tier = F.when(path_wins, "same_path").when(F.col("by_likeness").isNotNull(), "resemblance").otherwise("alone")
    best = F.least("stored", "by_path", "by_likeness")
    size = F.when(tier == "same_path", F.col("by_path")).when(tier == "resemblance", F.col("by_likeness")).otherwise(F.col("stored"))
    rows = rows.select(tier.alias("tier"), re.power_bucket(F.col("bytes")).alias("bucket"), "bytes", "stored", size.alias("with_deltas"), best.alias("oracle"))
    return rows.groupBy("tier", "bucket").agg(F.count("*").alias("files"), *(F.sum(c).alias(c) for c in ("bytes", "stored", "with_deltas", "oracle")))


def codec_study(s, d):
    """By size bucket: bytes under three codecs, where the fast one wins and by how much, and in chunks of four sizes."""
    f = fx.files(s, d).withColumn("raw", F.col("body").cast("binary"))
    chunked = [sk.chunked_length(F.col("raw"), n, 3).alias(f"chunks_{n}") for n in CHUNKS]
    rows = f.select("bytes", sk.compressed_length(F.col("raw"), 1).alias("fast"), sk.compressed_length(F.col("raw"), 3).alias("mid"), sk.compressed_length(F.col("raw"), 9).alias("high"), *chunked)
    sums = [F.sum(c).alias(c) for c in ("bytes", "fast", "mid", "high", *(f"chunks_{n}" for n in CHUNKS))]
    return rows.groupBy(re.power_bucket(F.col("bytes")).alias("bucket")).agg(F.count("*").alias("bodies"), *sums, F.sum((F.col("fast") <= F.col("mid")).cast("long")).alias("fast_wins"), F.sum(F.greatest(F.col("mid") - F.col("fast"), F.lit(0))).alias("fast_margin"))


#: Chunk sizes of the codec study.
CHUNKS = (256, 1024, 4096, 16384)


def same_place(s, d):
    """Writes after a snapshot in the middle of the log, and what the snapshot has in their place."""
    w, cut = fx.wal(s, d), fx.log_share(s, d, 5)
    late = w.where(F.col("wal_id") > cut).select(F.col("seq").alias("entry_id"), "start_lba", "lba_length", "kind", "hash")
    return si.same_place_sources(late, iv.blocks(iv.overlay(w.where(F.col("wal_id") <= cut))).select("lba", "hash"), w.where("kind = 'data'"))


WAITS_SQL = "waits AS (SELECT event_type AS site, CAST(floor(abs(value) * 100) AS BIGINT) AS millis FROM events)"


def waits(s, d):
    return fx.read(s, d, "events").select(F.col("event_type").alias("site"), F.floor(F.abs("value") * 100).cast("long").alias("millis"))


def bloat_not_packed(s, d):
    """Bodies with dead blocks in segments that a pass does not rewrite."""
    e, g, parts = fx.entries(s, d), fx.segments(s, d), fx.parts(s, d)
    held = iv.rebuilt(e, g, parts)
    known = gc.known(e, g, held, parts)
    reach = gc.reached(e, held, parts)
    chosen = gc.candidates(gc.classified(e, g, held, parts, gc.segment_stats, known))
    return gc.bloated_elsewhere(e, reach, known, chosen)


QUERIES = {
    "a04_density_census": (
        lambda s, d: re.density_census(aged(s, d)),
        prelude("stats")
        + AGED
        + """ SELECT pool, coalesce(age, 'all') AS age, count(*) AS segments, count(*) FILTER (density = 0) AS fully_dead, CAST(sum(total_bytes) AS BIGINT) AS bytes, round(avg(density), 6) AS mean_density, min(density) AS least_density FROM aged GROUP BY ROLLUP (pool, age) HAVING pool IS NOT NULL""",
    ),
    "a05_pass_summary": (
        lambda s, d: gc.candidates(cq.stats(s, d)).agg(F.count("*").alias("candidates"), F.sum("reclaimable_bytes").alias("bytes_freed"), F.sum((F.col("pool") == "tombstone").cast("long")).alias("dead_cleaned")),
        prelude("stats") + f"SELECT count(*) AS candidates, CAST(sum(reclaimable_bytes) AS BIGINT) AS bytes_freed, count(*) FILTER (pool = 'tombstone') AS dead_cleaned FROM stats WHERE {cq.PAYS}",
    ),
    "a07_bloat_not_packed": (
        bloat_not_packed,
        prelude("stats")
        + f""", t AS (SELECT hash, greatest(max(payload_block_offset + lba_length) - CAST(sum(lba_length) AS BIGINT), 0) AS dead_blocks FROM volmap GROUP BY hash)
SELECT t.hash, dead_blocks FROM t JOIN owners o ON o.hash = t.hash AND o.kind <> 'inline' WHERE dead_blocks >= 1 AND o.segment_id NOT IN (SELECT segment_id FROM stats WHERE {cq.PAYS})""",
    ),
    "a09_funnel": (
        lambda s, d: re.funnel(fx.entries(s, d), 1000),
        prelude("entries")
        + "SELECT CAST(pow(2, CASE WHEN stored_length <= 1 THEN 0 ELSE length(bin(stored_length - 1)) END) AS BIGINT) AS bucket, count(*) AS n, CAST(sum(stored_length) AS BIGINT) AS bytes, count(*) FILTER (stored_length >= 1000) AS eligible, count(*) FILTER (kind LIKE 'canonical%') AS canonical FROM entries WHERE stored_length > 0 GROUP BY 1",
    ),
    "s23_capped_load": (
        lambda s, d: re.capped_load(fx.entries(s, d).where("kind = 'data' and not journal and stored_length > 0"), ["segment_id", "entry_idx"], "stored_length", 3_000_000).select("segment_id", "entry_idx", "before"),
        prelude("entries")
        + ", b AS (SELECT segment_id, entry_idx, CAST(coalesce(sum(stored_length) OVER (ORDER BY segment_id, entry_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM entries WHERE kind = 'data' AND NOT journal AND stored_length > 0) SELECT * FROM b WHERE before < 3000000",
    ),
    "a11_chunk_cost": (
        lambda s, d: rp.chunk_table(fx.files(s, d), 1000).groupBy("file_id").agg(F.count("*").alias("chunks"), (F.lit(4) + 36 * F.count("*") + F.sum("length")).alias("stored"), F.sum(F.col("length") * F.col("length")).alias("decode_cost")),
        prelude("files")
        + ", c AS (SELECT file_id, CAST(length(substr(body, chunk * 1000 + 1, 1000)) AS BIGINT) AS n FROM (SELECT file_id, body, unnest(range(0, CAST(ceil(length(body) / 1000.0) AS BIGINT))) AS chunk FROM files WHERE length(body) > 0)) SELECT file_id, count(*) AS chunks, CAST(4 + 36 * count(*) + sum(n) AS BIGINT) AS stored, CAST(sum(n * n) AS BIGINT) AS decode_cost FROM c GROUP BY file_id",
    ),
    "a13_rewrite_chains": (
        lambda s, d: re.rewrite_chains(fx.entries(s, d), 1000),
        prelude("entries")
        + """, o AS (SELECT *, lag(hash) OVER (PARTITION BY volume_id, start_lba ORDER BY segment_id, entry_idx) AS prior FROM entries WHERE lba_length > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY volume_id, start_lba ORDER BY segment_id, entry_idx) AS nth FROM o WHERE prior IS NULL OR prior <> hash)
SELECT volume_id, start_lba, count(*) AS length FROM k GROUP BY ALL HAVING count(*) >= 2 AND max(CASE WHEN nth = 1 THEN stored_length END) >= 1000""",
    ),
    "a14_chain_histogram": (
        lambda s, d: re.chain_histogram(re.rewrite_chains(fx.entries(s, d), 0)),
        prelude("entries")
        + """, o AS (SELECT *, lag(hash) OVER (PARTITION BY volume_id, start_lba ORDER BY segment_id, entry_idx) AS prior FROM entries WHERE lba_length > 0),
k AS (SELECT volume_id, start_lba, count(*) AS n FROM o WHERE prior IS NULL OR prior <> hash GROUP BY ALL HAVING count(*) >= 2) SELECT least(n, 16) AS length, count(*) AS chains FROM k GROUP BY 1""",
    ),
    "a15_image_overlap": (
        lambda s, d: re.overlap(fx.image(s, d, "a"), fx.image(s, d, "b")),
        prelude("image_a", "image_b")
        + """, x AS (SELECT hash, max(bytes) AS bytes FROM image_a GROUP BY hash), y AS (SELECT DISTINCT hash FROM image_b)
SELECT (SELECT count(*) FROM x) AS unique_a, (SELECT count(*) FROM y) AS unique_b, count(*) AS common, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS common_bytes, count(*) / CAST((SELECT count(*) FROM x) AS DOUBLE) AS share_a, count(*) / CAST((SELECT count(*) FROM y) AS DOUBLE) AS share_b FROM x JOIN y USING (hash)""",
    ),
    "a16_file_classes": (
        lambda s, d: re.class_totals(re.file_classes(fx.image(s, d, "a"), fx.image(s, d, "b"))),
        prelude("image_a", "image_b")
        + """, m AS (SELECT CASE WHEN a.hash IS NULL THEN 'new' WHEN b.hash IS NULL THEN 'removed' WHEN a.hash = b.hash THEN 'exact' ELSE 'changed' END AS class, coalesce(b.bytes, a.bytes) AS bytes FROM image_a a FULL JOIN image_b b ON a.path = b.path) SELECT class, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes FROM m GROUP BY class""",
    ),
    "a16_delta_savings": (lambda s, d: changed_pairs(s, d).groupBy(F.least(F.floor((1 - F.col("delta") / F.col("stored")) * 5), F.lit(4)).alias("saving_fifth")).agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.sum("delta").alias("delta_bytes")), None),
    "a17_renames": (
        lambda s, d: re.renames(fx.image(s, d, "a"), fx.image(s, d, "b")),
        prelude("image_a", "image_b")
        + """, gone AS (SELECT * FROM image_a WHERE path NOT IN (SELECT path FROM image_b)), fresh AS (SELECT * FROM image_b WHERE path NOT IN (SELECT path FROM image_a)),
f AS (SELECT fresh.path, (SELECT min(path) FROM image_a a WHERE a.hash = fresh.hash) AS by_hash, (SELECT min(path) FROM gone g WHERE g.bytes = fresh.bytes AND g.bytes > 0) AS by_size, bytes FROM fresh),
r AS (SELECT path, CASE WHEN by_hash IS NOT NULL THEN 'renamed' WHEN by_size IS NOT NULL THEN 'same_size' ELSE 'new' END AS class, coalesce(by_hash, by_size, '') AS source, bytes FROM f)
SELECT * FROM r UNION ALL SELECT path, 'removed', '', bytes FROM gone WHERE path NOT IN (SELECT source FROM r WHERE class = 'renamed')""",
    ),
    "a18_sparse_changes": (
        lambda s, d: re.sparse_buckets(fx.image(s, d, "a"), fx.image(s, d, "b"), 200),
        prelude("image_a", "image_b")
        + """, c AS (SELECT b.path, a.body AS old, b.body AS new FROM image_a a JOIN image_b b ON a.path = b.path AND a.hash <> b.hash),
k AS (SELECT path, old, new, unnest(range(0, greatest(CAST(ceil(length(new) / 200.0) AS BIGINT), 1))) AS nth FROM c),
h AS (SELECT path, count(*) AS blocks, count(*) FILTER (nth >= greatest(CAST(ceil(length(old) / 200.0) AS BIGINT), 1) OR substr(old, nth * 200 + 1, 200) <> substr(new, nth * 200 + 1, 200)) AS changed FROM k GROUP BY path)
SELECT least(changed * 5 // blocks, 4) AS bucket, count(*) AS files, CAST(sum(changed) AS BIGINT) AS changed_blocks, CAST(sum(blocks) AS BIGINT) AS blocks FROM h GROUP BY 1""",
    ),
    "a21_top_directories": (
        lambda s, d: re.top_directories(fx.files(s, d)),
        prelude("files")
        + "SELECT '/' || array_to_string(list_slice(list_filter(string_split(path, '/'), lambda p: p <> ''), 1, 3), '/') AS dir, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) AS files FROM files GROUP BY 1 ORDER BY bytes DESC, dir LIMIT 8",
    ),
    "a22_totals": (
        lambda s, d: re.totals(fx.entries(s, d).join(fx.segments(s, d).select("segment_id", "tier"), "segment_id")),
        prelude("entries", "segments")
        + "SELECT coalesce(kind, 'all') AS kind, coalesce(tier, 'all') AS tier, count(*) AS n, CAST(sum(lba_length) AS BIGINT) AS blocks, CAST(sum(stored_length) AS BIGINT) AS bytes, round(100 * avg(CAST(present AS INTEGER)), 4) AS present_pct FROM entries JOIN segments USING (segment_id) GROUP BY GROUPING SETS ((kind), (tier), ())",
    ),
    "a23_per_file_rows": (
        lambda s, d: fx.wal(s, d).groupBy("wal_id").agg(F.count("*").alias("records"), F.sum((F.col("kind") == "zero").cast("long")).alias("zeros"), F.sum("data_length").alias("bytes"), F.max("seq").alias("last_seq")),
        prelude("wal") + "SELECT wal_id, count(*) AS records, count(*) FILTER (kind = 'zero') AS zeros, CAST(sum(data_length) AS BIGINT) AS bytes, max(seq) AS last_seq FROM wal GROUP BY wal_id",
    ),
    "a24_pending_summary": (
        lambda s, d: fx.segments(s, d).groupBy("tier").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes")),
        prelude("segments") + "SELECT tier, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes FROM segments GROUP BY tier",
    ),
    "a25_segment_inspect": (
        lambda s, d: fx.entries(s, d).groupBy("segment_id").pivot("kind", ["data", "inline", "delta", "zero", "dedup_ref", "canonical_data"]).count().fillna(0),
        prelude("entries") + "SELECT segment_id, " + ", ".join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in ("data", "inline", "delta", "zero", "dedup_ref", "canonical_data")) + " FROM entries GROUP BY segment_id",
    ),
    "a26_wait_histogram": (
        lambda s, d: re.wait_histogram(waits(s, d)),
        f"WITH {WAITS_SQL} SELECT site, CAST(CASE WHEN millis >= 1 THEN 1 ELSE 0 END + CASE WHEN millis >= 10 THEN 1 ELSE 0 END + CASE WHEN millis >= 100 THEN 1 ELSE 0 END + CASE WHEN millis >= 1000 THEN 1 ELSE 0 END + CASE WHEN millis >= 10000 THEN 1 ELSE 0 END AS BIGINT) AS bucket, count(*) AS n, max(millis) AS peak FROM waits GROUP BY 1, 2",
    ),
    "a27_upper_median": (
        lambda s, d: re.upper_median(waits(s, d), "site", "millis"),
        f"WITH {WAITS_SQL}, r AS (SELECT site, millis, row_number() OVER (PARTITION BY site ORDER BY millis) AS k, count(*) OVER (PARTITION BY site) AS n FROM waits) SELECT site, millis AS median FROM r WHERE k = n // 2 + 1",
    ),
    "a28_commitment": (
        lambda s, d: re.commitment(fx.segments(s, d), "volume_id", "segment_id"),
        prelude("segments") + "SELECT volume_id, sha256(string_agg(CAST(segment_id AS VARCHAR), ',' ORDER BY segment_id)) AS commitment, count(DISTINCT segment_id) AS members FROM segments GROUP BY volume_id",
    ),
    "sk01_sketches": (lambda s, d: fx.files(s, d).select("file_id", F.concat_ws(",", sk.sketch_column(F.col("body").cast("binary"), least_bytes=LEAST).cast("array<string>")).alias("sketch")), None),
    "sk07_super_features": (lambda s, d: fx.files(s, d).select("file_id", F.concat_ws(",", sk.sketch_column(F.col("body").cast("binary"), n=16, group=2, width=6, least_bytes=LEAST).cast("array<string>")).alias("sketch")), None),
    "sk08_keep_rule": (lambda s, d: changed_pairs(s, d).withColumn("kept", sk.worth_storing(F.col("delta"), F.col("stored"), F.col("plain"))), None),
    "sk11_resemblance": (resemblance, None),
    "sk12_layout_matches": (
        lambda s, d: si.layout_matches(fragments(s, d, "a"), fragments(s, d, "b")),
        prelude("image_a", "image_b")
        + ", "
        + fragment_sql("a")
        + ", "
        + fragment_sql("b")
        + """, la AS (SELECT path, list(struct_pack(o := file_offset, n := byte_count) ORDER BY file_offset) AS l FROM frag_a GROUP BY path), lb AS (SELECT path, list(struct_pack(o := file_offset, n := byte_count) ORDER BY file_offset) AS l FROM frag_b GROUP BY path),
same AS (SELECT la.path FROM la JOIN lb ON la.path = lb.path AND la.l = lb.l),
m AS (SELECT b.hash, b.path, b.file_offset, a.hash AS source_hash, b.byte_count FROM frag_b b JOIN frag_a a USING (path, file_offset) WHERE a.hash <> b.hash AND b.path IN (SELECT path FROM same))
SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY hash ORDER BY path, file_offset) = 1""",
    ),
    "sk14_training_windows": (
        lambda s, d: si.training_windows(fx.files(s, d).select(F.col("file_id").alias("body_id"), "bytes"), 500, 400_000),
        prelude("files")
        + """, w AS (SELECT file_id AS body_id, bytes, unnest(range(0, CAST(ceil(bytes / 500.0) AS BIGINT))) AS nth FROM files WHERE bytes > 0), s AS (SELECT body_id, nth, least(500, bytes - nth * 500) AS bytes FROM w),
r AS (SELECT *, coalesce(sum(bytes) OVER (ORDER BY nth, body_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM s) SELECT body_id, nth, bytes FROM r WHERE ahead < 400000""",
    ),
    "p02_tags": (lambda s, d: fx.files(s, d).select("file_id", sc.stored_tag(sc.content_hash(F.col("body"))).alias("tag")), prelude("files") + "SELECT file_id, substr(sha256(body), 1, 32) AS tag FROM files"),
    "p03_kind_predicates": (
        lambda s, d: fx.entries(s, d).select("kind").distinct().select("kind", sc.is_canonical(F.col("kind")).alias("canonical"), sc.is_data(F.col("kind")).alias("data"), sc.is_inline(F.col("kind")).alias("inline"), sc.has_body(F.col("kind")).alias("body"), sc.is_delta(F.col("kind")).alias("delta"), sc.owns_hash(F.col("kind")).alias("owns")),
        prelude("entries") + "SELECT DISTINCT kind, kind LIKE 'canonical%' AS canonical, kind IN ('data', 'canonical_data') AS data, kind = 'inline' AS inline, kind IN ('data', 'canonical_data', 'inline') AS body, kind = 'delta' AS delta, kind IN ('data', 'canonical_data', 'inline', 'delta') AS owns FROM entries",
    ),
    "p04_into_canonical": (
        lambda s, d: fx.entries(s, d).select(sc.as_canonical(F.col("kind")).alias("kind"), F.when(sc.as_canonical(F.col("kind")) != F.col("kind"), 0).otherwise(F.col("lba_length")).alias("n")).groupBy("kind").agg(F.sum("n").cast("long").alias("claimed"), F.count("*").alias("entries")),
        prelude("entries") + "SELECT CASE WHEN kind IN ('data', 'inline', 'delta') THEN 'canonical_' || kind ELSE kind END AS kind, CAST(sum(CASE WHEN kind IN ('data', 'inline', 'delta') THEN 0 ELSE lba_length END) AS BIGINT) AS claimed, count(*) AS entries FROM entries GROUP BY 1",
    ),
    "p05_p06_costs": (
        lambda s, d: fx.entries(s, d).select("segment_id", "entry_idx", sc.would_be_inline(F.col("stored_length")).alias("small"), gc.keep_cost().alias("cost")),
        prelude("entries") + "SELECT segment_id, entry_idx, stored_length < 256 AS small, CASE WHEN kind = 'delta' THEN delta_length WHEN kind IN ('zero', 'dedup_ref') THEN 0 ELSE stored_length END AS cost FROM entries",
    ),
    "p07_p08_codecs": (
        lambda s, d: fx.entries(s, d).select("segment_id", "entry_idx", sc.pays_fast_codec(F.col("stored_length"), F.col("stored_length") * 40 * F.col("lba_length") % 7000).alias("pays"), sc.body_codec(F.col("journal"), F.col("kind"), F.col("stored_length") * 100, F.col("stored_length") * (F.col("entry_idx") * 40)).alias("codec")),
        prelude("entries")
        + "SELECT segment_id, entry_idx, stored_length * 3 // 2 <= stored_length * 40 * lba_length % 7000 AS pays, CASE WHEN journal THEN 'lz4' WHEN kind = 'inline' THEN 'none' WHEN stored_length * 100 > 131072 THEN 'zstd_chunked' WHEN stored_length * entry_idx * 40 < stored_length * 100 THEN 'zstd' ELSE 'none' END AS codec FROM entries",
    ),
    "p09_p12_formats": (
        lambda s, d: fx.files(s, d).select("file_id", re.power_bucket(F.col("bytes")).alias("bucket"), re.directory_rollup(F.col("path")).alias("dir"), sc.percent(F.col("bytes") % 7, F.col("bytes") % 3).alias("pct"), sc.size_text(F.col("bytes") * 1000).alias("size"), sc.comma_text(F.col("bytes") * 1000).alias("commas")),
        prelude("files")
        + "SELECT file_id, CAST(pow(2, CASE WHEN bytes <= 1 THEN 0 ELSE length(bin(bytes - 1)) END) AS BIGINT) AS bucket, '/' || array_to_string(list_slice(list_filter(string_split(path, '/'), lambda p: p <> ''), 1, 3), '/') AS dir, CASE WHEN bytes % 3 = 0 THEN 0.0 ELSE 100.0 * (bytes % 7) / (bytes % 3) END AS pct, CASE WHEN bytes * 1000 >= 1073741824 THEN (bytes * 1000 // 1073741824) || ' GiB' WHEN bytes * 1000 >= 1048576 THEN (bytes * 1000 // 1048576) || ' MiB' WHEN bytes * 1000 >= 1024 THEN (bytes * 1000 // 1024) || ' KiB' ELSE (bytes * 1000) || ' B' END AS size, format('{:,}', bytes * 1000) AS commas FROM files",
    ),
    "p13_p14_ulids": (
        lambda s, d: fx.wal(s, d).select("seq", sc.ulid_of(F.lit(1_700_000_000_000) + F.col("seq") * 1000, F.col("seq")).alias("ulid")).select("seq", sc.ulid_millis(F.col("ulid")).alias("millis"), F.length("ulid").cast("long").alias("digits")),
        prelude("wal") + "SELECT seq, 1700000000000 + seq * 1000 AS millis, CAST(26 AS BIGINT) AS digits FROM wal",
    ),
    "p15_p17_checks": (
        lambda s, d: fx.wal(s, d).select("seq", sc.block_aligned(F.col("data_length") * 512).alias("aligned"), sc.retention_over(F.col("ts"), 3, F.expr("timestamp_ntz '2024-01-10 00:00:00'")).alias("expired"), sc.anchor_matches(F.col("start_lba"), F.col("start_lba") + F.col("lba_length") - 1, F.col("seq") % 6).alias("anchored")),
        prelude("wal") + "SELECT seq, data_length > 0 AND data_length * 512 % 4096 = 0 AS aligned, ts + INTERVAL 3 DAY <= TIMESTAMP '2024-01-10 00:00:00' AS expired, lba_length - 1 = seq % 6 AS anchored FROM wal",
    ),
    "p18_little_endian": (
        lambda s, d: fx.wal(s, d).select("seq", sc.little_endian(F.col("seq") * 65537).alias("le")),
        prelude("wal") + ", h AS (SELECT seq, lpad(hex(seq * 65537), 16, '0') AS x FROM wal) SELECT seq, " + " || ".join(f"substr(x, {i}, 2)" for i in range(15, 0, -2)) + " AS le FROM h",
    ),
    "p19_trim": (
        lambda s, d: iv.overlay(fx.wal(s, d).withColumn("hash", F.when(F.col("seq") % 9 == 0, fx.ZERO_HASH).otherwise(F.col("hash")))).groupBy((F.col("hash") == fx.ZERO_HASH).alias("zero")).agg(F.sum("lba_length").alias("blocks"), F.count("*").alias("runs")),
        prelude("lbamap") + ", t AS (SELECT lba_length, seq % 9 = 0 OR hash = repeat('0', 64) AS zero FROM lbamap) SELECT zero, CAST(sum(lba_length) AS BIGINT) AS blocks, count(*) AS runs FROM t GROUP BY zero",
    ),
    "p20_p22_ownership": (
        lambda s, d: fx.lineage(s, d).select("volume_id", sc.ownership(F.col("parent_id") % 5, F.lit(2)).alias("ownership"), sc.rehomed(F.col("role"), F.col("volume_id").cast("string")).alias("name")),
        prelude("lineage") + "SELECT volume_id, CASE WHEN parent_id IS NULL THEN 'unclaimed' WHEN parent_id % 5 = 2 THEN 'ours' ELSE 'foreign' END AS ownership, role || '-rehomed-' || volume_id AS name FROM lineage",
    ),
    "a10_codec_study": (codec_study, None),
    "a19_cold_boot": (
        lambda s, d: cold_boot(s, d).groupBy("class").agg(F.count("*").alias("reads"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")),
        prelude("image_a", "image_b")
        + """, t AS (SELECT path FROM image_a UNION SELECT path FROM image_b), m AS (SELECT CASE WHEN b.hash IS NULL THEN 'unmapped' WHEN b.hash IN (SELECT hash FROM image_a) THEN 'exact' WHEN a.hash IS NOT NULL THEN 'changed' ELSE 'new' END AS class, b.bytes FROM t LEFT JOIN image_b b ON b.path = t.path LEFT JOIN image_a a ON a.path = t.path)
SELECT class, count(*) AS reads, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS bytes FROM m GROUP BY class""",
    ),
    "a19_boot_strategies": (boot_strategies, None),
    "a20_delta_simulation": (delta_simulation, None),
    "d02_index_and_sketches": (index_and_sketches, None),
    "sk02_postings": (lambda s, d: si.postings(marks(s, d)), None),
    "sk03_candidates": (lambda s, d: si.candidates(marks(s, d), si.postings(marks(s, d))), None),
    "sk04_index_stats": (lambda s, d: si.index_stats(marks(s, d)), None),
    "sk06_positional_overlap": (lambda s, d: si.positional_overlap(marks(s, d)), None),
    "sk09_same_place": (
        same_place,
        prelude("wal")
        + f""", b AS (SELECT *, unnest(range(start_lba, start_lba + lba_length)) AS lba FROM wal WHERE wal_id <= {fx.log_share_sql(5)}), p AS (SELECT lba, hash FROM b QUALIFY row_number() OVER (PARTITION BY lba ORDER BY wal_id DESC, seq DESC) = 1)
SELECT w.seq AS entry_id, w.hash, p.hash AS source_hash FROM wal w JOIN p ON p.lba = w.start_lba WHERE w.wal_id > {fx.log_share_sql(5)} AND w.kind = 'data' AND w.lba_length = 1 AND p.hash <> w.hash AND p.hash IN (SELECT hash FROM wal WHERE kind = 'data')""",
    ),
    "a26_wait_windows": (
        lambda s, d: re.wait_windows(fx.read(s, d, "events").select(F.col("event_type").alias("site"), F.floor(F.abs("value") * 100).cast("long").alias("millis"), F.col("event_id").alias("at")), 500),
        "WITH waits AS (SELECT event_type AS site, CAST(floor(abs(value) * 100) AS BIGINT) AS millis, event_id AS pos FROM events), r AS (SELECT pos // 500 AS \"window\", site, count(*) AS n, CAST(sum(millis) AS BIGINT) AS millis, max(millis) AS peak FROM waits GROUP BY ALL) SELECT *, n - coalesce(lag(n) OVER o, 0) AS n_since, millis - coalesce(lag(millis) OVER o, 0) AS millis_since, row_number() OVER (PARTITION BY \"window\" ORDER BY millis DESC, site DESC) = 1 AS top FROM r WINDOW o AS (PARTITION BY site ORDER BY \"window\")",
    ),
    "a17_top_renames": (
        lambda s, d: re.renames(fx.image(s, d, "a"), fx.image(s, d, "b")).where("class = 'renamed'").orderBy(F.desc("bytes"), "path").limit(20).select("path", "source", "bytes"),
        prelude("image_a", "image_b")
        + """ SELECT b.path, min(a.path) AS source, any_value(b.bytes) AS bytes FROM image_b b JOIN image_a a ON a.hash = b.hash WHERE b.path NOT IN (SELECT path FROM image_a) GROUP BY b.path ORDER BY bytes DESC, b.path LIMIT 20""",
    ),
}
