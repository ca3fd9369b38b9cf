"""Registered queries of sources, sinks and streams, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from varve.operators import compaction as gc
from varve.operators import read_path as rp
from varve.plans import compaction_queries as cq
from varve.plans import fixtures as fx
from varve.plans.fixtures import prelude
from varve.sources import text_formats as tf
from varve.sources.shared import fresh_folder as shared
from varve.sources import wal_format as wf
from varve.streaming import log

RECORD = "wal_id, seq, kind, hash, start_lba, lba_length, data_length"


def torn(s, d):
    """Logs of which every third has lost its last five bytes."""
    logs = wf.encoded_logs(fx.wal(s, d))
    return logs.select("wal_id", F.when(F.col("wal_id") % 3 == 0, F.expr("substring(content, 1, length(content) - 5)")).otherwise(F.col("content")).alias("content"))


def event_stream(s, d):
    path = f"{d}/events.parquet"
    # a stream reads a folder; the table may be one file
    folder, name = path.rsplit("/", 1)
    return s.readStream.schema(s.read.parquet(path).schema).option("pathGlobFilter", "*.parquet").parquet(path if is_folder(s, path) else f"{folder}/{name[:-8]}*.parquet")


def is_folder(s, path):
    p = s._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(s._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def wal_stream(s, d, *more):
    e = event_stream(s, d)
    zero = F.col("event_type") == "error"
    digest = F.when(zero, fx.ZERO_HASH).otherwise(F.sha2(F.concat_ws(":", "event_type", (F.col("event_id") % 37).cast("string")), 256))
    return e.select(F.col("event_id").alias("seq"), F.floor(F.col("event_id") / 64).alias("wal_id"), ((F.col("user_id") * 7 + F.col("event_id")) % fx.log_space(s, d)).alias("start_lba"), (1 + F.col("event_id") % 6).alias("lba_length"), digest.alias("hash"), *more)


def streamed_overlay(s, d):
    folder = shared(s, "overlay")
    log.overlay_stream(wal_stream(s, d), folder).awaitTermination()
    return log.current_map(s, folder)


def streamed_counts(s, d):
    folder = shared(s, "counts")
    return log.run_to_folder(log.windowed_counts(event_stream(s, d)), folder, "complete")


def streamed_skips(s, d):
    """First blocks of all writes, purchases sent twice; a write that finds its own hash is skipped."""
    w = wal_stream(s, d, "event_type")
    sent = F.when(F.col("event_type") == "purchase", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = w.withColumn("again", F.explode(sent)).select(F.col("start_lba").alias("lba"), (F.col("seq") * 2 + F.col("again")).alias("seq"), "hash")
    return log.run_to_folder(log.skip_noops(rows), shared(s, "skips"), "append")


def stored_plan(s, d):
    """The plan of a pass, written as text and read back."""
    folder = shared(s, "plan")
    tf.plan_lines(cq.plan(s, d)).write.text(folder)
    return tf.parse_plan(s.read.text(folder))


def streamed_retention(s, d):
    """Superseded inputs as a stream of edges; what the newest edge's time has passed by thirty days has left the state."""
    folder = shared(s, "edges")
    gc.confirmed_edges(fx.segments(s, d), cq.FLOOR).select("input", "output", F.col("since").cast("timestamp").alias("since")).write.parquet(f"{folder}/edges")
    edges = s.readStream.schema("input long, output long, since timestamp").parquet(f"{folder}/edges")
    return log.run_to_folder(log.retained(edges, cq.RETAIN), folder, "append").select("input", "output")


QUERIES = {
    "s01_wal_scan": (lambda s, d: wf.parsed_logs(wf.encoded_logs(fx.wal(s, d))), prelude("wal") + f"SELECT {RECORD}, FALSE AS is_truncated FROM wal"),
    "s02_torn_wal_scan": (
        lambda s, d: wf.parsed_logs(torn(s, d)),
        prelude("wal") + f", l AS (SELECT *, max(seq) OVER (PARTITION BY wal_id) AS last FROM wal) SELECT {RECORD}, wal_id % 3 = 0 AS is_truncated FROM l WHERE NOT (wal_id % 3 = 0 AND seq = last)",
    ),
    "s05_layout_scan": (
        lambda s, d: fx.entries(s, d).groupBy("segment_id").agg(F.sum(F.when(F.col("kind") == "inline", F.col("stored_length")).otherwise(0)).alias("inline_bytes"), F.sum(F.when(F.col("kind").isin("data", "canonical_data"), F.col("stored_length")).otherwise(0)).alias("body_bytes"), F.sum("delta_length").alias("delta_bytes")),
        prelude("entries") + "SELECT segment_id, CAST(sum(CASE WHEN kind = 'inline' THEN stored_length ELSE 0 END) AS BIGINT) AS inline_bytes, CAST(sum(CASE WHEN kind IN ('data', 'canonical_data') THEN stored_length ELSE 0 END) AS BIGINT) AS body_bytes, CAST(sum(delta_length) AS BIGINT) AS delta_bytes FROM entries GROUP BY segment_id",
    ),
    "s07_body_scan": (
        lambda s, d: rp.chunk_table(fx.files(s, d), 300).join(fx.files(s, d).select("file_id", "body"), "file_id").select("file_id", "chunk", F.expr("substring(body, cast(offset + 1 as int), cast(length as int))").alias("body")),
        prelude("files") + ", c AS (SELECT file_id, unnest(range(0, CAST(ceil(length(body) / 300.0) AS BIGINT))) AS chunk, body FROM files WHERE length(body) > 0) SELECT file_id, chunk, substr(body, chunk * 300 + 1, 300) AS body FROM c",
    ),
    "s08_bounds": (
        lambda s, d: rp.offsets(fx.entries(s, d), "segment_id", ["entry_idx"], "stored_length").select("segment_id", "entry_idx", (F.col("body_offset") + F.col("stored_length") <= 12_000).alias("inside")),
        prelude("entries") + ", o AS (SELECT *, coalesce(sum(stored_length) OVER (PARTITION BY segment_id ORDER BY entry_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS body_offset FROM entries) SELECT segment_id, entry_idx, body_offset + stored_length <= 12000 AS inside FROM o",
    ),
    "s16_layout": (
        lambda s, d: rp.offsets(fx.files(s, d).withColumn("vol", F.col("file_id") % 4).withColumn("blocks", F.ceil(F.col("bytes") / 4096)), "vol", ["file_id"], "blocks").select("vol", "path", F.col("body_offset").alias("start_lba"), "blocks"),
        prelude("files") + ", v AS (SELECT file_id % 4 AS vol, file_id, path, CAST(ceil(bytes / 4096.0) AS BIGINT) AS blocks FROM files) SELECT vol, path, CAST(coalesce(sum(blocks) OVER (PARTITION BY vol ORDER BY file_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_lba, blocks FROM v",
    ),
    "s18_first_path": (lambda s, d: fx.files(s, d).groupBy("hash").agg(F.min("path").alias("path"), F.count("*").alias("links")), prelude("files") + "SELECT hash, min(path) AS path, count(*) AS links FROM files GROUP BY hash"),
    "s20_file_hashes": (lambda s, d: fx.files(s, d).select("path", "hash", "bytes"), prelude("files") + "SELECT path, hash, bytes FROM files"),
    "s21_filemap": (
        lambda s, d: tf.parse_filemap(tf.filemap_lines(fx.files(s, d).select("path", F.lit(0).cast("long").alias("file_offset"), "hash", F.col("bytes").alias("byte_count")))),
        prelude("files") + "SELECT path, CAST(0 AS BIGINT) AS file_offset, hash, bytes AS byte_count FROM files",
    ),
    "s22_trace": (
        lambda s, d: tf.parse_trace(fx.wal(s, d).select(F.format_string(" %s %d  %d", "hash", F.col("start_lba") * 4096, F.col("data_length")).alias("value"))),
        prelude("wal") + "SELECT hash, start_lba * 4096 AS start_byte, data_length AS byte_count FROM wal",
    ),
    "s25_head": (lambda s, d: tf.parse_head(tf.head_lines(cq.head(s, d))), prelude("segments") + "SELECT volume_id, CASE WHEN segment_id % 50 = 7 THEN 'tombstoned' WHEN tier = 'gc' THEN 'superseded' ELSE 'added' END AS section, segment_id FROM segments"),
    "s26_plan": (stored_plan, cq.QUERIES["g10_plan"][1]),
    "k07_head_lines": (
        lambda s, d: tf.head_lines(cq.head(s, d)).groupBy("volume_id").agg(F.count("*").alias("lines"), F.sum(F.col("value").startswith("[").cast("long")).alias("titles")),
        prelude("segments") + "SELECT volume_id, count(*) + 4 AS lines, CAST(4 AS BIGINT) AS titles FROM segments GROUP BY volume_id",
    ),
    "k11_block_hashes": (
        lambda s, d: rp.chunk_table(fx.files(s, d), 128).select("file_id", F.concat_ws(" ", F.col("chunk").cast("string"), "hash").alias("line")),
        prelude("files") + ", c AS (SELECT file_id, unnest(range(0, CAST(ceil(length(body) / 128.0) AS BIGINT))) AS chunk, body FROM files WHERE length(body) > 0) SELECT file_id, chunk || ' ' || sha256(substr(body, chunk * 128 + 1, 128)) AS line FROM c",
    ),
    "k12_json_events": (
        lambda s, d: fx.journal(s, d).select("name", "event_id", F.to_json(F.struct("name", "event_id", "kind")).alias("json")),
        prelude("journal") + "SELECT name, event_id, CAST(to_json(struct_pack(name := name, event_id := event_id, kind := kind)) AS VARCHAR) AS json FROM journal",
    ),
    "st01_stream_overlay": (streamed_overlay, prelude("lbamap") + "SELECT start_lba, lba_length, payload_block_offset, hash, claimant, seq FROM lbamap"),
    "st02_stream_windows": (
        streamed_counts,
        "SELECT CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    ),
    "st03_stream_noop_skip": (
        streamed_skips,
        prelude("wal")
        + ", x AS (SELECT w.start_lba AS lba, w.seq, w.hash, e.event_type FROM wal w JOIN events e ON e.event_id = w.seq), w AS (SELECT lba, seq * 2 + again AS seq, hash FROM (SELECT *, unnest(CASE WHEN event_type = 'purchase' THEN [0, 1] ELSE [0] END) AS again FROM x)), l AS (SELECT *, lag(hash) OVER (PARTITION BY lba ORDER BY seq) AS held FROM w) SELECT lba, seq, hash FROM l WHERE held IS NULL OR held <> hash",
    ),
    "st04_log_epochs": (
        lambda s, d: log.epochs(fx.wal(s, d), 12_000, 20),
        prelude("wal", recursive=True)
        + """, o AS (SELECT wal_id, seq, data_length, row_number() OVER (PARTITION BY wal_id ORDER BY seq) AS k FROM wal),
e(wal_id, k, epoch, n, bytes) AS (SELECT wal_id, k, CAST(0 AS BIGINT), CAST(1 AS BIGINT), data_length FROM o WHERE k = 1 UNION ALL
SELECT e.wal_id, o.k, CASE WHEN n >= 20 OR bytes >= 12000 THEN epoch + 1 ELSE epoch END, CASE WHEN n >= 20 OR bytes >= 12000 THEN 1 ELSE n + 1 END, CASE WHEN n >= 20 OR bytes >= 12000 THEN o.data_length ELSE bytes + o.data_length END FROM e JOIN o ON o.wal_id = e.wal_id AND o.k = e.k + 1)
SELECT wal_id, epoch, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS entries, CAST(sum(data_length) AS BIGINT) AS bytes FROM e JOIN o USING (wal_id, k) GROUP BY ALL""",
    ),
    "st05_coalesced_writes": (
        lambda s, d: log.coalesced(fx.wal(s, d)),
        prelude("wal")
        + """, g AS (SELECT *, CASE WHEN lag(kind) OVER p = kind AND lag(start_lba + lba_length) OVER p = start_lba THEN 0 ELSE 1 END AS fresh FROM wal WINDOW p AS (PARTITION BY wal_id ORDER BY seq)), i AS (SELECT *, sum(fresh) OVER (PARTITION BY wal_id ORDER BY seq) AS run FROM g)
SELECT wal_id, min(seq) AS first_seq, kind, min(start_lba) AS start_lba, CAST(sum(lba_length) AS BIGINT) AS lba_length, count(*) AS writes, CAST(sum(data_length) AS BIGINT) AS data_length FROM i GROUP BY wal_id, run, kind""",
    ),
    "st06_retention": (
        streamed_retention,
        prelude("segments")
        + f", e AS (SELECT unnest(inputs) AS input, segment_id AS output, created AS since FROM segments WHERE segment_id > {cq.FLOOR} AND tier = 'gc'), l AS (SELECT input, max(output) AS output, arg_max(since, output) AS since FROM e GROUP BY input) SELECT input, output FROM l WHERE since + INTERVAL {cq.RETAIN} DAY < (SELECT max(since) FROM l)",
    ),
}
