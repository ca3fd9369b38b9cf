"""Registered queries of the read path, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from varve.operators import intervals as iv
from varve.operators import read_path as rp
from varve.plans import fixtures as fx
from varve.plans.fixtures import ZERO_HASH, prelude


def bodies(s, d):
    """A body for most hashes of the log: the text that its hash is of; every ninth is damaged and every seventh is gone."""
    e = fx.read(s, d, "events").where("event_type <> 'error'")
    e = e.select("event_type", (F.col("event_id") % 37).alias("n")).distinct().where("n % 7 <> 6")
    text = F.concat_ws(":", "event_type", F.col("n").cast("string"))
    return e.select(F.sha2(text, 256).alias("hash"), F.when(F.col("n") % 9 == 4, F.concat(text, F.lit("!"))).otherwise(text).alias("body"))


BODIES = """bodies AS (SELECT DISTINCT sha256(event_type || ':' || (event_id % 37)) AS hash, event_type || ':' || (event_id % 37) || CASE WHEN event_id % 37 % 9 = 4 THEN '!' ELSE '' END AS body
  FROM events WHERE event_type <> 'error' AND event_id % 37 % 7 <> 6)"""
READ = """, wanted AS (SELECT request_id, unnest(range(start_lba, end_lba)) AS lba FROM requests),
met AS (SELECT w.request_id, w.lba, m.hash, m.payload_block_offset + w.lba - m.start_lba AS nth, b.body FROM wanted w LEFT JOIN lbamap m ON m.start_lba <= w.lba AND w.lba < m.start_lba + m.lba_length LEFT JOIN bodies b ON b.hash = m.hash),
res AS (SELECT *, CASE WHEN hash IS NULL THEN 'gap' WHEN hash = repeat('0', 64) THEN 'zero' WHEN body IS NULL THEN 'missing' ELSE 'data' END AS state FROM met)"""


def read(s, d):
    return rp.range_read(iv.overlay(fx.wal(s, d)), fx.requests(s, d), bodies(s, d), ZERO_HASH, 3)


QUERIES = {
    "r01_range_read": (read, prelude("lbamap", "requests") + ", " + BODIES + READ + " SELECT request_id, lba, state, CASE WHEN state = 'data' THEN substr(body, nth * 3 + 1, 3) ELSE '' END AS payload FROM res"),
    "r02_read_block": (
        lambda s, d: rp.range_read(iv.overlay(fx.wal(s, d)), fx.requests(s, d).withColumn("end_lba", F.col("start_lba") + 1), bodies(s, d), ZERO_HASH, 3),
        prelude("lbamap", "requests") + ", " + BODIES + READ.replace("range(start_lba, end_lba)", "range(start_lba, start_lba + 1)") + " SELECT request_id, lba, state, CASE WHEN state = 'data' THEN substr(body, nth * 3 + 1, 3) ELSE '' END AS payload FROM res",
    ),
    "r03_read_outcomes": (
        lambda s, d: read(s, d).groupBy("state").agg(F.count("*").alias("blocks"), F.countDistinct("request_id").alias("reads")),
        prelude("lbamap", "requests") + ", " + BODIES + READ + " SELECT state, count(*) AS blocks, count(DISTINCT request_id) AS reads FROM res GROUP BY state",
    ),
    "r07_verify_content": (
        lambda s, d: rp.verified_content(iv.overlay(fx.wal(s, d)), bodies(s, d), ZERO_HASH),
        prelude("lbamap")
        + ", "
        + BODIES
        + " SELECT m.hash, min(start_lba) AS lowest_lba, CASE WHEN any_value(body) IS NULL THEN 'unresolvable' WHEN sha256(any_value(body)) = m.hash THEN 'ok' ELSE 'mismatch' END AS state FROM lbamap m LEFT JOIN bodies b ON b.hash = m.hash WHERE m.hash <> repeat('0', 64) GROUP BY m.hash",
    ),
    "r09_hash_checks": (
        lambda s, d: fx.image(s, d, "b").select("file_id", (F.sha2("body", 256) == F.col("hash")).alias("plain_ok"), F.substring("hash", 1, 32).alias("tag"), (F.substring(F.sha2(F.concat("body", F.lit("x")), 256), 1, 32) == F.substring("hash", 1, 32)).alias("damaged_ok")),
        prelude("image_b") + "SELECT file_id, sha256(body) = hash AS plain_ok, substr(hash, 1, 32) AS tag, substr(sha256(body || 'x'), 1, 32) = substr(hash, 1, 32) AS damaged_ok FROM image_b",
    ),
    "r10_chunk_roots": (
        lambda s, d: rp.chunk_roots(rp.chunk_table(fx.files(s, d), 512)),
        prelude("files")
        + ", c AS (SELECT file_id, unnest(range(0, CAST(ceil(length(body) / 512.0) AS BIGINT))) AS chunk, body FROM files WHERE length(body) > 0), h AS (SELECT file_id, chunk, sha256(substr(body, chunk * 512 + 1, 512)) AS hash FROM c) SELECT file_id, sha256(string_agg(hash, '' ORDER BY chunk)) AS root, count(*) AS chunks FROM h GROUP BY file_id",
    ),
    "r10_covering_chunks": (
        lambda s, d: rp.covering_chunks(fx.requests(s, d).select("request_id", F.col("start_lba").alias("start"), F.col("end_lba").alias("end")), 8),
        prelude("requests") + "SELECT request_id, start_lba AS start, end_lba AS \"end\", start_lba // 8 AS first_chunk, (end_lba - 1) // 8 AS last_chunk, (end_lba - start_lba) / CAST(((end_lba - 1) // 8 - start_lba // 8 + 1) * 8 AS DOUBLE) AS used_share FROM requests",
    ),
    "r11_chunk_table": (
        lambda s, d: rp.offsets(rp.chunk_table(fx.files(s, d), 1000).drop("offset"), "file_id", ["chunk"], "length"),
        prelude("files")
        + ", c AS (SELECT file_id, unnest(range(0, CAST(ceil(length(body) / 1000.0) AS BIGINT))) AS chunk, body FROM files WHERE length(body) > 0), h AS (SELECT file_id, chunk, CAST(length(substr(body, chunk * 1000 + 1, 1000)) AS BIGINT) AS length, sha256(substr(body, chunk * 1000 + 1, 1000)) AS hash FROM c) SELECT *, CAST(coalesce(sum(length) OVER (PARTITION BY file_id ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS body_offset FROM h",
    ),
    "r12_miss_rate": (
        lambda s, d: fx.read(s, d, "events")
        .groupBy(F.floor(F.col("event_id") / 500).alias("window"))
        .agg(F.count("*").alias("reads"), F.sum((F.col("event_type") == "error").cast("long")).alias("misses"))
        .withColumn("miss_rate", rp.rate(F.col("misses"), F.col("reads")))
        .withColumn("since", F.col("misses") - F.coalesce(F.lag("misses").over(Window.orderBy("window")), F.lit(0))),
        "WITH w AS (SELECT event_id // 500 AS \"window\", count(*) AS reads, count(*) FILTER (event_type = 'error') AS misses FROM events GROUP BY 1) SELECT *, misses / CAST(reads AS DOUBLE) AS miss_rate, misses - coalesce(lag(misses) OVER (ORDER BY \"window\"), 0) AS since FROM w",
    ),
}
