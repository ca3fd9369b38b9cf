"""Storage-shaped relations derived from the driver's tables, in Spark and as DuckDB SQL.

The operators work on any relations with these columns. The registered queries
run them on relations computed from the TPC-H-like tables by the same integer
expressions in both engines; ``SQL[name]`` is the common table expression, and
:func:`prelude` strings together what a query needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ZERO_HASH = "0" * 64
#: Least blocks of the write log's address space and of a volume's, and least volumes; all grow with the tables.
LOG_SPACE, VOLUME_SPACE, VOLUMES = 4096, 2048, 16
BLOCK_BYTES = 4096
#: The same sizes in SQL.
LOG_SPACE_SQL = f"(SELECT greatest({LOG_SPACE}, count(*) // 4) FROM events)"
VOLUME_SPACE_SQL = f"(SELECT greatest({VOLUME_SPACE}, count(*) // 64) FROM lineitem)"
VOLUMES_SQL = f"(SELECT greatest({VOLUMES}, count(*) // 4096) FROM orders)"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_ROWS: dict[tuple[str, str, str], int] = {}


def rows(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Rows of a table, counted from the files' footers, once for a session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _ROWS:
        _ROWS[key] = read(spark, sf_dir, name).count()
    return _ROWS[key]


def log_space(spark: SparkSession, sf_dir: str) -> int:
    return max(LOG_SPACE, rows(spark, sf_dir, "events") // 4)


def volume_space(spark: SparkSession, sf_dir: str) -> int:
    return max(VOLUME_SPACE, rows(spark, sf_dir, "lineitem") // 64)


def volumes(spark: SparkSession, sf_dir: str) -> int:
    return max(VOLUMES, rows(spark, sf_dir, "orders") // 4096)


#: Lines from which one more part of the volumes is made, and most parts: each reads the tables once.
PART_LINES, MOST_PARTS = 4_000_000, 8


def parts(spark: SparkSession, sf_dir: str) -> int:
    """Parts of the volumes that steps over all entries are stored in."""
    return min(MOST_PARTS, 1 + rows(spark, sf_dir, "lineitem") // PART_LINES)


def segment_share(spark: SparkSession, sf_dir: str, tenths: int) -> int:
    """The segment id at a share of the way to the newest one: a snapshot cut that moves with the table."""
    newest = read(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0] or 0
    return newest * tenths // 10


def segment_share_sql(tenths: int) -> str:
    return f"(SELECT max(o_orderkey) * {tenths} // 10 FROM orders)"


def log_share(spark: SparkSession, sf_dir: str, tenths: int) -> int:
    """The log id at a share of the way to the newest one."""
    newest = read(spark, sf_dir, "events").agg(F.max("event_id")).first()[0] or 0
    return newest // 64 * tenths // 10


def log_share_sql(tenths: int) -> str:
    return f"(SELECT max(event_id) // 64 * {tenths} // 10 FROM events)"


def wal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write log: ``seq, wal_id, start_lba, lba_length, kind, hash, data_length, ts``."""
    e, space = read(spark, sf_dir, "events"), log_space(spark, sf_dir)
    zero = F.col("event_type") == "error"
    return e.select(
        F.col("event_id").alias("seq"),
        F.floor(F.col("event_id") / 64).alias("wal_id"),
        ((F.col("user_id") * 7 + F.col("event_id")) % space).alias("start_lba"),
        (1 + F.col("event_id") % 6).alias("lba_length"),
        F.when(zero, "zero").otherwise("data").alias("kind"),
        F.when(zero, ZERO_HASH).otherwise(F.sha2(F.concat_ws(":", "event_type", (F.col("event_id") % 37).cast("string")), 256)).alias("hash"),
        F.when(zero, F.lit(0)).otherwise(100 + F.col("event_id") % 900).cast("long").alias("data_length"),
        "ts",
    )


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their place in the order, ``entry_idx``; every use needs the same columns, so that a query deals the table out once."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity")
    return read(spark, sf_dir, "lineitem").withColumn("entry_idx", F.row_number().over(order).cast("long"))


def entries(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """Segment index entries, one segment for each order; ``more`` are further columns of their lines."""
    rows, space, count = numbered(spark, sf_dir), volume_space(spark, sf_dir), volumes(spark, sf_dir)
    mark = (F.col("l_partkey") * 3 + F.col("l_linenumber")) % 12
    kind = F.when(mark == 0, "zero").when(mark == 1, "inline").when(mark.isin(2, 3), "delta").when(mark == 4, "canonical_data").when(mark == 5, "dedup_ref").otherwise("data")
    rows = rows.withColumn("kind", kind)
    claims = F.col("kind") != "canonical_data"
    return rows.select(
        (F.col("l_orderkey") % count).alias("volume_id"),
        F.col("l_orderkey").alias("segment_id"),
        "entry_idx",
        "kind",
        F.when(F.col("kind") == "zero", ZERO_HASH).otherwise(F.sha2(F.concat(F.when(F.col("kind") == "delta", "d").otherwise(""), F.col("l_partkey").cast("string")), 256)).alias("hash"),
        F.when(claims, (F.col("l_partkey") * 17 + F.col("l_suppkey") * 5) % space).otherwise(0).cast("long").alias("start_lba"),
        F.when(claims, 1 + F.col("l_suppkey") % 4).otherwise(0).cast("long").alias("lba_length"),
        F.when(F.col("kind").isin("zero", "dedup_ref"), 0).when(F.col("kind") == "inline", 16 + F.col("l_quantity")).otherwise(F.col("l_quantity") * 100).cast("long").alias("stored_length"),
        (F.col("l_suppkey") % 11 == 0).alias("journal"),
        F.when(F.col("kind") == "delta", F.sha2((F.col("l_partkey") - 1).cast("string"), 256)).alias("delta_source"),
        F.when(F.col("kind") == "delta", F.col("l_quantity") * 10).otherwise(0).cast("long").alias("delta_length"),
        (F.col("l_linenumber") % 3 != 0).alias("present"),
        *more,
    )


def bodied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that have bytes, with their volume, the text that their hash is of and whether it is still that: every 29th supplier's is damaged."""
    text, sound = F.col("l_partkey").cast("string").alias("text"), (F.col("l_suppkey") % 29 != 3).alias("sound")
    return entries(spark, sf_dir, text, sound).where("kind in ('data', 'inline', 'canonical_data')").select("volume_id", "segment_id", "entry_idx", "hash", "lba_length", "text", "sound")


def entry_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``segment_id, entry_idx, body``: plain bodies as they are stored."""
    rows = bodied(spark, sf_dir)
    return rows.select("segment_id", "entry_idx", F.when(F.col("sound"), F.col("text")).otherwise(F.concat("text", F.lit("!"))).alias("body"))


def block_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``volume_id, segment_id, entry_idx, body, sound``: bodies of 64 characters a block; every 97th entry's is gone."""
    rows = bodied(spark, sf_dir).where("not (segment_id + entry_idx) % 97 = 11")
    block = lambda i: F.sha2(F.concat_ws(":", "hash", i.cast("string")), 256)
    count = F.greatest(F.col("lba_length"), F.lit(1))
    return rows.select("volume_id", "segment_id", "entry_idx", F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), count - 1), block), "").alias("body"), "sound")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``volume_id, segment_id, tier, inputs, created, bytes``; outputs of a compaction name their inputs."""
    o, count = read(spark, sf_dir, "orders"), volumes(spark, sf_dir)
    tier = F.when(F.col("o_orderkey") % 5 == 0, "gc").when(F.col("o_orderkey") % 5 == 1, "pending").otherwise("index")
    inputs = F.filter(F.array(*(F.col("o_orderkey") - n * count for n in (3, 2, 1))), lambda x: x >= 0)
    return o.select(
        (F.col("o_orderkey") % count).alias("volume_id"),
        F.col("o_orderkey").alias("segment_id"),
        tier.alias("tier"),
        F.when(F.col("o_orderkey") % 5 == 0, inputs).otherwise(F.array().cast("array<bigint>")).alias("inputs"),
        F.col("o_orderdate").alias("created"),
        F.floor(F.col("o_totalprice")).cast("long").alias("bytes"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``file_id, path, body, hash, bytes``."""
    d = read(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("file_id"), file_path().alias("path"), F.col("text").alias("body"), F.sha2("text", 256).alias("hash"), F.octet_length("text").cast("long").alias("bytes"))


def file_path():
    return F.concat(F.lit("/"), F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), F.floor(F.col("doc_id") / 100).cast("string"), F.lit("/"), F.col("doc_id").cast("string"))


def image(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """Files of one of two snapshots: some removed, some new, some changed, some renamed."""
    f = files(spark, sf_dir)
    if side == "a":
        return f.where("file_id % 7 <> 3")
    f = f.where("file_id % 7 <> 5")
    over = F.concat(F.lit("X"), F.expr("substring(body, 2)"))
    changed = F.when(F.col("file_id") % 10 == 0, F.concat("body", F.lit(" changed"))).when(F.col("file_id") % 10 == 5, over).otherwise(F.col("body"))
    moved = F.when(F.col("file_id") % 11 == 4, F.concat(F.lit("/moved"), F.col("path"))).otherwise(F.col("path"))
    return f.select("file_id", moved.alias("path"), changed.alias("body")).select("file_id", "path", "body", F.sha2("body", 256).alias("hash"), F.octet_length("body").cast("long").alias("bytes"))


def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volumes and the volume each was forked from, at a snapshot."""
    c = read(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    return c.select(
        key.alias("volume_id"),
        F.when(key > 1, F.floor(key / 2)).alias("parent_id"),
        F.when(key > 1, key * 10 - key % 7).alias("branch_snapshot"),
        F.when(key % 9 == 0, F.array(key - 3, key - 5)).otherwise(F.array().cast("array<bigint>")).alias("sources"),
        F.when(key % 4 == 0, "skeleton").when(key % 4 == 1, "unclassified").otherwise("anchor").alias("role"),
    )


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event log: ``name, event_id, prev_id, kind, stamp``; some back links skip an event."""
    c = read(spark, sf_dir, "conversations")
    t = F.col("turn")
    prev = F.when(t == 0, None).when((t >= 2) & ((F.col("conv_id") + t) % 13 == 0), t - 2).otherwise(t - 1)
    kinds = ("force_claim", "claim", "stop", "start", "release")
    kind = F.element_at(F.array(*map(F.lit, kinds)), (t % len(kinds) + 1).cast("int"))
    return c.select(F.col("conv_id").alias("name"), t.alias("event_id"), prev.alias("prev_id"), kind.alias("kind"), (F.col("conv_id") * 1000 + t).alias("stamp"), F.length("text").cast("long").alias("payload"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range probes ``request_id, start_lba, end_lba`` over the write log's space."""
    e = read(spark, sf_dir, "events")
    start = (F.col("event_id") * 31) % log_space(spark, sf_dir)
    return e.select(F.col("event_id").alias("request_id"), start.alias("start_lba"), (start + 1 + F.col("event_id") % 16).alias("end_lba"))


def window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw journal ranges ``start_lba, lba_length``: overlapping, adjacent and empty ones."""
    s = read(spark, sf_dir, "supplier")
    return s.select(((F.col("s_suppkey") * 37) % log_space(spark, sf_dir)).alias("start_lba"), (F.col("s_suppkey") % 9).alias("lba_length"))


Z = f"'{ZERO_HASH}'"
SQL = {
    "wal": f"""wal AS (SELECT event_id AS seq, event_id // 64 AS wal_id, (user_id * 7 + event_id) % {LOG_SPACE_SQL} AS start_lba, 1 + event_id % 6 AS lba_length,
      CASE WHEN event_type = 'error' THEN 'zero' ELSE 'data' END AS kind,
      CASE WHEN event_type = 'error' THEN {Z} ELSE sha256(event_type || ':' || (event_id % 37)) END AS hash,
      CAST(CASE WHEN event_type = 'error' THEN 0 ELSE 100 + event_id % 900 END AS BIGINT) AS data_length, ts FROM events)""",
    "entries": f"""entries_k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS entry_idx,
      CASE (l_partkey * 3 + l_linenumber) % 12 WHEN 0 THEN 'zero' WHEN 1 THEN 'inline' WHEN 2 THEN 'delta' WHEN 3 THEN 'delta' WHEN 4 THEN 'canonical_data' WHEN 5 THEN 'dedup_ref' ELSE 'data' END AS kind FROM lineitem),
      entries AS (SELECT l_orderkey % {VOLUMES_SQL} AS volume_id, l_orderkey AS segment_id, entry_idx, kind,
      CASE WHEN kind = 'zero' THEN {Z} WHEN kind = 'delta' THEN sha256('d' || l_partkey) ELSE sha256(CAST(l_partkey AS VARCHAR)) END AS hash,
      CAST(CASE WHEN kind = 'canonical_data' THEN 0 ELSE (l_partkey * 17 + l_suppkey * 5) % {VOLUME_SPACE_SQL} END AS BIGINT) AS start_lba,
      CAST(CASE WHEN kind = 'canonical_data' THEN 0 ELSE 1 + l_suppkey % 4 END AS BIGINT) AS lba_length,
      CAST(CASE WHEN kind IN ('zero', 'dedup_ref') THEN 0 WHEN kind = 'inline' THEN 16 + l_quantity ELSE l_quantity * 100 END AS BIGINT) AS stored_length,
      l_suppkey % 11 = 0 AS journal,
      CASE WHEN kind = 'delta' THEN sha256(CAST(l_partkey - 1 AS VARCHAR)) END AS delta_source,
      CAST(CASE WHEN kind = 'delta' THEN l_quantity * 10 ELSE 0 END AS BIGINT) AS delta_length,
      l_linenumber % 3 <> 0 AS present FROM entries_k)""",
    "entry_bodies": """entry_bodies AS (SELECT l_orderkey AS segment_id, entry_idx, l_partkey || CASE WHEN l_suppkey % 29 = 3 THEN '!' ELSE '' END AS body FROM entries_k WHERE kind IN ('data', 'inline', 'canonical_data'))""",
    "block_bodies": """block_bodies AS (SELECT e.segment_id, e.entry_idx, array_to_string(list_transform(range(0, greatest(e.lba_length, 1)), lambda i: sha256(e.hash || ':' || i)), '') AS body, k.l_suppkey % 29 <> 3 AS sound
      FROM entries e JOIN entries_k k ON k.l_orderkey = e.segment_id AND k.entry_idx = e.entry_idx WHERE e.kind IN ('data', 'inline', 'canonical_data') AND NOT (e.segment_id + e.entry_idx) % 97 = 11)""",
    "segments": f"""segments AS (SELECT o_orderkey % {VOLUMES_SQL} AS volume_id, o_orderkey AS segment_id,
      CASE WHEN o_orderkey % 5 = 0 THEN 'gc' WHEN o_orderkey % 5 = 1 THEN 'pending' ELSE 'index' END AS tier,
      CASE WHEN o_orderkey % 5 = 0 THEN list_filter([o_orderkey - 3 * {VOLUMES_SQL}, o_orderkey - 2 * {VOLUMES_SQL}, o_orderkey - {VOLUMES_SQL}], lambda x: x >= 0) ELSE [] END AS inputs,
      o_orderdate AS created, CAST(floor(o_totalprice) AS BIGINT) AS bytes FROM orders)""",
    "files": """files AS (SELECT doc_id AS file_id, '/' || source || '/' || lang || '/' || (doc_id // 100) || '/' || doc_id AS path, text AS body, sha256(text) AS hash, CAST(strlen(text) AS BIGINT) AS bytes FROM documents)""",
    "image_a": """image_a AS (SELECT * FROM files WHERE file_id % 7 <> 3)""",
    "image_b": """image_b0 AS (SELECT file_id, CASE WHEN file_id % 11 = 4 THEN '/moved' || path ELSE path END AS path, CASE WHEN file_id % 10 = 0 THEN body || ' changed' WHEN file_id % 10 = 5 THEN 'X' || substr(body, 2) ELSE body END AS body FROM files WHERE file_id % 7 <> 5),
      image_b AS (SELECT *, sha256(body) AS hash, CAST(strlen(body) AS BIGINT) AS bytes FROM image_b0)""",
    "lineage": """lineage AS (SELECT c_custkey AS volume_id, CASE WHEN c_custkey > 1 THEN c_custkey // 2 END AS parent_id, CASE WHEN c_custkey > 1 THEN c_custkey * 10 - c_custkey % 7 END AS branch_snapshot,
      CASE WHEN c_custkey % 9 = 0 THEN [c_custkey - 3, c_custkey - 5] ELSE [] END AS sources,
      CASE WHEN c_custkey % 4 = 0 THEN 'skeleton' WHEN c_custkey % 4 = 1 THEN 'unclassified' ELSE 'anchor' END AS role FROM customer)""",
    "journal": """journal AS (SELECT conv_id AS name, turn AS event_id,
      CASE WHEN turn = 0 THEN NULL WHEN turn >= 2 AND (conv_id + turn) % 13 = 0 THEN turn - 2 ELSE turn - 1 END AS prev_id,
      ['force_claim', 'claim', 'stop', 'start', 'release'][turn % 5 + 1] AS kind, conv_id * 1000 + turn AS stamp, CAST(length(text) AS BIGINT) AS payload FROM conversations)""",
    "requests": f"""requests AS (SELECT event_id AS request_id, (event_id * 31) % {LOG_SPACE_SQL} AS start_lba, (event_id * 31) % {LOG_SPACE_SQL} + 1 + event_id % 16 AS end_lba FROM events)""",
    "window": f"""win AS (SELECT (s_suppkey * 37) % {LOG_SPACE_SQL} AS start_lba, s_suppkey % 9 AS lba_length FROM supplier)""",
    # the current map of the write log, by last write
    "lbamap": """blocks AS (SELECT w.*, unnest(range(start_lba, start_lba + lba_length)) AS lba FROM wal w),
      tops AS (SELECT * FROM blocks QUALIFY row_number() OVER (PARTITION BY lba ORDER BY wal_id DESC, seq DESC) = 1),
      islands AS (SELECT *, lba - row_number() OVER (PARTITION BY seq ORDER BY lba) AS island FROM tops),
      lbamap AS (SELECT min(lba) AS start_lba, count(*) AS lba_length, any_value(hash) AS hash, min(lba) - any_value(start_lba) AS payload_block_offset, any_value(wal_id) AS claimant, seq FROM islands GROUP BY seq, island)""",
    # journal ranges, normalised
    "ranges": """win1 AS (SELECT start_lba, start_lba + lba_length AS end_lba FROM win WHERE lba_length > 0),
      win2 AS (SELECT *, max(end_lba) OVER (ORDER BY start_lba, end_lba ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM win1),
      win3 AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_lba > reach THEN 1 ELSE 0 END) OVER (ORDER BY start_lba, end_lba ROWS UNBOUNDED PRECEDING) AS island FROM win2),
      ranges AS (SELECT min(start_lba) AS start_lba, max(end_lba) AS end_lba FROM win3 GROUP BY island)""",
    # the map of the segments, in two phases: inputs by highest claimant, then outputs by horizon
    "volmap": """claims AS (SELECT e.volume_id, unnest(range(e.start_lba, e.start_lba + e.lba_length)) AS lba, e.start_lba, e.hash, e.segment_id, e.entry_idx, s.inputs, coalesce(list_max(s.inputs), -1) AS horizon
        FROM entries e JOIN segments s USING (segment_id) WHERE e.kind <> 'canonical_data'),
      base AS (SELECT volume_id, lba, struct_pack(c := segment_id, i := entry_idx, h := hash, s := start_lba, z := CAST(-1 AS BIGINT)) AS b FROM claims WHERE len(inputs) = 0
        QUALIFY row_number() OVER (PARTITION BY volume_id, lba ORDER BY segment_id DESC, entry_idx DESC) = 1),
      outs AS (SELECT volume_id, lba, list(struct_pack(c := segment_id, i := entry_idx, h := hash, s := start_lba, z := horizon) ORDER BY segment_id, entry_idx) AS o FROM claims WHERE len(inputs) > 0 GROUP BY ALL),
      folded AS (SELECT volume_id, lba, list_reduce(CASE WHEN b IS NULL THEN o WHEN o IS NULL THEN [b] ELSE list_concat([b], o) END,
          lambda a, x: CASE WHEN a.c <= x.z OR a.c = x.c OR (a.h = x.h AND a.c < x.c) THEN x ELSE a END) AS w FROM base FULL JOIN outs USING (volume_id, lba)),
      volisl AS (SELECT volume_id, lba, w.c AS claimant, w.i AS entry_idx, w.h AS hash, w.s AS anchor, lba - row_number() OVER (PARTITION BY volume_id, w.c, w.i ORDER BY lba) AS island FROM folded),
      volmap AS (SELECT volume_id, min(lba) AS start_lba, count(*) AS lba_length, any_value(hash) AS hash, min(lba) - any_value(anchor) AS payload_block_offset, claimant, entry_idx FROM volisl GROUP BY volume_id, claimant, entry_idx, island)""",
    # owners: first writer wins, over committed tiers in id order and then pending ones
    "owners": """ranked AS (SELECT e.*, s.tier, row_number() OVER (PARTITION BY e.hash ORDER BY CASE WHEN s.tier = 'pending' THEN 1 ELSE 0 END, e.segment_id, e.entry_idx) AS nth
        FROM entries e JOIN segments s USING (segment_id) WHERE e.kind IN ('data', 'inline', 'canonical_data') AND NOT e.journal),
      owners AS (SELECT hash, segment_id, entry_idx, kind, stored_length, tier FROM ranked WHERE nth = 1),
      delta_ranked AS (SELECT e.*, row_number() OVER (PARTITION BY e.hash ORDER BY CASE WHEN s.tier = 'pending' THEN 1 ELSE 0 END, e.segment_id, e.entry_idx) AS nth
        FROM entries e JOIN segments s USING (segment_id) WHERE e.kind = 'delta' AND NOT e.journal AND e.hash NOT IN (SELECT hash FROM owners)),
      delta_owners AS (SELECT hash, segment_id, entry_idx, delta_source, delta_length FROM delta_ranked WHERE nth = 1)""",
    "live": """live AS (SELECT DISTINCT hash FROM volmap UNION SELECT DISTINCT delta_source FROM entries WHERE delta_source IS NOT NULL)""",
    # each entry's fate under the current map
    "classes": f"""matches AS (SELECT e.segment_id, e.entry_idx, CAST(sum(least(m.start_lba + m.lba_length, e.start_lba + e.lba_length) - greatest(m.start_lba, e.start_lba)) AS BIGINT) AS live_blocks, count(*) AS runs
        FROM entries e JOIN volmap m ON m.volume_id = e.volume_id AND m.claimant = e.segment_id AND m.hash = e.hash AND m.start_lba < e.start_lba + e.lba_length AND e.start_lba < m.start_lba + m.lba_length
          AND greatest(m.start_lba, e.start_lba) - e.start_lba = m.payload_block_offset + greatest(m.start_lba, e.start_lba) - m.start_lba
        GROUP BY e.segment_id, e.entry_idx),
      states AS (SELECT e.*, coalesce(live_blocks, 0) AS live_blocks, coalesce(runs, 0) AS runs, l.hash IS NOT NULL AS is_live,
          CASE WHEN e.kind = 'delta' THEN coalesce(d.segment_id = e.segment_id, FALSE) ELSE coalesce(o.segment_id = e.segment_id, FALSE) END AS owns, s.hash IS NOT NULL AS resolvable
        FROM entries e LEFT JOIN matches USING (segment_id, entry_idx) LEFT JOIN live l ON l.hash = e.hash LEFT JOIN owners o ON o.hash = e.hash
        LEFT JOIN delta_owners d ON d.hash = e.hash LEFT JOIN owners s ON s.hash = e.delta_source),
      classes AS (SELECT *, CASE WHEN kind = 'zero' THEN 'zero_sub_runs'
          WHEN kind = 'canonical_data' THEN CASE WHEN is_live THEN 'fully_live' WHEN owns THEN 'drop_and_remove_hash' ELSE 'drop' END
          WHEN live_blocks = lba_length THEN 'fully_live'
          WHEN live_blocks = 0 THEN CASE WHEN owns AND is_live AND kind IN ('data', 'inline', 'delta') THEN 'demote_to_canonical' WHEN owns THEN 'drop_and_remove_hash' ELSE 'drop' END
          WHEN kind = 'delta' AND NOT resolvable THEN 'defer_unresolvable_delta' ELSE 'partial_death' END AS class,
          CASE WHEN kind IN ('data', 'inline', 'delta') AND live_blocks > 0 AND live_blocks < lba_length AND (kind <> 'delta' OR resolvable) THEN is_live ELSE FALSE END AS emit_canonical,
          CASE WHEN kind = 'delta' THEN delta_length WHEN kind IN ('zero', 'dedup_ref') THEN 0 ELSE stored_length END AS keep_cost FROM states)""",
    # liveness by segment
    "stats": f"""tallies AS (SELECT volume_id, segment_id, CAST(sum(keep_cost) AS BIGINT) AS total_bytes,
        CAST(sum(CASE WHEN class IN ('fully_live', 'demote_to_canonical', 'defer_unresolvable_delta') OR emit_canonical THEN keep_cost WHEN class = 'partial_death' THEN keep_cost * live_blocks // lba_length ELSE 0 END) AS BIGINT) AS retained_bytes,
        CAST(sum(CASE WHEN class IN ('fully_live', 'demote_to_canonical') THEN keep_cost WHEN class = 'partial_death' THEN live_blocks * {BLOCK_BYTES} + CASE WHEN emit_canonical THEN keep_cost ELSE 0 END ELSE 0 END) AS BIGINT) AS materialised_bytes,
        CAST(sum(CASE WHEN class = 'zero_sub_runs' THEN runs WHEN class IN ('drop', 'drop_and_remove_hash') THEN 0 ELSE 1 END) AS BIGINT) AS live_entries,
        CAST(sum(CASE WHEN class = 'partial_death' THEN runs + 1 WHEN class = 'zero_sub_runs' THEN runs WHEN class IN ('drop', 'drop_and_remove_hash') THEN 0 ELSE 1 END) AS BIGINT) AS output_entries,
        CAST(sum(CASE WHEN class = 'drop_and_remove_hash' THEN 1 ELSE 0 END) AS BIGINT) AS removed_hashes,
        bool_and(journal OR class IN ('drop', 'drop_and_remove_hash') OR (class = 'zero_sub_runs' AND runs = 0)) AS journal_only,
        bool_or(kind = 'inline') OR sum(stored_length) > 0 AS has_body FROM classes GROUP BY volume_id, segment_id),
      stats AS (SELECT volume_id, segment_id, total_bytes, retained_bytes, materialised_bytes, live_entries, output_entries, removed_hashes, has_body,
        CASE WHEN live_entries = 0 AND removed_hashes = 0 THEN 'tombstone' WHEN live_entries = 0 THEN 'stable' WHEN journal_only THEN 'journal' ELSE 'stable' END AS pool,
        CASE WHEN total_bytes > 0 THEN retained_bytes / CAST(total_bytes AS DOUBLE) ELSE 0.0 END AS density,
        greatest(total_bytes - retained_bytes, 0) AS reclaimable_bytes FROM tallies)""",
}
NEEDS = {
    "lbamap": ["wal"],
    "ranges": ["window"],
    "entry_bodies": ["entries"],
    "block_bodies": ["entries"],
    "image_a": ["files"],
    "image_b": ["files"],
    "volmap": ["entries", "segments"],
    "owners": ["entries", "segments"],
    "live": ["volmap"],
    "classes": ["live", "owners"],
    "stats": ["classes"],
}


def prelude(*names: str, recursive: bool = False) -> str:
    """``WITH`` and the table expressions that ``names`` need, in order."""
    done: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in done:
            done.append(name)

    for name in names:
        add(name)
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(SQL[n] for n in done) + "\n"
