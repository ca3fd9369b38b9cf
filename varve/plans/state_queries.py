"""Registered queries of state transitions, commits and studies, with their DuckDB SQL."""

from __future__ import annotations

import re as regexp

import pandas as pd
from pyspark.sql import functions as F

from varve.functions import sketches as sk
from varve.operators import compaction as gc
from varve.operators import content_index as ci
from varve.operators import intervals as iv
from varve.operators import read_path as rp
from varve.operators import reports as re
from varve.operators import similarity as si
from varve.operators import snapshots as sn
from varve.plans import compaction_queries as cq
from varve.plans import fixtures as fx
from varve.plans import index_queries as ix
from varve.plans import interval_queries as iq
from varve.plans import io_queries as io
from varve.plans import report_queries as rq
from varve.plans import storage_queries as sq
from varve.plans.fixtures import prelude
from varve.sources import text_formats as tf
from varve.sources.shared import cut
from varve.sources import wal_format as wf

def volume_ranges(s, d):
    """Each volume's journal ranges as text; ``none`` has no opinion, ``empty`` says that there are none."""
    t = fx.read(s, d, "supplier").select(F.col("s_nationkey").cast("long").alias("volume_id"), ((F.col("s_suppkey") * 3) % 40).alias("start_lba"), F.when(F.col("s_nationkey") % 5 == 1, 0).otherwise(F.col("s_suppkey") % 4).cast("long").alias("lba_length"))
    found = iv.normalise_ranges(t, ["volume_id"]).groupBy("volume_id").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("start_lba", "end_lba"))), lambda r: F.concat_ws("-", r["start_lba"].cast("string"), r["end_lba"].cast("string")))).alias("ranges"))
    every = t.select("volume_id").distinct()
    text = F.when(F.col("volume_id") % 5 == 0, "none").otherwise(F.coalesce("ranges", F.lit("empty")))
    return every.join(found, "volume_id", "left").select("volume_id", text.alias("ranges"))


def appended(s, d):
    folder = io.shared(s, "append")
    w = fx.wal(s, d).drop("ts")
    w.where("seq % 2 = 0").write.parquet(folder)
    w.where("seq % 2 = 1").write.mode("append").parquet(folder)
    return s.read.parquet(folder)


def stored_filemap(s, d):
    folder = io.shared(s, "filemap")
    tf.write_filemap(fx.files(s, d).select("path", F.lit(0).cast("long").alias("file_offset"), "hash", F.col("bytes").alias("byte_count")), folder)
    return tf.read_filemap(s, folder)


def round_trips(s, d):
    """Deltas of changed files, applied again."""
    a, b = fx.image(s, d, "a"), fx.image(s, d, "b")
    met = b.join(a.select("path", F.col("body").alias("old"), F.col("hash").alias("old_hash")), "path").where("hash <> old_hash")

    def back(old: pd.Series, new: pd.Series) -> pd.Series:
        return pd.Series([sk.apply_delta(o.encode(), sk.delta(o.encode(), n.encode())).decode() == n for o, n in zip(old, new, strict=True)])

    back.__annotations__ = {"old": pd.Series, "new": pd.Series, "return": pd.Series}
    return met.select("path", F.pandas_udf(back, "boolean")("old", "body").alias("same"))


def chain_economics(s, d):
    """Versions of a conversation: each against the one before and against the first."""
    c = fx.read(s, d, "conversations").where("length(text) > 0")
    first = c.groupBy("conv_id").agg(F.min(F.struct("turn", "text")).alias("f")).select("conv_id", F.col("f.text").alias("anchor"))
    prior = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("prior"))
    raw = lambda n: F.col(n).cast("binary")
    rows = c.join(prior, ["conv_id", "turn"]).join(first, "conv_id")
    rows = rows.select("turn", sk.compressed_length(raw("text")).alias("alone"), sk.delta_length(raw("prior"), raw("text")).alias("chained"), sk.delta_length(raw("anchor"), raw("text")).alias("anchored"))
    return rows.groupBy(F.least("turn", F.lit(8)).alias("distance")).agg(F.count("*").alias("n"), F.sum("alone").alias("alone"), F.sum("chained").alias("chained"), F.sum("anchored").alias("anchored"))


def dictionary_study(s, d):
    """Dictionaries of several sizes, trained on the early half of the segments of files, against the late half.

    Training samples are windows round-robin over all bodies of the half, a
    hundred times a dictionary's size in all; the oracle is trained on the half
    that it is tested on. By size bucket of the late bodies, and by dictionary:
    bytes alone, with the dictionary, and with the oracle's.
    """
    f = fx.files(s, d).withColumn("segment", F.floor(F.col("file_id") / 100))
    middle = f.agg(F.percentile_approx("segment", 0.5)).first()[0] or 0
    early, late = f.where(F.col("segment") <= middle), f.where(F.col("segment") > middle)
    raw = late.select("bytes", re.power_bucket(F.col("bytes")).alias("bucket"), F.col("body").cast("binary").alias("raw"))
    sizes = raw
    for size in DICTIONARIES:
        sizes = sizes.withColumn(f"held_out_{size}", sk.dictionary_length(F.col("raw"), trained(early, size))).withColumn(f"oracle_{size}", sk.dictionary_length(F.col("raw"), trained(late, size)))
    sums = [F.sum(c).alias(c) for size in DICTIONARIES for c in (f"held_out_{size}", f"oracle_{size}")]
    return sizes.withColumn("alone", sk.compressed_length(F.col("raw"))).groupBy("bucket").agg(F.count("*").alias("n"), F.sum("bytes").alias("plain"), F.sum("alone").alias("alone"), *sums)


#: Bytes of the dictionaries that are tried, and of a training window.
DICTIONARIES, WINDOW = (4096, 16384), 1024


def trained(files, size):
    """A dictionary of ``size`` bytes at most, from windows of a hundred times its size in all; empty where they are too few."""
    import zstandard

    chosen = si.training_windows(files.select(F.col("file_id").alias("body_id"), "bytes"), WINDOW, 100 * size)
    cut = F.substring(F.col("body").cast("binary"), (F.col("nth") * WINDOW + 1).cast("int"), WINDOW)
    rows = chosen.join(files.select(F.col("file_id").alias("body_id"), "body"), "body_id").select("nth", "body_id", cut.alias("part"))
    samples = [bytes(r["part"]) for r in rows.orderBy("nth", "body_id").collect()]  # 100 dictionary sizes and a window at most
    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if len(samples) >= 20 else b""
    except zstandard.ZstdError:
        return b""


def repacked(s, d):
    """What a repack of the pending segments does with each: packed by live bytes, left alone, or merged with the journal."""
    e, g, parts = fx.entries(s, d), fx.segments(s, d), fx.parts(s, d)
    held = iv.rebuilt(e, g, parts)
    known = gc.known(e, g, held, parts)
    pending, referenced = g.where("tier = 'pending'").select("segment_id"), known.where("is_live").select("m1", "m2")
    scan = gc.classified(e, g, held, parts, lambda c: gc.repack_scan(c.join(pending, "segment_id", "left_semi"), referenced), known)
    return gc.repacked(scan, cap_bytes=100_000, cap_entries=2_000)


def object_keys(s, d):
    """Keys of a store: a head for each volume, its snapshots' manifests, its segments."""
    g = fx.segments(s, d)
    heads = g.select(F.format_string("by_id/%d/HEAD", "volume_id").alias("key")).distinct()
    snapshots = sn.cuts(g, 6).select(F.format_string("by_id/%d/snapshots/%d.manifest", "volume_id", "cut").alias("key"))
    return heads.unionByName(snapshots).unionByName(g.select(F.format_string("by_id/%d/segments/%d", "volume_id", "segment_id").alias("key")))


def object_views(s, d):
    """Typed rows of the keys: ``view, volume_id, object_id``; a head has no id."""
    p = F.split("key", "/")
    rows = object_keys(s, d).select(p[1].cast("long").alias("volume_id"), p[2].alias("part"), F.regexp_replace(F.get(p, F.lit(3)), "[.]manifest$", "").cast("long").alias("object_id"))
    return rows.select(F.when(F.col("part") == "HEAD", "head").otherwise(F.col("part")).alias("view"), "volume_id", F.coalesce("object_id", F.lit(-1)).alias("object_id"))


def pass_state(s, d):
    """What a pass begins with, by volume: its runs and blocks, the claimed hashes that are live, the bodies it owns, and its floor."""
    e, g, m = fx.entries(s, d), fx.segments(s, d), cut(cq.volmap(s, d))
    runs = m.groupBy("volume_id").agg(F.count("*").alias("runs"), F.sum("lba_length").alias("blocks"), F.countDistinct("hash").alias("live"))
    owned = ci.data_owners(e, g).join(g.select("segment_id", "volume_id"), "segment_id").join(gc.live_hashes(m, e), "hash", "left_semi").groupBy("volume_id").agg(F.count("*").alias("owned_live"))
    return runs.join(owned, "volume_id", "left").join(sn.cuts(g, 6).withColumnRenamed("cut", "floor"), "volume_id", "left").fillna(0, ["owned_live"])


def directory():
    """The path up to and with its last slash: an order by path goes through one directory after the other."""
    return F.regexp_extract("path", "^(.*/)", 1)


def residual_blocks(s, d):
    """An image of all files, each on a boundary of eight blocks of 512 bytes: extents of files, and the blocks between them."""
    blocks = F.ceil(F.col("bytes") / 512)
    rows = fx.files(s, d).select("path", blocks.alias("blocks"), (F.ceil(blocks / 8) * 8).alias("room"))
    rows = rp.placed(rows, directory(), ["path"], "room").select(F.col("body_offset").alias("start_lba"), "blocks", "room")
    part = lambda a, b, kind: rows.select(a.alias("start_lba"), b.alias("end_lba"), F.lit(kind).alias("kind")).where("end_lba > start_lba")
    start, stop = F.col("start_lba"), F.col("start_lba") + F.col("blocks")
    return part(start, stop, "file").unionByName(part(stop, start + F.col("room"), "residual"))


def source_reads(s, d):
    """Sources that the resemblance search of each language tries, in order of target and rank."""
    m = rq.marks(s, d)
    found = si.candidates(m, si.postings(m))
    f = fx.read(s, d, "documents").select(F.col("doc_id").alias("target_id"), F.col("lang").alias("job"))
    size = fx.files(s, d).select(F.col("file_id").alias("source_id"), "bytes")
    return found.join(f, "target_id").join(size, "source_id").select("job", F.struct("target_id", "rank").alias("nth"), "hash", "bytes")


def reap_again(s, d):
    """Segments that an older view would reap, checked against the current one: what is still unreachable goes, the rest is refused."""
    e, g, cut = fx.entries(s, d), fx.segments(s, d), fx.segment_share(s, d, VIEW)
    old_e, old_g = e.where(F.col("segment_id") <= cut), g.where(F.col("segment_id") <= cut)
    parts = fx.parts(s, d)
    old = gc.unreachable(old_e, old_g, iv.rebuilt(old_e, old_g, parts), cq.FLOOR, parts).select("segment_id")
    now = gc.unreachable(e, g, iv.rebuilt(e, g, parts), cq.FLOOR, parts).select("segment_id", F.lit("reaped").alias("outcome"))
    return old.join(now, "segment_id", "left").fillna("refused", ["outcome"])


#: Share of the segments, in tenths, that the older view knows.
VIEW = 8
OLD_NAMES = ("entries", "segments", "claims", "base", "outs", "folded", "volisl", "volmap", "ranked", "owners", "delta_ranked", "delta_owners", "live", "owned", "reap")


def older(sql: str) -> str:
    """The table expressions of a chain under names of their own, over the older view's tables."""
    return regexp.sub(r"\b(" + "|".join(OLD_NAMES) + r")\b(?!\.)", r"old_\1", sql)


REAP_CHAIN = ", ".join(fx.SQL[n] for n in ("volmap", "owners", "live")) + cq.REAP
REAP_AGAIN = (
    prelude("entries", "segments")
    + f", old_entries AS (SELECT * FROM entries WHERE segment_id <= {fx.segment_share_sql(VIEW)}), old_segments AS (SELECT * FROM segments WHERE segment_id <= {fx.segment_share_sql(VIEW)}), "
    + older(REAP_CHAIN)
    + ", "
    + REAP_CHAIN
    + " SELECT segment_id, CASE WHEN segment_id IN (SELECT segment_id FROM reap) THEN 'reaped' ELSE 'refused' END AS outcome FROM old_reap"
)


QUERIES = {
    "i04_insert_with_horizon": (
        lambda s, d: iv.insert_consuming(iv.settled(fx.wal(s, d).select("start_lba", "lba_length", "hash", F.col("wal_id").alias("claimant"), "seq"), [F.col("claimant"), F.col("seq")], ["hash", "claimant"]), iq.outputs(s, d), horizon=True),
        iq.QUERIES["i03_insert_consuming"][1].replace("list_contains(o.inputs, t.wal_id)", "t.wal_id <= list_max(o.inputs)"),
    ),
    "i09_wal_recovery": (
        lambda s, d: iv.overlay(wf.parsed_logs(io.torn(s, d))),
        prelude("wal")
        + """, l AS (SELECT *, max(seq) OVER (PARTITION BY wal_id) AS last FROM wal), k AS (SELECT * FROM l WHERE NOT (wal_id % 3 = 0 AND seq = last)), b AS (SELECT k.*, unnest(range(start_lba, start_lba + lba_length)) AS lba FROM k),
t AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY lba ORDER BY wal_id DESC, seq DESC) = 1), i AS (SELECT *, lba - row_number() OVER (PARTITION BY seq ORDER BY lba) AS g FROM t)
SELECT min(lba) AS start_lba, count(*) AS lba_length, min(lba) - any_value(start_lba) AS payload_block_offset, any_value(hash) AS hash, any_value(wal_id) AS claimant, seq FROM i GROUP BY seq, g""",
    ),
    "i27_covering_fragment": (
        lambda s, d: fx.read(s, d, "labels").select(F.col("doc_id").alias("file_id"), ((F.col("doc_id") * 37) % 3000).alias("pos")).join(rp.chunk_table(fx.files(s, d), 700).withColumnRenamed("offset", "from_pos"), "file_id").where("pos >= from_pos and pos < from_pos + length").select("file_id", "pos", "chunk", "hash"),
        prelude("files")
        + ", p AS (SELECT doc_id AS file_id, (doc_id * 37) % 3000 AS pos FROM labels) SELECT p.file_id, pos, pos // 700 AS chunk, sha256(substr(body, pos // 700 * 700 + 1, 700)) AS hash FROM p JOIN files USING (file_id) WHERE pos < length(body)",
    ),
    "d05_insert_or_keep": (
        lambda s, d: fx.entries(s, d).where("kind in ('data', 'inline')").groupBy("hash").agg(F.min(F.struct("segment_id", "entry_idx")).alias("a"), F.max(F.struct("segment_id", "entry_idx")).alias("z")).select("hash", F.col("a.segment_id").alias("if_absent"), F.col("z.segment_id").alias("overwritten")),
        prelude("entries") + "SELECT hash, min(segment_id) AS if_absent, max(segment_id) AS overwritten FROM entries WHERE kind IN ('data', 'inline') GROUP BY hash",
    ),
    "d14_named_owners": (
        lambda s, d: ix.owners(s, d).join(ci.named_sources(fx.entries(s, d)).select("hash", "encodings"), "hash", "left").select("hash", F.coalesce("encodings", F.lit(0)).alias("encodings")),
        prelude("owners") + ", n AS (SELECT delta_source AS hash, count(*) AS encodings FROM entries WHERE delta_source IS NOT NULL GROUP BY 1) SELECT o.hash, coalesce(encodings, 0) AS encodings FROM owners o LEFT JOIN n ON n.hash = o.hash",
    ),
    "r05_delta_round_trip": (
        round_trips,
        prelude("image_a", "image_b") + "SELECT b.path, TRUE AS same FROM image_b b JOIN image_a a ON a.path = b.path AND a.hash <> b.hash",
    ),
    "s06_inline_section": (
        lambda s, d: fx.entries(s, d).where("kind = 'inline'").select("segment_id", "entry_idx", "stored_length", F.expr("substring(hash, 1, cast(stored_length % 16 as int))").alias("payload")),
        prelude("entries") + "SELECT segment_id, entry_idx, stored_length, substr(hash, 1, stored_length % 16) AS payload FROM entries WHERE kind = 'inline'",
    ),
    "s15_file_scan": (
        lambda s, d: rp.chunk_table(fx.files(s, d).select("path", "body"), 4096, key="path").select("path", F.col("offset").alias("file_offset"), F.col("length").alias("byte_count"), "hash"),
        prelude("files")
        + ", c AS (SELECT path, body, unnest(range(0, CAST(ceil(length(body) / 4096.0) AS BIGINT))) AS k FROM files WHERE length(body) > 0) SELECT path, k * 4096 AS file_offset, CAST(length(substr(body, k * 4096 + 1, 4096)) AS BIGINT) AS byte_count, sha256(substr(body, k * 4096 + 1, 4096)) AS hash FROM c",
    ),
    "s17_volume_ranges": (
        volume_ranges,
        """WITH t AS (SELECT CAST(s_nationkey AS BIGINT) AS volume_id, (s_suppkey * 3) % 40 AS a, CASE WHEN s_nationkey % 5 = 1 THEN 0 ELSE s_suppkey % 4 END AS n FROM supplier), b AS (SELECT DISTINCT volume_id, unnest(range(a, a + n)) AS x FROM t WHERE n > 0),
i AS (SELECT *, x - row_number() OVER (PARTITION BY volume_id ORDER BY x) AS g FROM b), r AS (SELECT volume_id, min(x) AS a, max(x) + 1 AS z FROM i GROUP BY volume_id, g), j AS (SELECT volume_id, string_agg(a || '-' || z, ',' ORDER BY a) AS ranges FROM r GROUP BY volume_id)
SELECT v.volume_id, CASE WHEN v.volume_id % 5 = 0 THEN 'none' ELSE coalesce(ranges, 'empty') END AS ranges FROM (SELECT DISTINCT volume_id FROM t) v LEFT JOIN j ON j.volume_id = v.volume_id""",
    ),
    "k01_append": (appended, prelude("wal") + "SELECT seq, wal_id, start_lba, lba_length, kind, hash, data_length FROM wal"),
    "k05_filemap_file": (stored_filemap, prelude("files") + "SELECT path, CAST(0 AS BIGINT) AS file_offset, hash, bytes AS byte_count FROM files"),
    "a12_dictionary_study": (dictionary_study, None),
    "a14_chain_economics": (chain_economics, None),
    "sk10_reserved_sources": (
        lambda s, d: rq.QUERIES["sk09_same_place"][0](s, d).select("source_hash").distinct(),
        "SELECT DISTINCT source_hash FROM (" + rq.QUERIES["sk09_same_place"][1] + ")",
    ),
    "g03_home_ownership": (
        lambda s, d: fx.entries(s, d).join(ix.owners(s, d).select("hash", "segment_id", F.lit(True).alias("home")), ["hash", "segment_id"], "left").groupBy("kind").agg(F.count("*").alias("entries"), F.count("home").alias("at_home")),
        prelude("owners") + "SELECT e.kind, count(*) AS entries, count(o.hash) AS at_home FROM entries e LEFT JOIN owners o ON o.hash = e.hash AND o.segment_id = e.segment_id GROUP BY e.kind",
    ),
    "g14_repack": (repacked, None),
    "g17_reap_apply": (reap_again, REAP_AGAIN),
    "s19_image_extents": (
        lambda s, d: rp.placed(fx.image(s, d, "a"), directory(), ["path"], "bytes").select("path", F.col("body_offset").alias("start_byte"), "bytes"),
        prelude("image_a") + "SELECT path, CAST(coalesce(sum(bytes) OVER (ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_byte, bytes FROM image_a",
    ),
    "s30_residual_blocks": (
        residual_blocks,
        prelude("files")
        + """, b AS (SELECT path, CAST(ceil(bytes / 512.0) AS BIGINT) AS blocks FROM files), x AS (SELECT *, (blocks + 7) // 8 * 8 AS room FROM b), y AS (SELECT *, CAST(sum(room) OVER (ORDER BY path ROWS UNBOUNDED PRECEDING) - room AS BIGINT) AS start_lba FROM x)
SELECT start_lba, start_lba + blocks AS end_lba, 'file' AS kind FROM y WHERE blocks > 0 UNION ALL SELECT start_lba + blocks, start_lba + room, 'residual' FROM y WHERE room > blocks""",
    ),
    "r04_slices": (
        lambda s, d: fx.files(s, d).select("file_id", F.substring("body", ((F.col("file_id") % 7) * 64 + 1).cast("int"), F.lit(128)).alias("slice")),
        prelude("files") + "SELECT file_id, substr(body, file_id % 7 * 64 + 1, 128) AS slice FROM files",
    ),
    "sk05_index_report": (
        lambda s, d: rq.si.index_stats(rq.marks(s, d)).select("sources", (F.col("postings") / F.col("features")).alias("mean_list"), (F.col("at_cap") / F.col("features")).alias("capped_share")),
        None,
    ),
    "g04_pass_state": (
        pass_state,
        prelude("live", "owners")
        + sq.MANIFEST
        + """, a AS (SELECT volume_id, count(*) AS runs, CAST(sum(lba_length) AS BIGINT) AS blocks, count(DISTINCT hash) AS live FROM volmap GROUP BY 1), b AS (SELECT s.volume_id, count(*) AS owned_live FROM owners o JOIN segments s USING (segment_id) WHERE o.hash IN (SELECT hash FROM live) GROUP BY 1)
SELECT a.volume_id, runs, blocks, live, coalesce(owned_live, 0) AS owned_live, cut AS floor FROM a LEFT JOIN b USING (volume_id) LEFT JOIN cuts USING (volume_id)""",
    ),
    "s28_object_views": (
        object_views,
        prelude("segments") + sq.MANIFEST + " SELECT DISTINCT 'head' AS view, volume_id, CAST(-1 AS BIGINT) AS object_id FROM segments UNION ALL SELECT 'snapshots', volume_id, cut FROM cuts UNION ALL SELECT 'segments', volume_id, segment_id FROM segments",
    ),
    "g23_evict": (
        lambda s, d: ci.evicted(fx.entries(s, d), fx.segments(s, d).where("tier <> 'pending' and volume_id % 4 = 1").select("segment_id")).groupBy("volume_id").agg(F.sum(F.col("dropped").cast("long")).alias("dropped"), F.sum(F.when(F.col("dropped"), F.col("stored_length")).otherwise(0)).alias("bytes"), F.sum(F.col("present").cast("long")).alias("present")),
        prelude("entries", "segments")
        + ", x AS (SELECT e.*, e.present AND e.kind IN ('data', 'canonical_data') AND s.tier <> 'pending' AND s.volume_id % 4 = 1 AS dropped FROM entries e JOIN segments s USING (segment_id)) SELECT volume_id, count(*) FILTER (dropped) AS dropped, CAST(sum(CASE WHEN dropped THEN stored_length ELSE 0 END) AS BIGINT) AS bytes, count(*) FILTER (present AND NOT dropped) AS present FROM x GROUP BY volume_id",
    ),
    "sk13_source_cache": (lambda s, d: si.cached_reads(source_reads(s, d), 200_000).groupBy("job").agg(F.count("*").alias("reads"), F.sum(F.col("hit").cast("long")).alias("hits"), F.sum(F.when(F.col("hit"), 0).otherwise(F.col("bytes"))).alias("bytes_read")), None),
}
