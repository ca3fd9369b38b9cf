"""Sources, sketches, packing and streams: round trips, torn inputs, and plain versions."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from varve.functions import sketches as sk
from varve.operators import compaction as gc
from varve.operators import fetching as fe
from varve.operators import read_path as rp
from varve.operators import similarity as si
from varve.sources import text_formats as tf
from varve.sources import wal_format as wf
from varve.streaming import log

RECORDS = st.lists(st.tuples(st.sampled_from(sorted(wf.KINDS)), st.binary(min_size=32, max_size=32).map(bytes.hex), st.integers(0, 2**40), st.integers(0, 2**20), st.integers(0, 2**40), st.binary(max_size=30)), max_size=6)


@settings(max_examples=60, deadline=None)
@given(RECORDS, st.data())
def test_a_torn_log_gives_its_durable_prefix(records, data):
    content = wf.encode(records)
    assert wf.parse(content) == (records, len(content), False)
    cut = data.draw(st.integers(0, len(content)))
    found, valid, torn = wf.parse(content[:cut])
    assert found == records[: len(found)] and valid <= cut and torn == (valid < cut)


@settings(max_examples=40, deadline=None)
@given(RECORDS.filter(bool), st.data())
def test_a_damaged_log_gives_what_is_before_the_damage(records, data):
    content = bytearray(wf.encode(records))
    at = data.draw(st.integers(len(wf.MAGIC), len(content) - 1))
    content[at] ^= 0xFF
    found, valid, torn = wf.parse(bytes(content))
    assert torn and valid <= at and found == records[: len(found)]


def test_logs_from_files(spark, tmp_path):
    records = [("data", "ab" * 32, 7, 2, 0, b"xyz"), ("zero", "00" * 32, 9, 1, 1, b"")]
    for i, content in ((3, wf.encode(records)), (4, wf.encode(records)[:-1]), (5, b"not a log"), (6, b"")):
        (tmp_path / f"{i}.wal").write_bytes(content)
    got = sorted((r.wal_id, r.seq, r.kind, r.is_truncated) for r in wf.read_logs(spark, str(tmp_path)).collect())
    assert got == [(3, 0, "data", False), (3, 1, "zero", False), (4, 0, "data", True)]


def test_filemap_header_and_lines(spark, tmp_path):
    rows = spark.createDataFrame([("/b", 0, "h1", 5), ("/a", 0, "h2", 6), ("/a", 6, "h3", 1)], "path string, file_offset long, hash string, byte_count long")
    tf.write_filemap(rows, str(tmp_path / "map"))
    assert sorted(map(tuple, tf.read_filemap(spark, str(tmp_path / "map")).collect())) == sorted(map(tuple, rows.collect()))
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.txt").write_text("/a\t0\th\t1\n")
    with pytest.raises(ValueError):
        tf.read_filemap(spark, str(tmp_path / "bad"))
    with pytest.raises(Exception, match="not a filemap line"):
        tf.parse_filemap(spark.createDataFrame([("/a\t0",)], "value string")).collect()


def test_head_sections_carry(spark):
    head = spark.createDataFrame([(1, "added", 30), (1, "added", 4), (1, "tombstoned", 9), (2, "superseded", 1)], "volume_id long, section string, segment_id long")
    assert sorted(map(tuple, tf.parse_head(tf.head_lines(head)).collect())) == sorted(map(tuple, head.collect()))
    first = [r.value for r in tf.head_lines(head).where("volume_id = 1").orderBy("line").collect()]
    assert first == ["[anchor]", "[added]", "4", "30", "[superseded]", "[tombstoned]", "9"]


@settings(max_examples=30, deadline=None)
@given(st.binary(min_size=1, max_size=300))
def test_rolling_hash_steps(data):
    h, out = 0, []
    for b in data:
        h = ((h << 1) + int(sk.GEAR[b])) & (2**64 - 1)
        out.append(h)
    assert sk.rolling(data).tolist() == out


def test_sketches_of_like_bodies():
    rng = np.random.default_rng(0)
    body = rng.integers(0, 256, 60_000).astype(np.uint8).tobytes()
    other = body[:30_000] + b"changed" + body[30_000:]
    a, b = sk.sketch(body), sk.sketch(other)
    assert sk.sketch(b"short") is None and len(a) == sk.FEATURES
    assert len(set(a) & set(b)) >= 6
    assert sk.apply_delta(body, sk.delta(body, other)) == other
    assert len(sk.delta(body, other)) < 200


def test_super_feature_parameters(spark):
    with pytest.raises(ValueError):
        sk.sketch_column(F.col("x"), n=6, group=4)


def test_similarity_cap_and_dedup(spark):
    rows = [(i, i, f"h{i // 2}", [7, i, i]) for i in range(40)]
    sketches = spark.createDataFrame([(a, b, h, s) for a, b, h, s in rows], "source_id long, target_id long, hash string, sketch array<long>")
    index = si.postings(sketches)
    assert index.where("feature = 7").count() == 32 and index.where("feature = 39").count() == 1
    found = si.candidates(sketches.where("target_id = 39"), index).orderBy("rank").collect()
    assert [(r.source_id, r.shared) for r in found] == [(0, 1), (2, 1), (4, 1), (6, 1)]  # 39 itself: feature 39 alone, after them
    assert [r.source_id for r in si.candidates(sketches.where("target_id = 8"), index).orderBy("rank").collect()] == [8, 0, 2, 4]
    assert si.candidates(sketches, index, 0).count() == 0


def bodies(n=40):
    """Bodies of which many share long stretches."""
    rnd = random.Random(6)
    base = [" ".join(f"w{rnd.randrange(900)}" for _ in range(700)) for _ in range(5)]
    out = []
    for i in range(n):
        words = rnd.choice(base).split()
        for _ in range(rnd.choice([0, 1, 10, 60])):
            words[rnd.randrange(len(words))] = f"x{rnd.randrange(900)}"
        out.append((i, " ".join(words) if i % 9 else "short"))
    return out


def test_similarity_index_against_brute_force(spark):
    """Postings, candidates, counts and pairs over sketches of whole bodies, one by one in Python."""
    sketch = {i: sk.sketch(t.encode(), least_bytes=1024) for i, t in bodies()}
    hashes = {i: t[:3] + str(hash(t)) for i, t in bodies()}
    table = spark.createDataFrame([(i, i, hashes[i], t) for i, t in bodies()], "source_id long, target_id long, hash string, body string")
    sketches = table.select("source_id", "target_id", "hash", sk.sketch_column(F.col("body").cast("binary"), least_bytes=1024).alias("sketch"))
    lists = {}
    for i, s in sorted(sketch.items()):
        for f in dict.fromkeys(s or ()):
            if len(lists.setdefault(f, [])) < 3:
                lists[f].append(i)
    index = si.postings(sketches, 3)
    assert sorted((r.feature, r.place, r.source_id) for r in index.collect()) == sorted((f, k + 1, i) for f, ids in lists.items() for k, i in enumerate(ids))
    got = {}
    for r in si.candidates(sketches, index).orderBy("target_id", "rank").collect():
        got.setdefault(r.target_id, []).append((r.source_id, r.shared))
    for i, s in sketch.items():
        shared = {}
        for f in set(s or ()):
            for j in lists[f]:
                shared[j] = shared.get(j, 0) + 1
        best = {}
        for j, n in sorted(shared.items(), key=lambda x: (-x[1], x[0])):
            best.setdefault(hashes[j], (j, n))
        assert got.get(i, []) == sorted(best.values(), key=lambda x: (-x[1], x[0]))[:4]
    stats = si.index_stats(sketches, 3).first()
    assert (stats.sources, stats.features, stats.postings, stats.longest, stats.at_cap) == (sum(s is not None for s in sketch.values()), len(lists), sum(map(len, lists.values())), max(map(len, lists.values())), sum(len(x) == 3 for x in lists.values()))
    first = {}
    for i, s in sorted(sketch.items()):
        if s is not None:
            first.setdefault(tuple(s), i)
    cells = {}
    for s, i in first.items():
        for cell in enumerate(s):
            cells.setdefault(cell, []).append(i)
    for cap in (2, 100):
        want = {}
        by_id = {i: s for s, i in first.items()}
        for ids in cells.values():
            if 1 < len(ids) <= cap:
                want |= {(min(a, b), max(a, b)): sum(x == y for x, y in zip(by_id[a], by_id[b], strict=True)) for a in ids for b in ids if a != b}
        assert {(r.a, r.b): r.shared for r in si.positional_overlap(sketches, cap).collect()} == want


def test_sources_are_skipped_within_the_candidates(spark):
    found = spark.createDataFrame([(1, 10, "own", 8, 1), (1, 11, "dead", 7, 2), (1, 12, "good", 6, 3), (1, 13, "good2", 5, 4), (2, 10, "own", 3, 1), (3, 12, "good", 2, 1)], "target_id long, source_id long, hash string, shared long, rank int")
    targets = spark.createDataFrame([(1, "own"), (2, "taken"), (3, "x")], "target_id long, own string")
    one = lambda *hashes: spark.createDataFrame([(h,) for h in hashes], "hash string")
    got = si.chosen_sources(found, targets, one("own", "good", "good2"), one("taken")).collect()
    assert sorted(map(tuple, got)) == [(1, 12, 6), (3, 12, 2)]


@pytest.mark.parametrize("seed", range(3))
def test_first_fit_decreasing(spark, seed):
    rnd = random.Random(seed)
    rows = [(v, v * 100 + i, rnd.choice(["stable", "tombstone"]), rnd.randrange(1, 60), rnd.randrange(1, 5), 0.5, 1, True) for v in range(3) for i in range(25)]
    stats = spark.createDataFrame(rows, "volume_id long, segment_id long, pool string, materialised_bytes long, output_entries long, density double, reclaimable_bytes long, has_body boolean")
    got = {(r.volume_id, r.segment_id): r.bucket for r in gc.packed(stats, 100, 12, 3).collect()}
    want = {}
    for v in range(3):
        rooms = []
        for r in sorted((r for r in rows if r[0] == v and r[2] == "stable"), key=lambda r: (-r[3], r[1])):
            at = next((i for i, (b, e) in enumerate(rooms) if r[3] <= b and r[4] <= e), None)
            if at is None and len(rooms) < 3:
                rooms.append([100, 12])
                at = len(rooms) - 1
            if at is not None:
                rooms[at][0] -= r[3]
                rooms[at][1] -= r[4]
                want[v, r[1]] = at
        want |= {(v, r[1]): 0 for r in rows if r[0] == v and r[2] == "tombstone"}
    assert got == want


def test_warm_batches(spark):
    rows = [(1, i, kind, size, present) for i, (kind, size, present) in enumerate([("data", 5, False), ("data", 5, False), ("canonical_data", 9, True), ("data", 4, False), ("data", 20, False), ("dedup_ref", 0, False), ("data", 1, False), ("inline", 3, False), ("data", 1, False), ("data", 1, False)], 1)]
    entries = rp.offsets(spark.createDataFrame(rows, "segment_id long, entry_idx long, kind string, stored_length long, present boolean"), "segment_id", ["entry_idx"], "stored_length")
    got = sorted((r.batch, r.first_entry, r.entries, r.bytes) for r in fe.warm_batches(entries, 10).collect())
    # the present entry ends a batch, the cap does, and the inline entry leaves a gap; the reference leaves none
    assert got == [(0, 1, 2, 10), (1, 4, 1, 4), (2, 5, 1, 20), (3, 7, 1, 1), (4, 9, 2, 2)]


@pytest.mark.parametrize("seed", range(3))
def test_reads_ahead_against_a_plain_loop(spark, seed):
    rnd = random.Random(seed)
    rows = [(s, i, rnd.choice(["data", "data", "data", "canonical_data", "inline", "zero"]), rnd.choice([0, 3, 5, 9]), rnd.random() < 0.2) for s in range(6) for i in range(1, 25)]
    rows = [(s, i, k, 0 if k == "zero" else n, p) for s, i, k, n, p in rows]
    entries = rp.offsets(spark.createDataFrame(rows, "segment_id long, entry_idx long, kind string, stored_length long, present boolean"), "segment_id", ["entry_idx"], "stored_length")
    at, offset = {}, {}
    for s, i, _, n, _ in rows:
        offset[s, i] = at.get(s, 0)
        at[s] = offset[s, i] + n
    by = {(s, i): (k, n, p) for s, i, k, n, p in rows}
    targets = [(s, i) for s, i, k, _, _ in rows if k in ("data", "canonical_data") and i % 3 == 1]
    got = {(r.segment_id, r.target): (r.entries, r.bytes) for r in fe.forward_reads(entries, spark.createDataFrame(targets, "segment_id long, entry_idx long"), 20).collect()}
    for s, i in targets:
        count, stop, j = 1, offset[s, i] + by[s, i][1], i + 1
        while (s, j) in by:
            k, n, p = by[s, j]
            if k not in ("data", "canonical_data") or offset[s, j] != stop or p or stop + n - offset[s, i] > 20:
                break
            count, stop, j = count + 1, stop + n, j + 1
        assert got[s, i] == (count, stop - offset[s, i])


def test_an_epoch_run_again_replaces_itself(spark, tmp_path):
    rows = [(k, k // 4, k * 3 % 17, 1 + k % 4, f"h{k % 3}") for k in range(40)]
    wal = spark.createDataFrame(rows, "seq long, wal_id long, start_lba long, lba_length long, hash string")
    for epoch, part in ((0, "seq < 20"), (1, "seq >= 20"), (1, "seq >= 20")):
        log.winners(wal.where(part)).write.mode("overwrite").parquet(f"{tmp_path}/winners/epoch={epoch}")
    from varve.operators import intervals as iv

    assert sorted(map(tuple, log.current_map(spark, str(tmp_path)).collect())) == sorted(map(tuple, iv.overlay(wal).collect()))


def stream_of(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(folder)


def test_a_stream_that_failed_goes_on_where_it_stopped(spark, tmp_path):
    """The sink fails once inside an epoch; the restarted query gives the same map as one that never failed."""
    import json
    import time

    from pyspark.sql.streaming import StreamingQueryException

    from varve.operators import intervals as iv

    rnd = random.Random(3)
    schema = "seq long, wal_id long, start_lba long, lba_length long, hash string"
    rows = [{"seq": k, "wal_id": k // 8, "start_lba": rnd.randrange(30), "lba_length": 1 + k % 4, "hash": f"h{k % 5}"} for k in range(64)]
    (tmp_path / "in").mkdir()
    for part in range(4):
        (tmp_path / "in" / f"{part}.json").write_text("\n".join(json.dumps(r) for r in rows[16 * part : 16 * part + 16]))
        time.sleep(0.01)
    folder, real, seen = str(tmp_path / "out"), log.winners, []

    def failing(batch):
        seen.append(1)
        if len(seen) == 3:
            raise RuntimeError("lost")
        return real(batch)

    log.winners = failing
    try:
        with pytest.raises(StreamingQueryException):
            log.overlay_stream(stream_of(spark, str(tmp_path / "in"), schema), folder).awaitTermination()
    finally:
        log.winners = real
    log.overlay_stream(stream_of(spark, str(tmp_path / "in"), schema), folder).awaitTermination()
    want = iv.overlay(spark.createDataFrame([tuple(r.values()) for r in rows], schema))
    assert sorted(map(tuple, log.current_map(spark, folder).collect())) == sorted(map(tuple, want.collect()))


def test_retention_in_state(spark, tmp_path):
    """An input leaves once the watermark is past its retention; one that is named again waits from then on."""
    import json
    import time

    schema = "input long, output long, since timestamp"
    (tmp_path / "in").mkdir()
    batches = [
        [(1, 10, "2024-01-01"), (2, 11, "2024-01-01")],
        [(2, 12, "2024-01-09"), (3, 13, "2024-01-09")],
        [(4, 14, "2024-01-12")],
        [(5, 15, "2024-03-01")],
        [(6, 16, "2024-03-01")],
    ]
    for i, rows in enumerate(batches):
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(json.dumps({"input": a, "output": b, "since": c}) for a, b, c in rows))
        time.sleep(0.01)
    found = log.run_to_folder(log.retained(stream_of(spark, str(tmp_path / "in"), schema), 10), str(tmp_path / "out"), "append")
    assert sorted((r.input, r.output, str(r.since)[:10]) for r in found.collect()) == [(1, 10, "2024-01-01"), (2, 12, "2024-01-09"), (3, 13, "2024-01-09"), (4, 14, "2024-01-12")]


def test_retention_keeps_neighbours_under_one_key(spark, tmp_path):
    """Thousands of inputs need a few keys of state, and each still leaves in its own time."""
    schema = "input long, output long, since timestamp"
    day = lambda i: "2024-01-01" if i % 3 else "2024-02-01"
    rows = [(i, i + 7, day(i)) for i in range(5000)] + [(i, i + 9, "2024-02-01") for i in range(1, 5000, 6)]
    edges = spark.createDataFrame(rows, "input long, output long, since string").withColumn("since", F.to_timestamp("since"))
    edges.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    found = log.run_to_folder(log.retained(stream, 10), str(tmp_path / "out"), "append")
    want = [(i, i + 7, "2024-01-01") for i in range(5000) if i % 3 and i % 6 != 1]
    assert sorted((r.input, r.output, str(r.since)[:10]) for r in found.collect()) == want
    assert spark.read.format("statestore").load(str(tmp_path / "out" / "checkpoint")).count() == 5


def test_a_tick_follows_each_epoch(spark, tmp_path):
    import json
    import time

    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"seq": i, "wal_id": 0, "start_lba": i, "lba_length": 1, "hash": "h"}))
        time.sleep(0.01)
    ticks = []
    query = log.ticking(stream_of(spark, str(tmp_path / "in"), "seq long, wal_id long, start_lba long, lba_length long, hash string"), str(tmp_path / "out"), lambda s, folder, epoch: ticks.append((epoch, log.current_map(s, folder).count())), "200 milliseconds")
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert ticks == [(0, 1), (1, 2), (2, 3)]


@pytest.mark.parametrize("caps", [(10, 100), (10**6, 7), (25, 3)])
def test_epochs_against_a_plain_loop(spark, caps):
    rnd = random.Random(1)
    rows = [(w, 100 * w + k, rnd.randrange(12)) for w in range(4) for k in range(30)]
    got = {(r.wal_id, r.epoch): (r.first_seq, r.last_seq, r.entries, r.bytes) for r in log.epochs(spark.createDataFrame(rows, "wal_id long, seq long, data_length long"), *caps).collect()}
    want = {}
    for w in range(4):
        epoch, held = 0, []
        for _, seq, n in (r for r in rows if r[0] == w):
            if held and (sum(x for _, x in held) >= caps[0] or len(held) >= caps[1]):
                epoch, held = epoch + 1, []
            held.append((seq, n))
            want[w, epoch] = (held[0][0], seq, len(held), sum(x for _, x in held))
    assert got == want
