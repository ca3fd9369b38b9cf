"""Stored segments, caches, snapshots, rewrites and names, against plain versions and round trips."""

import hashlib
import random
from collections import Counter, OrderedDict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from varve.operators import compaction as gc
from varve.operators import content_index as ci
from varve.operators import events as ev
from varve.operators import intervals as iv
from varve.operators import lineage as li
from varve.operators import read_path as rp
from varve.operators import rewrite as rw
from varve.operators import similarity as si
from varve.operators import snapshots as sn
from varve.sources import cache_format as cf
from varve.sources import segment_store as ss

ENTRY = "volume_id long, segment_id long, entry_idx long, kind string, hash string, start_lba long, lba_length long, stored_length long, journal boolean, delta_source string, delta_length long, present boolean"
SEGMENT = "volume_id long, segment_id long, tier string, inputs array<long>"
ZERO = "0" * 64


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def made(spark, rnd, segments=24, space=40):
    """Random segments of two volumes that overwrite each other often, and the tables of them."""
    entries, tiers = [], []
    for s in range(segments):
        tiers.append((s % 2, s, rnd.choice(["index", "index", "pending"]), []))
        for i in range(1, rnd.randrange(2, 7)):
            kind = rnd.choice(["data", "data", "inline", "delta", "zero", "dedup_ref", "canonical_data"])
            h = ZERO if kind == "zero" else sha(("d" if kind == "delta" else "") + str(rnd.randrange(12)))
            claims = kind != "canonical_data"
            entries.append((s % 2, s, i, kind, h, rnd.randrange(space) if claims else 0, rnd.randrange(1, 5) if claims else 0, 0 if kind in ("zero", "dedup_ref") else rnd.randrange(1, 900), False, sha(str(rnd.randrange(12))) if kind == "delta" else None, 10 if kind == "delta" else 0, rnd.random() < 0.7))
    return spark.createDataFrame(entries, ENTRY), spark.createDataFrame(tiers, SEGMENT), entries


# --- stored segments ---


def test_segments_round_trip_and_damage(spark, tmp_path):
    entries, _, rows = made(spark, random.Random(1))
    ss.write_segments(entries, str(tmp_path / "s"), entries.select("segment_id", "entry_idx", F.col("hash").alias("body")), buckets=3)
    found = ss.read_verified(spark, str(tmp_path / "s"))
    assert sorted(tuple(r) for r in found.select(*entries.columns).collect()) == sorted(rows, key=lambda r: r[1:3]) or Counter(tuple(r) for r in found.select(*entries.columns).collect()) == Counter(rows)
    at = {}
    for r in sorted(found.collect(), key=lambda r: (r.segment_id, r.entry_idx)):
        assert r.section_offset == at.get((r.segment_id, r.section), 0)
        at[r.segment_id, r.section] = r.section_offset + r.section_length
    changed = ss.read_index(spark, str(tmp_path / "s")).withColumn("lba_length", F.col("lba_length") + (F.col("segment_id") == 4).cast("long"))
    good = {r.segment_id for r in ss.intact(changed, spark.read.parquet(str(tmp_path / "s" / "marks"))).collect()}
    assert good == {r[1] for r in rows} - {4}
    assert ss.read_bodies(spark, str(tmp_path / "s")).count() == len(rows)


def test_a_drain_run_again_adds_nothing(spark, tmp_path):
    store = str(tmp_path / "store")
    part = lambda n: spark.range(n).withColumnRenamed("id", "segment_id")
    for epoch, n in ((0, 5), (1, 9), (1, 9), (0, 5), (2, 9)):
        ss.drain(part(n), store, epoch)
    assert sorted((r.segment_id, r.epoch) for r in ss.drained(spark, store).collect()) == [(i, 0 if i < 5 else 1) for i in range(9)]


# --- caches ---


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**32 - 1), st.binary(max_size=20)), max_size=6), st.data())
def test_a_cut_cache_gives_its_whole_records(records, data):
    content = cf.encode(records)
    found, cut = cf.parse(content)
    assert [(i, d) for i, _, d in found] == records and not cut
    stop = data.draw(st.integers(0, len(content)))
    found, cut = cf.parse(content[:stop])
    assert [(i, d) for i, _, d in found] == records[: len(found)]
    assert cut == (stop < len(cf.MAGIC) or stop != len(cf.encode(records[: len(found)])))


def test_a_cache_record_that_fails_its_check_ends_the_scan():
    content = cf.encode([(1, b"good"), (2, b"bad"), (3, b"good")])
    found, cut = cf.parse(content, lambda i, data: data == b"good")
    assert [i for i, _, _ in found] == [1] and cut
    assert cf.parse(cf.MAGIC + cf.record(1, b"x", flags=4)) == ([], True)


def test_reads_through_a_cache(spark):
    caches = cf.encoded_caches(spark.createDataFrame([(1, 1, "one"), (1, 2, "old"), (1, 2, "two")], "segment_id long, entry_idx long, body string").coalesce(1))
    wanted = spark.createDataFrame([(1, 1), (1, 3), (2, 1), (2, 1), (3, 9)], "segment_id long, entry_idx long")
    bodies = spark.createDataFrame([(1, 3, "three"), (2, 1, "new")], "segment_id long, entry_idx long, body string")
    reads, added = cf.read_through(wanted, caches, bodies)
    assert sorted((r.segment_id, r.entry_idx, r.body, r.hit) for r in reads.collect() if r.body) == [(1, 1, "one", True), (1, 3, "three", False), (2, 1, "new", False), (2, 1, "new", False)]
    assert sorted(map(tuple, added.collect())) == [(1, 3, "three"), (2, 1, "new")]


# --- rewrites ---


@pytest.mark.parametrize("seed", range(3))
def test_a_rewrite_changes_no_read(spark, seed):
    """Every block reads the same before and after a pass is applied, whatever came between, and inputs own nothing after it."""
    rnd = random.Random(seed)
    entries, segments, rows = made(spark, rnd)
    body = {}
    for _, s, i, kind, h, _, n, *_ in rows:
        if kind in ("data", "inline", "canonical_data"):
            body[s, i] = "".join(sha(f"{h}:{b}") for b in range(max(1, n)))
    gone, damaged = set(list(body)[::17]), set(list(body)[5::19])
    bodies = spark.createDataFrame([(s, i, b, (s, i) not in damaged) for (s, i), b in body.items() if (s, i) not in gone], "segment_id long, entry_idx long, body string, sound boolean")
    held = iv.rebuild(entries, segments)
    classes = gc.classified(entries, segments, held)
    plan = gc.plan_rows(classes, gc.candidates(gc.segment_stats(classes), 1.1), held)
    made_rows = rw.materialised(plan, entries, bodies, ZERO)
    states = {(r.segment_id, r.state) for r in made_rows.collect()}
    refused = {s for s, state in states if state != "ok"}
    outputs = rw.accepted(made_rows)
    assert {r.segment_id for r in outputs.collect()}.isdisjoint(refused)
    log = [(v, 1_000 + k, k, rnd.randrange(40), rnd.randrange(1, 4), sha(f"log{k}")) for k in range(12) for v in [rnd.randrange(2)]]
    wal = spark.createDataFrame(log, "volume_id long, wal_id long, seq long, start_lba long, lba_length long, hash string")
    before = sn.live_blocks(entries, segments, wal)
    after = rw.applied_blocks(before, outputs, segments)

    cut = {sha(b[64 * x : 64 * y]): [b[64 * i : 64 * i + 64] for i in range(x, y)] for b in body.values() for x in range(len(b) // 64) for y in range(x + 1, len(b) // 64 + 1)}
    content = lambda r: sha("zero") if r.hash == ZERO else cut[r.hash][r.lba - r.start_lba] if r.hash in cut else sha(f"{r.hash}:{r.lba - r.start_lba}")
    reads = lambda df: {(r.volume_id, r.lba): content(r) for r in df.collect()}
    assert reads(before) == reads(after)
    assert any(r.moved for r in after.collect())
    accepted = {r.segment_id for r in plan.select("segment_id").distinct().collect()} - refused
    left = {r.claimant for r in after.collect() if r.source == "segment"}
    assert left.isdisjoint(accepted)  # nothing of a rewritten input is read any more

    owners = ci.data_owners(entries, segments)
    found = {r.hash: (r.owner, r.change) for r in rw.applied_owners(owners, outputs, spark.createDataFrame([(s,) for s in accepted], "segment_id long")).collect()}
    out = {}
    for r in outputs.collect():
        if r.kind in rw.CARRIED:
            out.setdefault(r.hash, set()).add(r.segment_id)
    for r in owners.collect():
        if r.segment_id not in accepted:
            want = (r.segment_id, "kept")
        elif r.segment_id in out.get(r.hash, ()):
            want = (r.segment_id + rw.FRESH, "rekeyed")
        else:
            want = (min(out[r.hash]) + rw.FRESH, "taken") if r.hash in out else (-1, "removed")
        assert found.pop(r.hash) == want
    assert {h: (min(s) + rw.FRESH, "new") for h, s in out.items() if h in found} == found


def test_materialising_reports_each_kind_of_failure(spark):
    entries = spark.createDataFrame([(0, 1, i, kind, sha(str(i)), 10 * i, 2, 5, False, None, 0, True) for i, kind in enumerate(["data", "data", "data", "delta", "zero"], 1)], ENTRY)
    bodies = spark.createDataFrame([(1, 1, "a" * 64 + "b" * 64, True), (1, 2, "c" * 128, False)], "segment_id long, entry_idx long, body string, sound boolean")
    plan = spark.createDataFrame([("run", 1, 1, 11, 1, 1), ("keep", 1, 2, -1, -1, -1), ("canonical", 1, 3, -1, -1, -1), ("canonical", 1, 4, -1, -1, -1), ("zero_split", 1, 5, 51, 1, 1), ("drop", 9, -1, -1, -1, -1)], "op string, segment_id long, entry_idx long, start_lba long, lba_length long, payload_block_offset long")
    found = {r.entry_idx: (r.kind, r.hash, r.start_lba, r.lba_length, r.state) for r in rw.materialised(plan, entries, bodies, ZERO).collect()}
    assert found == {1: ("data", sha("b" * 64), 11, 1, "ok"), 2: ("data", sha("2"), 20, 2, "io_error"), 3: ("canonical_data", sha("3"), 0, 0, "cancelled"), 4: ("canonical_delta", sha("4"), 0, 0, "ok"), 5: ("zero", ZERO, 51, 1, "ok")}


@pytest.mark.parametrize("seed", range(4))
def test_repack(spark, seed):
    rnd = random.Random(seed)
    rows = [(v, 10 * v + i, rnd.randrange(1, 70), rnd.randrange(1, 6), rnd.random() < 0.5, rnd.random() < 0.3) for v in range(5) for i in range(rnd.choice([1, 2, 8]))]
    scan = spark.createDataFrame(rows, "volume_id long, segment_id long, live_bytes long, live_entries long, all_live boolean, journal boolean")
    got = {(r.volume_id, r.segment_id): (r.bucket, r.action) for r in gc.repacked(scan, 100, 12).collect()}
    want = {}
    for v in range(5):
        data = sorted((r for r in rows if r[0] == v and not r[5]), key=lambda r: -r[2])
        buckets = []
        for r in data:
            for b in buckets:
                if sum(x[2] for x in b) + r[2] <= 100 and sum(x[3] for x in b) + r[3] <= 12:
                    b.append(r)
                    break
            else:
                buckets.append([r])
        emits = [len(b) > 1 or not b[0][4] for b in buckets]
        for i, (b, e) in enumerate(zip(buckets, emits, strict=True)):
            want |= {(v, r[1]): (i, "pack" if e else "leave") for r in b}
        journal = [r for r in rows if r[0] == v and r[5]]
        alone = len(journal) == 1 and journal[0][4] and not any(emits)
        want |= {(v, r[1]): (-1, "leave" if alone else "journal") for r in journal}
    assert got == want


# --- snapshots and layers ---


def test_opening_a_fork_through_its_parents(spark):
    entries, segments, rows = made(spark, random.Random(4), 30)
    parents = spark.createDataFrame([(0, None), (1, 0)], "volume_id long, parent_id long")
    manifest = sn.manifests(segments, sn.cuts(segments, 6))
    names = {}
    for r in manifest.collect():
        names.setdefault(r.volume_id, set()).add(r.segment_id)
    want = {}
    for volume, chain in ((0, [0]), (1, [0, 1])):
        for layer in chain:
            for _, s, i, kind, h, a, n, *_ in sorted((r for r in rows if r[1] in names.get(layer, ())), key=lambda r: r[1:3]):
                if not kind.startswith("canonical"):
                    want |= {(volume, lba): (s, i, h, lba - a) for lba in range(a, a + n)}
    got = {}
    for r in sn.open_snapshot(entries, manifest, sn.layers(parents)).collect():
        got |= {(r.volume_id, r.start_lba + k): (r.claimant, r.entry_idx, r.hash, r.payload_block_offset + k) for k in range(r.lba_length)}
    assert got == want and want


def test_layers_of_files(spark):
    rows = [
        ("i", 0, "/a/x", "1", False, False),
        ("i", 1, "/a/x", "2", False, False),
        ("i", 0, "/a/y", "3", False, False),
        ("i", 1, "/a/y", "", True, False),
        ("i", 2, "/a/y", "4", False, False),
        ("i", 0, "/b/z", "5", False, False),
        ("i", 0, "/b/c/w", "6", False, False),
        ("i", 1, "/b", "", False, True),
        ("i", 1, "/b/new", "7", False, False),
        ("i", 0, "/bb/z", "8", False, False),
        ("j", 0, "/b/z", "9", False, False),
        ("i", 0, "/gone", "0", False, False),
        ("i", 3, "/gone", "", True, False),
    ]
    files = spark.createDataFrame(rows, "image string, layer long, path string, hash string, whiteout boolean, opaque boolean")
    got = sorted((r.image, r.path, r.hash) for r in sn.merged_layers(files).collect())
    assert got == [("i", "/a/x", "2"), ("i", "/a/y", "4"), ("i", "/b/new", "7"), ("i", "/bb/z", "8"), ("j", "/b/z", "9")]


# --- names, walks, caches, sums ---


@pytest.mark.parametrize("seed", range(3))
def test_conditional_puts(spark, seed):
    rnd = random.Random(seed)
    rows = [(n, t, rnd.choice(["create", "update", "update", "delete"]), t - rnd.choice([1, 1, 2])) for n in range(4) for t in range(20)]
    want, version = {}, {}
    for n, t, verb, expected in rows:
        held = version.get(n, -1)
        good = {"create": held == -1, "update": held != -1 and held == expected, "delete": True}[verb]
        version[n] = (-1 if verb == "delete" else t) if good else held
        want[n, t] = ("ok" if good else "precondition_failed", version[n])
    ops = spark.createDataFrame(rows, "name long, event_id long, verb string, expected long")
    assert {(r.name, r.event_id): (r.outcome, r.version) for r in ev.conditional(ops).collect()} == want


def test_walks_agree_unless_links_differ(spark):
    volumes = spark.createDataFrame([(i, i // 2 if i > 1 else None) for i in range(1, 60)], "volume_id long, parent_id long")
    found = li.walks_agree(volumes).collect()
    assert all(r.agree and r.ancestors == r.volume_id.bit_length() - 1 for r in found) and len(found) == 59


def test_source_cache(spark):
    rnd = random.Random(3)
    rows = [(j, n, f"h{rnd.randrange(9)}") for j in range(2) for n in range(80)]
    size = {f"h{i}": 10 + 15 * i for i in range(9)}
    got = Counter((r.job, r.hash, r.hit) for r in si.cached_reads(spark.createDataFrame([(*r, size[r[2]]) for r in rows], "job long, nth long, hash string, bytes long"), 100).collect())
    want = Counter()
    for job in range(2):
        held = OrderedDict()
        for j, _, h in rows:
            if j == job:
                want[j, h, h in held] += 1
                held[h] = held.pop(h, size[h])
                while sum(held.values()) > 100 and len(held) > 1:
                    held.popitem(last=False)
    assert got == want


def test_running_sums_by_stretch(spark):
    rnd = random.Random(2)
    sizes = [rnd.randrange(50) for _ in range(500)]
    rows = spark.createDataFrame(list(enumerate(sizes)), "id long, n long")
    got = {r.id: r.body_offset for r in rp.placed(rows, F.floor(F.col("id") / 32), ["id"], "n").collect()}
    assert got == {i: sum(sizes[:i]) for i in range(500)}


def test_commands_over_a_folder(spark, tmp_path):
    from varve import commands as cm
    from varve.sources import wal_format as wf

    folder = str(tmp_path / "v")
    entries, segments, rows = made(spark, random.Random(7))
    bodies = [(s, i, ("x" if (s + i) % 7 == 0 else "") + str(n)) for _, s, i, kind, h, *_ in rows if kind in ("data", "inline", "canonical_data") for n in range(12) if sha(str(n)) == h]
    cm.save(entries, segments, spark.createDataFrame(bodies, "segment_id long, entry_idx long, body string"), folder)
    present = {(r[1], r[2]): r[-1] for r in rows}
    bad = sum(b.startswith("x") and present[s, i] for s, i, b in bodies)
    found = cm.verify(spark, folder).first()
    assert (found.checked, found.mismatches, found.scan_errors, found.skipped_no_body) == (sum(present[s, i] for s, i, _ in bodies), bad, 0, len(rows) - len(bodies))
    assert cm.inspect_segment(spark, folder, 3).count() == sum(r[1] == 3 for r in rows)
    assert cm.inspect(spark, folder).where("kind = 'all' and tier = 'all'").first().n == len(rows)
    runs = cm.dump_lbamap(spark, folder).collect()
    one = runs[0]
    assert [r.hash for r in cm.block_hash(spark, folder, one.volume_id, one.start_lba).collect()] == [one.hash]
    assert {r.state for r in cm.verify_content(spark, folder).collect()} <= {"ok", "mismatch", "unresolvable"}
    assert {r.segment_id for r in cm.reap(spark, folder, -1).collect()}.isdisjoint({r.claimant for r in runs})
    (tmp_path / "v" / "wal").mkdir()
    (tmp_path / "v" / "wal" / "5.wal").write_bytes(wf.encode([("zero", ZERO, 1, 2, 0, b"")]) + b"torn")
    assert [(r.wal_id, r.is_truncated) for r in cm.inspect_wal(spark, folder).collect()] == [(5, True)]
    (tmp_path / "v" / "caches").mkdir()
    (tmp_path / "v" / "caches" / "9.cache").write_bytes(cf.encode([(1, b"abc"), (2, b"d")]))
    assert sorted((r.segment_id, r.entry_idx, r.stored_length) for r in cm.inspect_cache(spark, folder).collect()) == [(9, 1, 3), (9, 2, 1)]
    assert cm.sketch_index(spark, folder, 0).first().sources >= 0


def test_commands_over_images_and_volumes(spark, tmp_path):
    from varve import commands as cm

    files = lambda *rows: spark.createDataFrame([(p, b, sha(b), len(b)) for p, b in rows], "path string, body string, hash string, bytes long")
    a, b = files(("/a", "one"), ("/b", "two"), ("/c", "three")), files(("/a", "one"), ("/b", "twx"), ("/d", "three"))
    assert {r["class"]: r.files for r in cm.extents(a, b).collect()} == {"exact": 1, "changed": 1, "new": 1, "removed": 1}
    assert [(r.path, r["class"], r.source) for r in cm.rename_analysis(a, b).collect()] == [("/d", "renamed", "/c")]
    assert cm.sparse_analysis(a, b, 2).first().changed_blocks == 1 and cm.image_overlap(a, b).first().common == 2
    assert cm.generate_filemap(a, str(tmp_path / "map")).count() == 3
    volumes = spark.createDataFrame([(1, "b", False), (2, "a", True), (3, None, True), (4, None, False)], "volume_id long, name string, readonly boolean")
    names = lambda which: [(r.name, r.volume_id) for r in cm.volume_list(volumes, which).collect()]
    assert names("all") == [("a", 2), ("b", 1), ("-", 3)] and names("readonly") == [("a", 2), ("-", 3)] and names("writable") == [("b", 1)]
    events = spark.createDataFrame([(1, t, t - 1 if t else None, "stop" if t % 2 else "start") for t in range(30)], "name long, event_id long, prev_id long, kind string")
    assert [r.event_id for r in cm.volume_events(events, 1, 20).collect()] == list(range(29, 9, -1))
    assert cm.volume_status(events).first().state == "stopped"
    lineage = spark.createDataFrame([(1, None), (2, 1), (3, 1)], "volume_id long, parent_id long")
    assert [r.line for r in cm.volume_tree(lineage).collect()] == ["1", "  2", "  3"]


def test_walks_of_more_rows_than_recursive_sql_gives(spark):
    from varve.operators import lineage as li

    chain = spark.createDataFrame([(i, i - 1 if i > 1 else None) for i in range(1, 13)], "volume_id long, parent_id long")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "20")
    try:
        got = {(r.volume_id, r.ancestors, r.agree) for r in li.walks_agree(chain).collect()}
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
    assert got == {(i, i - 1, True) for i in range(1, 13)}
