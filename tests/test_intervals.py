"""Interval operators against a plain model that splits and trims a map record by record."""

import random

import pytest

from varve.operators import intervals as iv

SPACE = 64


def model(records):
    """Blocks by last write: ``{lba: (record, offset)}``."""
    held = {}
    for r in sorted(records, key=lambda r: (r["wal_id"], r["seq"])):
        for i in range(r["lba_length"]):
            held[r["start_lba"] + i] = (r, i)
    return held


def runs(held, key):
    out = []
    for lba in sorted(held):
        r, i = held[lba]
        last = out[-1] if out else None
        if last and key(last[0]) == key(r) and last[1] + last[2] == lba and last[3] + last[2] == i:
            last[2] += 1
        else:
            out.append([r, lba, 1, i])
    return out


def log(seed, n=60):
    rnd = random.Random(seed)
    return [{"seq": k, "wal_id": rnd.randrange(6), "start_lba": rnd.randrange(SPACE), "lba_length": rnd.randrange(9), "hash": f"h{rnd.randrange(5)}", "kind": "data"} for k in range(n)]


def frame(spark, rows, schema="seq long, wal_id long, start_lba long, lba_length long, hash string, kind string"):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("seed", range(4))
def test_overlay_matches_the_model(spark, seed):
    rows = log(seed)
    want = {(s, n, o, r["hash"], r["wal_id"], r["seq"]) for r, s, n, o in runs(model(rows), lambda r: r["seq"])}
    got = {(r.start_lba, r.lba_length, r.payload_block_offset, r.hash, r.claimant, r.seq) for r in iv.overlay(frame(spark, rows)).collect()}
    assert got == want


@pytest.mark.parametrize("seed", range(3))
def test_if_newer_matches_insertion_in_order(spark, seed):
    rows = log(seed)
    held, taken = {}, {}
    for r in rows:
        taken[r["seq"]] = 0
        for i in range(r["lba_length"]):
            at = r["start_lba"] + i
            if at not in held or held[at][0]["wal_id"] < r["wal_id"]:
                held[at] = (r, i)
                taken[r["seq"]] += 1
    want = {(s, n, o, r["seq"]) for r, s, n, o in runs(held, lambda r: r["seq"])}
    got = {(r.start_lba, r.lba_length, r.payload_block_offset, r.seq) for r in iv.overlay_if_newer(frame(spark, rows)).collect()}
    assert got == want
    installed = {r.seq: r.installed for r in iv.installed_if_newer(frame(spark, rows), "seq", "wal_id", "seq").collect()}
    assert installed == {k: v for k, v in taken.items() if rows[k]["lba_length"]}


@pytest.mark.parametrize("seed", range(4))
def test_two_phase_rebuild(spark, seed):
    rnd = random.Random(seed)
    segments = []
    for s in range(30):
        inputs = sorted(rnd.sample(range(s), min(s, rnd.randrange(1, 4)))) if s > 3 and rnd.random() < 0.4 else []
        segments.append({"segment_id": s, "inputs": inputs})
    entries = [
        {"volume_id": 0, "segment_id": s["segment_id"], "entry_idx": i, "kind": "data", "hash": f"h{rnd.randrange(4)}", "start_lba": rnd.randrange(SPACE), "lba_length": rnd.randrange(1, 7)}
        for s in segments
        for i in range(rnd.randrange(1, 4))
    ]
    held = {}
    inputs = {s["segment_id"]: s["inputs"] for s in segments}
    for e in (e for e in entries if not inputs[e["segment_id"]]):
        for i in range(e["lba_length"]):
            at = e["start_lba"] + i
            if at not in held or held[at][0]["segment_id"] <= e["segment_id"]:
                held[at] = (e, i)
    for e in sorted((e for e in entries if inputs[e["segment_id"]]), key=lambda e: (e["segment_id"], e["entry_idx"])):
        horizon = max(inputs[e["segment_id"]])
        for i in range(e["lba_length"]):
            at = e["start_lba"] + i
            old = held.get(at)
            if old is None or old[0]["segment_id"] <= horizon or old[0]["segment_id"] == e["segment_id"] or (old[0]["hash"] == e["hash"] and old[0]["segment_id"] < e["segment_id"]):
                held[at] = (e, i)
    want = {(s, n, o, e["segment_id"], e["entry_idx"]) for e, s, n, o in runs(held, lambda e: (e["segment_id"], e["entry_idx"]))}
    e = spark.createDataFrame(entries, "volume_id long, segment_id long, entry_idx long, kind string, hash string, start_lba long, lba_length long")
    s = spark.createDataFrame(segments, "segment_id long, inputs array<long>")
    got = {(r.start_lba, r.lba_length, r.payload_block_offset, r.claimant, r.entry_idx) for r in iv.rebuild(e, s).collect()}
    assert got == want


@pytest.mark.parametrize("seed", range(3))
def test_ranges_and_pieces(spark, seed):
    rnd = random.Random(seed)
    raw = [(rnd.randrange(SPACE), rnd.randrange(6)) for _ in range(15)]
    inside = {b for s, n in raw for b in range(s, s + n)}
    ranges = iv.normalise_ranges(spark.createDataFrame(raw, "start_lba long, lba_length long"))
    found = sorted((r.start_lba, r.end_lba) for r in ranges.collect())
    assert {b for a, z in found for b in range(a, z)} == inside
    assert all(a[1] < b[0] for a, b in zip(found, found[1:], strict=False))
    rows = [r for r in log(seed, 25) if r["lba_length"]]
    parts = iv.partition_span(frame(spark, rows), ranges).collect()
    for r in rows:
        own = sorted((p.start_lba, p.end_lba, p.inside) for p in parts if p.seq == r["seq"])
        assert own[0][0] == r["start_lba"] and own[-1][1] == r["start_lba"] + r["lba_length"]
        assert all(a[1] == b[0] for a, b in zip(own, own[1:], strict=False))
        assert all((b in inside) == flag for a, z, flag in own for b in range(a, z))


def test_absent_is_not_zero(spark):
    rows = [{"seq": 0, "wal_id": 0, "start_lba": 4, "lba_length": 2, "hash": "0" * 64, "kind": "zero"}]
    points = spark.createDataFrame([(0, 4), (1, 9)], "request_id long, lba long")
    got = {r.request_id: r.hash for r in iv.lookup(iv.overlay(frame(spark, rows)), points).collect()}
    assert got == {0: "0" * 64, 1: None}


def test_empty_log(spark):
    empty = frame(spark, [])
    assert iv.overlay(empty).count() == 0
    assert iv.fingerprint(iv.overlay(empty)).count() == 1


def test_claims_over_many_buckets(spark):
    """Claims go to the buckets of their addresses whole, and runs join again across the edges of buckets."""
    e = spark.createDataFrame([(1, 1, 1, "data", "a", 10, 300), (1, 2, 1, "data", "b", 100, 28), (1, 5, 1, "data", "a", 64, 64)], "volume_id long, segment_id long, entry_idx long, kind string, hash string, start_lba long, lba_length long")
    s = spark.createDataFrame([(1, []), (2, []), (5, [1])], "segment_id long, inputs array<long>")
    claims = e.where("start_lba >= 0")
    pieces = iv.held_pieces(claims, s)
    assert pieces.where("n > 64").count() == 0
    got = {(r.start_lba, r.lba_length, r.payload_block_offset, r.hash, r.claimant) for r in iv.rebuild(e, s).collect()}
    assert got == {(10, 54, 0, "a", 1), (64, 36, 0, "a", 5), (100, 28, 0, "b", 2), (128, 182, 118, "a", 1)}
    plan = pieces._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(volume_id" in plan and not [x for x in plan.splitlines() if "Exchange" in x and "lba#" in x]  # no block is moved
