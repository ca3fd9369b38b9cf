"""Queries whose steps are stored in parts of the volumes, against their SQL over the smallest tables."""

import os

import duckdb
import pytest

from varve.operators import compaction as gc
from varve.operators import snapshots as sn
from varve.plans import fixtures as fx
from varve.plans.catalog import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables are not here")


def matches_sql(spark, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    con = duckdb.connect()
    for t in ("orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    rows = lambda frame: sorted(tuple(map(str, r)) for r in frame[columns].astype(object).itertuples(index=False))
    assert sorted(got.columns) == columns
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["a05_pass_summary", "a08_body_bytes", "g01_classification", "g10_plan", "g11_plan_inputs"])
def test_the_classification_is_stored_in_parts(spark, monkeypatch, name):
    monkeypatch.setattr(fx, "PART_LINES", 2000)
    parts = fx.parts(spark, FOLDER)
    made, real = set(), gc.stored_parts

    def counted(make, parts, *more):
        return real(lambda k: made.add((k, parts)) or make(k), parts, *more)

    monkeypatch.setattr(gc, "stored_parts", counted)
    matches_sql(spark, name)
    assert parts > 1 and made == {(k, parts) for k in range(parts)}


def test_a_reap_is_stored_in_parts(spark, monkeypatch):
    monkeypatch.setattr(fx, "PART_LINES", 2000)
    made, real = set(), gc.stored_parts
    monkeypatch.setattr(gc, "stored_parts", lambda make, parts, *more: real(lambda k: made.add(k) or make(k), parts, *more))
    matches_sql(spark, "g17_reap_apply")
    assert made == set(range(fx.parts(spark, FOLDER)))


def test_a_repack_comes_out_the_same_in_parts(spark, monkeypatch):
    whole = QUERIES["g14_repack"](spark, FOLDER).toPandas()
    monkeypatch.setattr(fx, "PART_LINES", 2000)
    made, real = set(), gc.stored_parts
    monkeypatch.setattr(gc, "stored_parts", lambda make, parts, *more: real(lambda k: made.add(k) or make(k), parts, *more))
    parted = QUERIES["g14_repack"](spark, FOLDER).toPandas()
    assert made == set(range(fx.parts(spark, FOLDER)))
    rows = lambda frame: sorted(map(tuple, frame.itertuples(index=False)))
    assert len(whole) and rows(parted) == rows(whole)


def test_live_volumes_are_opened_in_parts(spark, monkeypatch):
    monkeypatch.setattr(fx, "PART_LINES", 2000)
    made, real = set(), sn.stored_parts
    monkeypatch.setattr(sn, "stored_parts", lambda make, parts, *more: real(lambda k: made.add(k) or make(k), parts, *more))
    matches_sql(spark, "s14_live_open")
    assert made == set(range(fx.parts(spark, FOLDER)))


def test_bloat_is_found_by_marks_in_parts(spark, monkeypatch):
    monkeypatch.setattr(fx, "PART_LINES", 2000)
    made, real = set(), gc.stored_parts
    monkeypatch.setattr(gc, "stored_parts", lambda make, parts, label, *more: real(lambda k: made.add((label, k)) or make(k), parts, label, *more))
    matches_sql(spark, "a07_bloat_not_packed")
    assert {k for label, k in made if label == "reached"} == set(range(fx.parts(spark, FOLDER)))
