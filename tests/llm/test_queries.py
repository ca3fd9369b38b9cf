"""The registered queries on the smallest tables: against their SQL, or against plain versions."""

import os
import zlib

import duckdb
import pytest

from tests.llm import brute
from tests.test_oracles import rows_of
from varve.llm import packing, queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    got, want = queries.QUERIES[name](spark, FOLDER).toPandas(), con.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got, sorted(want.columns)) == rows_of(want, sorted(want.columns))


def test_near_dedup_against_all_pairs(spark, documents):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.QUERIES["op7_near_dedup"](spark, FOLDER).collect()}
    assert got == brute.near([(d, t) for d, t, _, _ in documents], 3, 85)


def test_packing_of_the_table(spark, documents):
    got = queries.QUERIES["op10_packing"](spark, FOLDER).collect()
    assert {r.doc_id for r in got} == {d for d, *_ in documents}
    filled, counts = {}, {}
    for r in got:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
        counts[r.length] = counts.get(r.length, 0) + 1
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.least_sequences(counts, 4096) <= len(filled) <= sum(t for _, t in packing.best_fit(counts, 4096))


@pytest.mark.parametrize(("name", "parts", "part"), [("op1_toxicity", 3, 1), ("op2_quality", 3, 1), ("op8_language", 4, 2)])
def test_learned_queries_cover_every_document(spark, documents, name, parts, part):
    got = queries.QUERIES[name](spark, FOLDER).collect()
    assert sorted(r.doc_id for r in got) == sorted(d for d, *_ in documents)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == part) and 0 <= r.score <= 1 for r in got)


def test_licences_of_the_table(spark, documents):
    got = queries.QUERIES["op4_licenses"](spark, FOLDER).collect()
    assert sorted(r.doc_id for r in got) == sorted(d for d, *_ in documents)
    own = {r.path.rsplit("/", 1)[0]: (r.license, r.score) for r in got if r.path.endswith("/LICENSE") and r.origin == "own"}
    for r in got:
        if r.origin == "inherited":
            # the nearest directory above, or its own, whose licence file names one
            above, nearest = r.path.rsplit("/", 1)[0], None
            while nearest is None:
                nearest = own.get(above)
                if nearest is None:
                    assert "/" in above
                    above = above.rsplit("/", 1)[0]
            assert (r.license, r.from_dir) == (nearest[0], above)
