"""The pipeline against plain versions of its stages, the quality scores aside."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_operators import corpus, docs, labels, learnable
from varve.llm import packing, quality


def test_pipeline(spark, tmp_path):
    good, marks = learnable(200)
    rows = good + [(10_000 + d, t, lang, s) for d, t, lang, s in corpus(7, 80)]
    table = docs(spark, rows).select("doc_id", "text", "lang", "source")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark, marks).write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r.doc_id for r in quality.digest(table, labels(spark, marks)).collect() if r.predicted}
    left = [r for r in rows if r[0] in kept]
    assert 0 < len(left) < len(rows)
    stay = {k for _, k, _, _ in brute.exact([(r[0], r[1]) for r in left])}
    left = [r for r in left if r[0] in stay]
    stay = {d for d, (_, c) in brute.near([(r[0], r[1]) for r in left], 5, 80).items() if d == c}
    left = [r for r in left if r[0] in stay]
    want = {}
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.tokenizer_path())
    mixed = brute.mix([(r[0], r[1], r[3]) for r in left])
    for d, text, *_ in left:
        size, _, _, taken = mixed[d]
        times = sum(2 * (taken - e * size) >= size for e in range(3) if taken > e * size)
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, packing.END_ID], "<u4")
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            key = (d, k // 4096, k, len(part), zlib.crc32(part.tobytes()))
            if times:
                want[key] = times
    got = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        key = (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
        got[key] = got.get(key, 0) + 1
    assert got == want


@pytest.mark.parametrize("n", [0, 30])
def test_stages_keep_the_columns(spark, tmp_path, n):
    """Rows that repeat, null ids, extra columns whose names clash, and empty tables."""
    made = corpus(3, n)
    table = docs(spark, made + made[:4] + [(None, "only null", None, None)] * bool(n))
    labels(spark, [(1, 1, 0)] if n else []).write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, table, str(tmp_path))
        if name != "packing":
            assert found.columns == table.columns and found.dtypes == table.dtypes
        assert (found.count() > 0) == (n > 0)


def test_run_over_clashing_columns_and_empty_tables(spark, tmp_path):
    labels(spark, []).write.parquet(f"{tmp_path}/labels.parquet")
    for n in (40, 0):
        docs(spark, corpus(5, n)).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        assert (corpus_pipeline.run(spark, str(tmp_path)).count() > 0) == (n > 0)
