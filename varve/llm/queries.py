"""Registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varve.llm import exact_dedup, language, licenses, mixing, near_dedup, packing, pii, quality, topk, toxicity
from varve.llm.common import small_batches, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(table(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = licenses.scan(docs.select(F.col("doc_id").alias("id"), licenses.tree_path(F.col("doc_id"), F.col("source")).alias("path"), "text"))
    return found.withColumnRenamed("id", "doc_id")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 100 == 0)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.digest(table(spark, sf_dir, "documents"), width=3, percent=85)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.digest(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.digest(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


OPERATORS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_quality": op2_quality,
    "op3_mixing": op3_mixing,
    "op4_licenses": op4_licenses,
    "op5_pii": op5_pii,
    "op6_topk": op6_topk,
    "op7_near_dedup": op7_near_dedup,
    "op8_language": op8_language,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_packing": op10_packing,
}


def with_small_batches(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {name: with_small_batches(query) for name, query in OPERATORS.items()}

#: DuckDB SQL of the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op3_mixing": r"""
WITH d AS (SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
                  coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS weight FROM d GROUP BY source),
l AS (SELECT *, 3 * source_size AS most, row_number() OVER o AS pos,
             CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER b, 0) AS BIGINT) AS rest,
             CAST(sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS BIGINT) AS heft
      FROM s WINDOW o AS (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, source IS NULL, source),
                    b AS (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT *, most < CAST(rest AS DOUBLE) * weight / heft AS held FROM l),
f AS (SELECT rest AS free_rest, heft AS free_heft FROM h WHERE NOT held ORDER BY pos LIMIT 1),
g AS (SELECT source, source_size, CASE WHEN held THEN CAST(most AS DOUBLE) ELSE CAST(free_rest AS DOUBLE) * weight / free_heft END AS target FROM h, f),
q AS (SELECT doc_id, d.source, k, size, source_size, target,
             CAST(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS start
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
e AS (SELECT *, greatest(0, least(size, CAST(floor(target) AS BIGINT) - (epoch * source_size + start))) AS piece
      FROM q, (SELECT unnest([0, 1, 2]) AS epoch)),
m AS (SELECT doc_id, epoch, source, k, CAST(sum(piece) OVER (ORDER BY CAST(epoch * source_size + start + piece AS DOUBLE) / target,
             source IS NULL, source, k, doc_id, epoch ROWS UNBOUNDED PRECEDING) - piece AS BIGINT) AS mix_start FROM e WHERE piece > 0),
t AS (SELECT doc_id, size, source_size, target, CAST(sum(piece) AS BIGINT) AS taken FROM e GROUP BY ALL)
SELECT t.doc_id, size, source_size, target, taken, coalesce(mix_start, -1) AS mix_start FROM t LEFT JOIN m ON t.doc_id = m.doc_id AND m.epoch = 0""",
    "op6_topk": r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM c)
SELECT * FROM r WHERE rank <= 10""",
    "op9_exact_dedup": r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
FROM t""",
}
