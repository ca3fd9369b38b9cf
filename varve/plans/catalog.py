"""All registered queries of the storage operators."""

from __future__ import annotations

from varve.plans import compaction_queries, graph_queries, index_queries, interval_queries, io_queries, read_queries, report_queries, state_queries, storage_queries

FAMILIES = (interval_queries, index_queries, read_queries, compaction_queries, graph_queries, report_queries, io_queries, state_queries, storage_queries)

QUERIES = {name: made[0] for family in FAMILIES for name, made in family.QUERIES.items()}
ORACLE_SQL = {name: made[1] for family in FAMILIES for name, made in family.QUERIES.items() if made[1]}
