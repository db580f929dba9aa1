"""The catalogue of registered queries of the engine's own operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracemill.plans import curation_queries, episode_queries, evaluation_queries, ingest_queries, ledger_queries, memory_queries, output_queries, request_queries, retrieval_queries, upkeep_queries

_PARTS = (ledger_queries, episode_queries, curation_queries, retrieval_queries, evaluation_queries, ingest_queries, upkeep_queries, memory_queries, request_queries, output_queries)

QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLE_SQL = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt-time recall, end to end."""
    return QUERIES["recall_end_to_end"](spark, sf_dir)
