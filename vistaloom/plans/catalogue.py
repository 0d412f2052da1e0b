"""All named queries, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vistaloom.plans import annotation_queries, cluster_queries, evaluation_queries, nested_queries, stream_queries, temporal_queries, text_queries, vector_queries

_ALL = (vector_queries, cluster_queries, evaluation_queries, temporal_queries, text_queries, stream_queries, nested_queries, annotation_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: q for m in _ALL for name, q in m.QUERIES.items()}
ORACLE: dict[str, str] = {name: sql for m in _ALL for name, sql in m.ORACLE.items()}
