"""Every query of the engine by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rankweave.plans import analysis, composed, graph, retrieval

PARTS = (retrieval, graph, analysis, composed)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for p in PARTS for k, v in p.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for p in PARTS for k, v in p.ORACLE_SQL.items()}
