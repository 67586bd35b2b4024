"""Every query over the given tables by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from srcloom.jobs import code_queries, finding_queries, project_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**code_queries.QUERIES, **finding_queries.QUERIES, **project_queries.QUERIES}
SQL: dict[str, str] = {**code_queries.SQL, **finding_queries.SQL, **project_queries.SQL}
