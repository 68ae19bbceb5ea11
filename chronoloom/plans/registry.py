"""Every query of the library under its name, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name; sql is what DuckDB runs on the same tables."""

    def register(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, *names: str, digits: int = 3) -> DataFrame:
    """df with the named columns rounded, so that sums taken in another order compare equal."""
    return df.select(*(F.round(c, digits).alias(c) if c in names else c for c in df.columns))


def queries() -> dict[str, Query]:
    from . import clock_queries, document_queries, job_queries, matching_queries, relational_queries, section_queries, sequence_queries, source_queries, text_queries, timeline_queries, track_queries  # noqa: F401

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_sql)
