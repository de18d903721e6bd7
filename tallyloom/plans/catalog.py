"""The registered queries: name -> (spark, sf_dir) -> DataFrame, and their DuckDB oracles."""

from __future__ import annotations

from tallyloom.plans import metric_queries, record_queries, relational_queries, sampling_queries, stream_queries, text_queries  # noqa: F401  (they register)
from tallyloom.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
