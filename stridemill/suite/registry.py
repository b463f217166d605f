"""All registered queries, with the session settings they rely on."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from ..session import apply_semantics
from . import batch_queries, table_queries

Query = Callable[[SparkSession, str], DataFrame]


def _prepared(query: Query) -> Query:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(apply_semantics(spark), sf_dir)
    return run


def queries() -> dict[str, Query]:
    return {name: _prepared(query) for name, query in (batch_queries.QUERIES | table_queries.QUERIES).items()}
