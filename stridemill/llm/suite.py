"""Queries of the corpus operators and their checks in SQL."""

from __future__ import annotations

from functools import wraps

import corpus_pipeline

from ..session import apply_semantics
from . import (audit_queries, dedup_queries, language_queries, license_queries, native_queries, page_queries,
               secret_queries, spelling_queries, token_queries, vector_queries)

MODULES = (audit_queries, dedup_queries, language_queries, license_queries, native_queries, page_queries,
           secret_queries, spelling_queries, token_queries, vector_queries)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}


def _prepared(query):
    @wraps(query)
    def run(spark, sf_dir):
        return query(apply_semantics(spark), sf_dir)
    return run


def queries() -> dict:
    return {name: _prepared(query) for name, query in QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    checks = audit_queries.ORACLE | dedup_queries.ORACLE
    return checks | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
