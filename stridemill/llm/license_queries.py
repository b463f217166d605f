"""Query of license scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .licenses import scan, summary
from .native_queries import documents


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices in every whole text."""
    return summary(*scan(documents(spark, sf_dir).select("doc_id", "text"), "text")).select("row.doc_id", "*").drop("row")


QUERIES = {"op7_license_scan": op7_license_scan}
