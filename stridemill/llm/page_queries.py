"""Queries over web pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .html_text import extract


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages, "html").select("row.page_id", "row.url", "text", "n_chars")


QUERIES = {"op4_html_extraction": op4_html_extraction}
