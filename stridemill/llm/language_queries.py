"""Queries of language identification, over documents and over pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .html_text import extract
from .language_id import address_parts, declared_language, fit, identify
from .native_queries import documents


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document: its text and the languages of its source."""
    docs = documents(spark, sf_dir)
    model = fit(docs, "text", "lang")
    return identify(docs.select("doc_id", "text", "source"), "text", model, levels=[F.col("source")], keep=["doc_id"]).select(
        "row.doc_id", "language", "posterior", "kept")


def language_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every page: main text, declared language, address suffix and host."""
    model = fit(documents(spark, sf_dir), "text", "lang")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("_declared", declared_language(F.col("html")))
    texts = extract(pages.select("page_id", "url", "_declared", "html"), "html").select("row.*", "text")
    host, domain, suffix = address_parts(F.col("url"))
    found = identify(texts, "text", model, F.col("_declared"), suffix, [host, domain], ["page_id", "url", "_declared"])
    return found.select("row.page_id", "row.url", F.col("row._declared").alias("declared"), "language", "posterior", "kept")


QUERIES = {"op9_language_id": op9_language_id, "language_of_pages": language_of_pages}
