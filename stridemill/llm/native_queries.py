"""Queries of the operators that stay inside DataFrame functions: mixing, fingerprints, shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import word_count
from .fingerprints import as_text, containment, sketch
from .mixing import mix
from .sharding import shard
from .successors import edited


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words every document lends to a mixture of 150 % of the corpus."""
    sized = documents(spark, sf_dir).select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return mix(sized, key=["doc_id", "size"]).select(
        "row.doc_id", "row.size", "source_size", "target",
        (F.col("row.size") * F.col("repeats")).cast("long").alias("taken"), "repeats")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of whole texts, of their edited texts, and how near those and the successors are.

    ``near_next`` is 0 as well where nothing can be said, because there is no successor or the
    sketches have no hash to compare; ``next_compared`` is false there.
    """
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kept = docs.withColumn("kept", sketch(F.col("text")))
    both = edited(kept, docs, "kept").withColumn("edited_kept", sketch(F.col("edited")))
    both = both.withColumn("_next", containment(F.col("kept"), F.col("next_kept")))
    return both.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("kept")).alias("fingerprint"), as_text(F.col("edited_kept")).alias("edited_fingerprint"),
        containment(F.col("kept"), F.col("edited_kept")).alias("near_edited"),
        F.coalesce("_next", F.lit(0.0)).alias("near_next"), F.col("_next").isNotNull().alias("next_compared"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty shards under the law of equal row counts, each with the sources' mixture."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = documents(spark, sf_dir).select(
        "doc_id", "source", (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"))
    return shard(rows, key=["doc_id", "text_crc32", "size"]).select(
        "row.doc_id", "row.size", "row.text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "row.source")


QUERIES = {"op3_mixing": op3_mixing, "op6_fingerprints": op6_fingerprints, "op8_sharding": op8_sharding}
