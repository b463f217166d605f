"""Corpus pipeline: language, near-duplicates, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next one's ``docs``.  All but the last return the columns of ``docs``,
whatever they are named, and handle nulls, empty texts, repeated rows and empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridemill.llm.common import join_small, stage, word_count
from stridemill.llm.language_id import fit, identify
from stridemill.llm.mixing import mix, repeated
from stridemill.llm.near_duplicates import near_duplicates
from stridemill.llm.packing import pack, pieces
from stridemill.session import apply_semantics

TOKENIZER = "word_bpe_49k.json"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose text is in one of the labelled languages.

    Texts without letters and texts that no language explains go; without any label all stay.
    """
    model = fit(docs, "text", "lang")
    return identify(docs, "text", model, levels=[F.col("source")]).filter("kept").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: the one with the smallest id.

    Five-word shingles, similarity 0.8.  Rows are numbered in a staged copy, so rows without
    an id and repeated rows count one by one; among rows of one group nulls come last.
    Documents without words are alike to nothing and stay.
    """
    numbered = stage(docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
                     .withColumn("at", F.monotonically_increasing_id()), "dedup-rows")
    found = stage(near_duplicates(numbered.select("at", F.col("row.text").alias("text")), "at", "text", width=5),
                  "dedup-groups").select(F.col("id").alias("at"), "component")
    members = found.join(numbered.select("at", F.col("row.doc_id").alias("doc_id")), "at")
    order = F.struct(F.col("doc_id").isNull().alias("_null"), F.col("doc_id"), F.col("at"))
    # Staged, so that Spark may split the join of a large group's members.
    groups = stage(members.groupBy("component").agg(F.count(F.lit(1)).alias("_n"), F.min(order)["at"].alias("_first"))
                   .filter("_n > 1").select("component", "_first"), "dedup-first")
    dropped = stage(join_small(found, groups, ["component"]).filter(F.col("at") != F.col("_first")).select("at"),
                    "dedup-dropped")
    return join_small(numbered, dropped, ["at"], "left_anti", limit=1_000_000).select("row.*")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents so that sources reach their target weights.

    A document appears as many times as the mixture takes it; one that it doesn't take goes.
    """
    sized = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"),
                        docs["doc_id"].alias("doc_id"), docs["source"].alias("source"),
                        word_count(docs["text"]).alias("size"))
    mixed = mix(sized, key=["doc_id", "size"])
    return repeated(mixed.select(F.col("row.row").alias("row"), "repeats"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every document and their places in sequences of 2048 tokens."""
    cut = stage(pieces(docs.select("doc_id", "source", "text"), "text", public_tokenizers.path(TOKENIZER)), "pieces")
    return pack(cut, ["row.doc_id", "piece", "length", "ids_crc32"]).select(
        "row.doc_id", "row.source", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("language", language), ("near_dedup", near_dedup), ("mixture", mixture), ("packing", packing)]

# The trigram model, the seeded draw and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    apply_semantics(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
