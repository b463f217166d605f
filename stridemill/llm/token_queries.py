"""Queries over tokenized documents: counts and packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .common import stage
from .native_queries import documents
from .packing import pack, pieces
from .token_counts import count_tokens

KEY = ["row.doc_id", "piece", "length", "ids_crc32"]


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every whole text."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return (count_tokens(docs, "text", public_tokenizers.path("piece_bpe_32k.model"))
            .select("row.doc_id", "n_bytes", "n_tokens", "over_limit"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 2048 tokens."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    cut = stage(pieces(docs, "text", public_tokenizers.path("word_bpe_49k.json")), "pieces")
    return pack(cut, KEY).select("row.doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES = {"op2_token_counts": op2_token_counts, "op5_packing": op5_packing}
