"""Query of spelling variants."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .native_queries import documents
from .spelling import variants, word_counts


def dented(doc_id: int | None) -> Callable[[str], str]:
    """What leaves a letter out of about one in 97 of a document's distinct words.

    The rule is fixed by the query's contract; a missing id is written as nothing.
    """
    seed = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))

    def turn(word: str) -> str:
        h = zlib.crc32(word.encode(), seed)
        if h % 97:
            return word
        k = h % len(word)
        return word[:k] + word[k + 1:]
    return turn


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of at least 5 letters and 3 occurrences, with their neighbours, forms and roots."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return variants(word_counts(docs, "doc_id", "text", 5, dented), least=3, ratio=2)


QUERIES = {"op13_spelling_variants": op13_spelling_variants}
