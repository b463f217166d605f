"""Query of the secret scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage
from .native_queries import documents
from .secrets import joined, scan, with_random


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole document; the method's spans are of kind ``random-<encoding>``."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = with_random(stage(scan(docs, "text"), "scanned"))

    def number(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    added = F.transform("random", lambda t: F.struct(
        F.concat(F.lit("random-"), t["encoding"]).alias("kind"), t["start"].alias("start"), t["end"].alias("end")))
    return found.select(
        "row.doc_id", number("assign"), number("access"), number("hex"),
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined(F.concat("base", added)).alias("spans"), F.size("random").cast("long").alias("n_random"))


QUERIES = {"op12_secret_scan": op12_secret_scan}
