"""Query over embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .neighbours import nearest


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector by inner product, among all others."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors, "vec_id", "embedding", F.col("vec_id") % 20 == 0, k=20)


QUERIES = {"op10_nearest_neighbours": op10_nearest_neighbours}
