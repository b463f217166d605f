"""Each document's successor in id order, and the text it is edited with."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage


def successors(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, next_id) for every distinct id; the last one's next is the first.

    Ids are cut into ranges, followed inside each range, and only the ranges' first ids, one
    row per range, meet in one task.  Rows without an id have no place in the order.
    """
    ids = (docs.filter("doc_id is not null").groupBy("doc_id")
           .agg(F.max(F.char_length(F.coalesce("text", F.lit("")))).cast("long").alias("n_chars")))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stage(ids.repartitionByRange(parts, "doc_id")
                   .withColumn("_range", F.spark_partition_id()), "id-ranges")
    order = Window.orderBy("_range")
    firsts = (ranged.groupBy("_range").agg(F.min("doc_id").alias("_first"))
              .withColumn("_first_of_all", F.min("_first").over(order))
              .withColumn("_after", F.coalesce(F.lead("_first").over(order), "_first_of_all"))
              .select("_range", "_after"))
    inside = Window.partitionBy("_range").orderBy("doc_id")
    return (ranged.withColumn("_next", F.lead("doc_id").over(inside)).join(firsts, "_range")
            .select("doc_id", "n_chars", F.coalesce("_next", "_after").alias("next_id")))


def edited(frame: DataFrame, docs: DataFrame, carry: str) -> DataFrame:
    """Add ``edited`` and ``next_<carry>`` to ``frame`` (doc_id, text, carry).

    The last quarter of a text's code points gives way to as many first ones of the
    successor.  Only those heads and ``carry`` travel; whole texts are shuffled once, by id.
    A successor with several rows lends the smallest head.  Rows without an id end with
    their first three quarters and have no successor.
    """
    # Both joins read the same rows by the same key, so that Spark shuffles them once.
    placed = frame.filter("doc_id is not null")
    asked = successors(docs).select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("_for"),
                                    F.floor(F.col("n_chars") / 4).cast("int").alias("_need"))
    heads = (placed.join(asked, "doc_id")
             .select(F.col("_for").alias("doc_id"),
                     F.substring("text", F.lit(1), F.col("_need")).alias("_head"), F.col(carry).alias("_kept"))
             .groupBy("doc_id").agg(F.min(F.struct("_head", "_kept")).alias("_lent")))
    lent = placed.join(heads, "doc_id", "left").unionByName(
        frame.filter("doc_id is null"), allowMissingColumns=True)
    n = F.char_length("text")
    keep = n - F.floor(n / 4).cast("int")
    return (lent.withColumn("edited", F.concat(F.substring("text", F.lit(1), keep),
                                               F.coalesce(F.col("_lent._head"), F.lit(""))))
            .withColumn(f"next_{carry}", F.col("_lent._kept")).drop("_lent"))
