"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import group_key, spread_rank, stage


def shard(frame: DataFrame, key: Sequence[str], source: str = "source", shards: int = 40,
          seed: int = 29, buckets: int = 1024) -> DataFrame:
    """Deal rows to shards that all have the sources' mixture and as many rows, give or take one.

    Rows are shuffled by a seeded hash inside their source; a row of rank r among n has the
    fractional rank (r + 1/2) / n.  Sorted by it the sources interleave in proportion, and
    equal cuts of that order give every shard its share of every source, within a row or two.
    Returns ``row`` (the input columns), ``shard`` from 0 and ``slot``, gapless from 0 within
    the shard.

    ``key`` names the columns that seed the shuffle and break ties; rows equal in all of them
    are interchangeable.  Null is a source of its own.  With fewer rows than shards some
    shards stay empty; an empty table gives an empty result.

    Both orders are ranked inside buckets with the counts of earlier buckets added, so no
    task sees a source or the whole order.
    """
    columns = [frame[f"`{c}`"] for c in frame.columns]
    base = frame.select(
        F.struct(*columns).alias("row"), group_key(frame[f"`{source}`"]).alias("_source"),
        F.xxhash64(F.lit(seed), *[frame[f"`{c}`"] for c in key]).alias("_hash"),
        F.struct(*[frame[f"`{c}`"] for c in key]).alias("_key"),
    ).withColumn("_bucket", F.pmod("_hash", F.lit(buckets)))
    ranked = spread_rank(base, ["_source"], "_bucket", ["_hash", "_key"], "_rank", "_of")
    placed = stage(ranked.withColumn("_part", (F.col("_rank") + 0.5) / F.col("_of"))
                   .withColumn("_bin", F.floor(F.col("_part") * (4 * buckets)))
                   .drop("_rank", "_of", "_bucket"), "shard-order")
    # One row per bin: 4 x buckets rows at most, whatever the input.
    whole = Window.orderBy("_bin")
    bins = (placed.groupBy("_bin").agg(F.count(F.lit(1)).alias("_n"))
            .withColumn("_before", F.sum("_n").over(whole) - F.col("_n"))
            .withColumn("_rows", F.sum("_n").over(whole.rowsBetween(Window.unboundedPreceding,
                                                                    Window.unboundedFollowing))))
    inside = Window.partitionBy("_bin").orderBy("_part", "_source", "_hash", "_key")
    position = (placed.join(bins, "_bin")
                .withColumn("_at", F.col("_before") + F.row_number().over(inside) - 1))
    number = F.expr(f"(_at * {shards}) div _rows")
    first = F.expr(f"(shard * _rows + {shards - 1}) div {shards}")
    return (position.withColumn("shard", number.cast("int"))
            .withColumn("slot", F.col("_at") - first).select("row", "shard", "slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, its rows in slot order; a shard may span several files."""
    (sharded.select("row.*", F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
     .repartitionByRange("_shard", "_slot").sortWithinPartitions("_shard", "_slot")
     .write.partitionBy("_shard").parquet(path))
