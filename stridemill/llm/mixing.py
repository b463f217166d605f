"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import group_key, join_small, stage


def water_fill(sources: DataFrame, weights: Sequence[float] = (5.0, 2.0, 1.0), budget: float = 1.5,
               max_epochs: float = 2.0) -> DataFrame:
    """Add ``target`` to a table of (source, source_size), one row per source.

    Sources in code point order, null last, take the weights in turn and share ``budget``
    times all sizes.  A source stops at ``max_epochs`` times its size; what it leaves is
    shared out by weight among the others until nobody exceeds its limit.  Sorted by
    limit / weight, the clamped sources are a prefix, so the fixed point of that loop is the
    first level no source of the rest exceeds.  The table has one row per source, which is
    why its windows may run in one task.  Without any words every target is 0.
    """
    every = Window.orderBy(F.col("source").isNull(), "source")
    turn = (F.row_number().over(every) - 1) % len(weights)
    table = (sources
             .withColumn("_weight", F.element_at(F.array(*map(F.lit, map(float, weights))), turn + 1))
             .withColumn("_limit", F.col("source_size") * F.lit(float(max_epochs)))
             .withColumn("_ratio", F.col("_limit") / F.col("_weight")))
    by_ratio = Window.orderBy("_ratio", F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = ((F.sum("source_size").over(whole) * F.lit(float(budget))
              - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))) / F.sum("_weight").over(rest))
    fits = F.when(F.col("_level") <= F.col("_ratio"), F.col("_level"))
    return (table.withColumn("_level", level)
            .withColumn("_first", F.first(fits, ignorenulls=True).over(whole))
            .withColumn("target", F.least(F.col("_limit"),
                                          F.coalesce(F.col("_weight") * F.col("_first"), F.col("_limit"))))
            .drop("_weight", "_limit", "_ratio", "_level", "_first"))


def mix(frame: DataFrame, key: Sequence[str], source: str = "source", size: str = "size",
        weights: Sequence[float] = (5.0, 2.0, 1.0), budget: float = 1.5, max_epochs: float = 2.0,
        seed: int = 17, buckets: int = 1024, large_share: int = 256) -> DataFrame:
    """Say how often every row goes into the mixture.

    Returns one row per input row: ``row`` (the input columns, whatever their names),
    ``source_size``, ``target`` and ``repeats``.  A source with target / size = w + f repeats
    each row w times, and rows drawn in seeded order once more until they carry the fraction
    f.  Rows above 1 / ``large_share`` of their source are drawn first, and the others fill up
    what those leave, so the words taken miss the target by about half a small row wherever
    small rows can make up for it.  Rows are whole: none is cut.

    ``key`` names the columns that seed the order; equal rows share a place in it and are
    interchangeable.  Null sizes count as 0.  Null is a source of its own.  A source without
    words has target 0 and its rows repeat 0 times.  An empty table gives an empty result.

    No group meets in one task: running sums are taken inside (source, hash bucket), and the
    sums of the buckets before are aggregated first.
    """
    base = frame.select(
        F.struct(*[frame[f"`{c}`"] for c in frame.columns]).alias("row"),
        frame[f"`{source}`"].alias("source"), group_key(frame[f"`{source}`"]).alias("_source"),
        F.coalesce(frame[f"`{size}`"], F.lit(0)).cast("long").alias("_size"),
        F.xxhash64(F.lit(seed), *[frame[f"`{c}`"] for c in key]).alias("_hash"),
    ).withColumn("_bucket", F.pmod("_hash", F.lit(buckets)))
    slim = stage(base.select("source", "_source", "_size", "_hash", "_bucket"), "mix-sizes")
    sources = slim.groupBy("_source").agg(F.first("source").alias("source"),
                                          F.sum("_size").alias("source_size"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = stage(water_fill(sources, weights, budget, max_epochs)
                    .withColumn("_whole", F.floor(rate)).withColumn("_part", rate - F.floor(rate))
                    .drop("source"), "mix-targets")

    is_large = F.col("_size") * large_share > F.col("source_size")
    sized = join_small(slim.drop("source"), sources, ["_source"]).withColumn("_large", is_large)
    # Fewer than large_share rows of a source can be large.
    by_source = Window.partitionBy("_source")
    drawn = by_source.orderBy("_bucket", "_hash", "_size").rowsBetween(Window.unboundedPreceding, -1)
    taken = (F.coalesce(F.sum("_size").over(drawn), F.lit(0)) + F.col("_size") / 2
             <= F.col("_part") * F.sum("_size").over(by_source)) & (F.col("_part") > 0)
    large = (sized.filter("_large").withColumn("_take", taken).groupBy("_source")
             .agg(F.sum("_size").alias("_large_size"),
                  F.sum(F.when(F.col("_take"), F.col("_size")).otherwise(0)).alias("_large_taken")))
    sums = sized.groupBy("_source", "_bucket").agg(
        F.sum(F.when(F.col("_large"), F.col("_size")).otherwise(0)).alias("_large_sum"),
        F.sum(F.when(F.col("_large"), 0).otherwise(F.col("_size"))).alias("_small_sum"))
    so_far = by_source.orderBy("_bucket")
    plan = (sums
            .withColumn("_large_before", F.sum("_large_sum").over(so_far) - F.col("_large_sum"))
            .withColumn("_small_before", F.sum("_small_sum").over(so_far) - F.col("_small_sum"))
            .join(sources, "_source").join(large, "_source", "left")
            .withColumn("_large_need", F.col("_part") * F.coalesce("_large_size", F.lit(0)))
            .withColumn("_small_need", F.col("_part") * F.col("source_size")
                        - F.coalesce("_large_taken", F.lit(0)))
            .drop("_large_sum", "_small_sum", "_large_size", "_large_taken"))

    place = (Window.partitionBy("_source", "_bucket").orderBy("_hash", "_size")
             .rowsBetween(Window.unboundedPreceding, -1))

    def begun(kind):
        return F.coalesce(F.sum(F.when(kind, F.col("_size")).otherwise(0)).over(place), F.lit(0))
    joined = (base.drop("source").join(plan, ["_source", "_bucket"]).withColumn("_large", is_large)
              .withColumn("_begun", F.when(F.col("_large"), F.col("_large_before") + begun(F.col("_large")))
                          .otherwise(F.col("_small_before") + begun(~F.col("_large")))))
    need = F.when(F.col("_large"), F.col("_large_need")).otherwise(F.col("_small_need"))
    extra = (F.col("_part") > 0) & (F.col("_begun") + F.col("_size") / 2 <= need)
    return joined.select("row", "source_size", "target",
                         (F.col("_whole") + extra.cast("int")).cast("int").alias("repeats"))


def repeated(mixed: DataFrame) -> DataFrame:
    """The mixture itself: every row as often as :func:`mix` says, in the input's columns."""
    return (mixed.filter("repeats > 0")
            .select("row", F.explode(F.sequence(F.lit(1), F.col("repeats"))).alias("_copy"))
            .select("row.*"))
