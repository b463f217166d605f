"""What the corpus operators share: staged tables, size-checked joins and ranks without hot groups."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import run_dir

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Rows up to which a table of a few short columns is sent to every executor.
SMALL_ROWS = 50_000


def stage(df: DataFrame, label: str, **options: int | str) -> DataFrame:
    """Write ``df`` once into the shared folder, with ``options`` of the writer, and read it back.

    Cuts the lineage at a place every executor can reach, so a lost executor costs a read
    and not the work before it.
    """
    path = run_dir(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_batches(spark: SparkSession, rows: int = 500) -> None:
    """Let Python tasks get whole texts in batches of so many rows at most, so that their
    memory doesn't depend on how rows lie in files.  A lower setting of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def byte_batches(spark: SparkSession, size: int) -> None:
    """Let Python tasks get batches of so many bytes at most, longer rows one by one, so that
    their memory doesn't depend on how rows lie in files.  A lower setting of the session stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(-?\d+)([kmgtp]?)b?", spark.conf.get(key).strip().lower()).groups()
    if not 0 < int(number) << 10 * " kmgtp".index(unit or " ") <= size:
        spark.conf.set(key, str(size))


def join_small(frame: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner",
               limit: int = SMALL_ROWS) -> DataFrame:
    """Join a staged table: broadcast when its counted rows are few, else an ordinary
    shuffle join that adaptive execution may split on hot keys."""
    few = small.count() <= limit
    return frame.join(F.broadcast(small) if few else small, list(keys), how)


def word_count(text: Column) -> Column:
    """Number of words between white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def words_of(text: Column, gap: str = GAP) -> Column:
    """Words of a text as an array, empty for null and for texts without words."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), gap), lambda w: w != "")


def group_key(column: Column) -> Column:
    """A string that tells null from every value, for joins on a nullable group."""
    return F.when(column.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), column.cast("string")))


def spread_rank(frame: DataFrame, group: Sequence[str], bucket: str, order: Sequence[str],
                rank: str, total: str) -> DataFrame:
    """Rank from 0 within each group and the group's size, in order of (bucket, order).

    No task sees a whole group: rows are ranked inside (group, bucket), and the counts of
    the buckets before, aggregated on the map side first, are added.
    """
    group, order = list(group), list(order)
    counts = frame.groupBy(*group, bucket).agg(F.count(F.lit(1)).alias("_n"))
    within = Window.partitionBy(*group)
    counts = (counts
              .withColumn("_before", F.sum("_n").over(within.orderBy(bucket)) - F.col("_n"))
              .withColumn(total, F.sum("_n").over(within)).drop("_n"))
    place = Window.partitionBy(*group, bucket).orderBy(*order)
    return (frame.join(counts, [*group, bucket])
            .withColumn(rank, F.col("_before") + F.row_number().over(place) - 1).drop("_before"))
