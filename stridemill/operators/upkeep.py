"""Upkeep of tables that are merged through the catalog: packing small batches, removing old files.

Run it between batches: a table has one writer at a time, and this is one.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fsio
from .filters import in_folders
from .merge import PUBLISHED, VERSIONS
from .tables import BATCH_COLUMN, add_partitions, drop_partitions, partition_values, write_partitioned

PACKED = "packed-"


def _partition_columns(spark: SparkSession, table: str) -> list[str]:
    return [c.name for c in spark.catalog.listColumns(table) if c.isPartition]


def compact_merged(spark: SparkSession, table: str, target: str, cluster_by: Sequence[str] = ()) -> int:
    """Leave one batch folder in every partition of ``table``; returns how many partitions were packed.

    Partitions (such as months) that several batches wrote to are read and written once, as a
    batch of the name ``packed-…``; the others aren't touched.  Rows stay as they are but for
    their batch column.  Then the catalog gets the packed folder of one partition after the
    other and loses its old ones; a reader of that very partition may see rows twice between
    these two statements.  A run that dies is taken up again by the next.  Batches that were
    merged stay known, so one that is repeated afterwards still changes nothing.

    The names of the partitions to pack come to the driver, no file names and no rows.
    """
    slots = _partition_columns(spark, table)
    if slots == [BATCH_COLUMN]:
        raise ValueError(f"{table} has no partitions besides its batches: use tables.compact")
    for folder in _unpublished(spark, target):
        if not folder.rsplit("/", 1)[1].startswith(PACKED):
            raise ValueError(f"batch {folder} is not published: repeat it first")
        _publish(spark, table, folder)

    crowded = _crowded(spark, table)
    if crowded:
        name = f"{PACKED}{uuid.uuid4().hex[:12]}"
        root = f"{target}/{VERSIONS}/{name}"
        values = [partition_values(spark, folder) for folder in crowded]
        rows = (spark.read.table(table).filter(in_folders(slots[:-1], values))
                .drop(BATCH_COLUMN).withColumn(BATCH_COLUMN, F.lit(name)))
        if cluster_by:
            rows.hint("rebalance", *slots).sortWithinPartitions(*slots, *cluster_by).write.partitionBy(*slots).parquet(f"{root}/rows")
        else:
            write_partitioned(rows, f"{root}/rows", slots)
        fsio.write_text(spark, f"{root}/plan.json", json.dumps({"name": name, "packed": crowded}))
        _publish(spark, table, root)
    return len(crowded)


def _crowded(spark: SparkSession, table: str) -> dict[str, list[str]]:
    """The partitions that have several batches, with the full names of these."""
    above = F.regexp_replace("partition", f"/{BATCH_COLUMN}=[^/]*$", "")
    found = (spark.sql(f"SHOW PARTITIONS {table}").groupBy(above.alias("folder"))
             .agg(F.collect_list("partition").alias("batches")).filter(F.size("batches") > 1))
    return {r.folder: sorted(r.batches) for r in found.collect()}


def _unpublished(spark: SparkSession, target: str) -> list[str]:
    return [folder for folder in fsio.children(spark, f"{target}/{VERSIONS}")
            if fsio.exists(spark, f"{folder}/plan.json") and not fsio.exists(spark, f"{folder}/{PUBLISHED}")]


def _publish(spark: SparkSession, table: str, root: str) -> None:
    plan = json.loads(fsio.read_text(spark, f"{root}/plan.json"))
    for folder, old in plan["packed"].items():
        new = f"{folder}/{BATCH_COLUMN}={plan['name']}"
        add_partitions(spark, table, [new], f"{root}/rows")
        drop_partitions(spark, table, [name for name in old if name != new])
    spark.catalog.refreshTable(table)
    fsio.write_text(spark, f"{root}/{PUBLISHED}", "")


def unreferenced(spark: SparkSession, table: str, target: str) -> DataFrame:
    """(folder, version, changed) of the folders below ``_versions`` with files no partition of the table has."""
    file = F.col("_metadata.file_path")
    folder = F.regexp_replace(file, "/[^/]*$", "")
    there = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{target}/{VERSIONS}")
             .filter(file.rlike(f"/{VERSIONS}/[^/]*/rows/"))
             .groupBy(folder.alias("folder"), F.regexp_extract(file, f"/{VERSIONS}/([^/]*)/rows/", 1).alias("version"))
             .agg(F.max("_metadata.file_modification_time").alias("changed")))
    used = spark.read.table(table).select(folder.alias("folder")).distinct()
    return there.join(used, "folder", "left_anti")


def reclaim(spark: SparkSession, table: str, target: str, older_than: float = 86_400) -> int:
    """Remove the files of merged batches that no partition of ``table`` points at; returns how many folders went.

    The files there are and the files the table reads are listed by Spark and anti-joined; only
    folders to remove reach the driver, one by one.  Folders changed within ``older_than``
    seconds stay, for readers that began before their partition was switched, and so do those
    of a batch that isn't published.  What marks a batch as merged stays too.
    """
    spark.catalog.refreshTable(table)
    if not fsio.children(spark, f"{target}/{VERSIONS}"):
        return 0
    old = unreferenced(spark, table, target).filter(F.unix_timestamp("changed") <= time.time() - older_than)
    published: dict[str, bool] = {}
    gone = 0
    for row in old.toLocalIterator():
        if row.version not in published:
            published[row.version] = fsio.exists(spark, f"{target}/{VERSIONS}/{row.version}/{PUBLISHED}")
        if published[row.version]:
            gone += fsio.delete(spark, fsio.decoded(spark, row.folder))
    return gone
