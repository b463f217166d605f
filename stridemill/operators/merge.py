"""Insert-only and upsert merges for tables that are plain columnar files.

Both kinds of table keep a batch id as their innermost partition column.  A batch writes
only folders that carry its own id, so repeating it replaces its own rows and nothing else.

With ``catalog_table`` a merge works on that table, which it creates on first use.  Nothing
is moved then: the new files stay where they were written and the catalog's partitions are
pointed at them, one by one, so a reader of the table sees a partition's old rows or its new
ones.  Without it the table is a folder, and its folders are replaced by renames; readers of
a bare folder must not run beside an updating merge.

Neither merge shuffles its target when the source is a modest micro-batch.  The target is
first narrowed to the keys the source carries: file statistics prune by the source's range
of one key column, then a semi-join against the source's keys, which Spark runs as a
broadcast when those keys are measured below ``spark.sql.autoBroadcastJoinThreshold`` and
as a sort-merge join with skew splitting beyond it.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import fsio
from ..session import shared_dir
from .dedupe import dedupe_microbatch
from .filters import in_folders, key_match, matched, unmatched, value_range, value_set
from .places import KeyPlaces
from .tables import (BATCH_COLUMN, BatchId, add_partitions, append_batch, batch_path, create_partitioned,
                     drop_partitions, read_batches, write_partitioned)


# What a merge through the catalog writes lies here, a folder for each batch with its rows, its
# plan and, once the catalog points at the rows, a mark.
VERSIONS, PUBLISHED = "_versions", "_published"


def merge_insert(source: DataFrame, target: str, keys: Sequence[str], batch_id: BatchId, *, null_safe: bool = True,
                 prune_by: str | None = None, partitions: Sequence[str] = (), catalog_table: str | None = None) -> bool:
    """Insert the rows whose keys the target table lacks; existing rows stay untouched.

    ``source`` is read more than once, so a caller with an expensive plan stages it.  A
    replayed batch changes nothing, which also holds with ``null_safe=False``, where rows
    with a NULL key always count as new.  ``partitions`` lay the table out in folders above
    those of the batches; pruning by one of them reads only the folders the batch has rows for.
    """
    spark = source.sparkSession
    if partitions:
        _rewrite(source, None, lambda current: unmatched(source, current, keys, null_safe), target, keys, partitions,
                 batch_id, source.schema, prune_by, null_safe, catalog_table)
        return True
    if fsio.is_committed(spark, batch_path(target, batch_id)):
        return False
    existing = read_batches(spark, target, StructType([source.schema[k] for k in keys]))
    existing = existing.filter(F.col(BATCH_COLUMN) != str(batch_id))
    if prune_by:
        existing = existing.filter(value_range(source, prune_by))
    fresh = unmatched(source, existing, keys, null_safe)
    if prune_by:
        fresh = fresh.sortWithinPartitions(prune_by)
    done = append_batch(fresh, target, batch_id)
    if catalog_table:
        ensure_table(spark, catalog_table, source.schema, (), target)
        add_partitions(spark, catalog_table, [f"{BATCH_COLUMN}={batch_id}"])
    return done


def ensure_table(spark: SparkSession, name: str, schema: StructType, partitions: Sequence[str], location: str) -> None:
    """The catalog entry of a merged table."""
    if not spark.catalog.tableExists(name):
        fields = StructType([f for f in schema.fields if f.name != BATCH_COLUMN]).add(BATCH_COLUMN, "string")
        create_partitioned(spark, name, fields, [*partitions, BATCH_COLUMN], location)


def merge_newest(source: DataFrame, target: str, keys: Sequence[str], partitions: Sequence[str], batch_id: BatchId, *,
                 newest_by: str, prune_by: str | None = None, catalog_table: str | None = None,
                 places: str | None = None) -> int:
    """Keep the newest row of every key, whichever batch brings it and in whatever order.

    The result doesn't depend on how deliveries are cut into batches.  Keys match null-safely.
    A key's rows must lie in partitions that ``prune_by`` keeps together.  ``places`` names a
    folder in which the merge keeps where every key lies (see :mod:`places`): it then reads
    only the partitions of the batch's keys, however rows move between partitions.
    """
    def rows(current: DataFrame) -> DataFrame:
        known = matched(current.select(*source.columns), source, keys, null_safe=True)
        return dedupe_microbatch(known.unionByName(source), keys, (newest_by,))

    known = KeyPlaces(places, keys, partitions) if places else None
    return _rewrite(source, source, rows, target, keys, partitions, batch_id, source.schema, prune_by, True,
                    catalog_table, known)


def upsert_data(batch: DataFrame, batch_id: BatchId, target_table: str, key_columns: Sequence[str],
                temp_view_name: str | None = None) -> bool:
    """Insert-only merge under a dynamic key list; also publishes the batch as a view."""
    if temp_view_name:
        batch.createOrReplaceTempView(temp_view_name)
    return merge_insert(batch, target_table, key_columns, batch_id)


def merge_upsert(source: DataFrame, target: str, keys: Sequence[str], partitions: Sequence[str],
                 batch_id: BatchId, *, schema: StructType | None = None, order_cols: Sequence[str] = (),
                 prune_by: str | None = None, null_keys: str = "identity", catalog_table: str | None = None) -> int:
    """Update the rows whose keys match, insert the others; returns how many folders it rewrote.

    Of several source rows with one complete key the first under ``order_cols`` (descending,
    totally ordered) is taken.  A row with a NULL in its key matches nothing under ``=``:

    * ``"identity"``: it is inserted unless an identical row is there, so repeated input is
      harmless and two different rows that share the NULL key both survive;
    * ``"insert"``: it is always inserted.
    """
    if null_keys not in ("identity", "insert"):
        raise ValueError(f"unknown null_keys: {null_keys}")
    names = (schema or source.schema).names
    source = source.select(*names)
    has_key = reduce(and_, [F.col(k).isNotNull() for k in keys])
    complete = dedupe_microbatch(source.filter(has_key), keys, order_cols)
    partial = source.filter(~has_key)

    def rows(current: DataFrame) -> DataFrame:
        if null_keys == "insert":
            return complete.unionByName(partial)
        return complete.unionByName(unmatched(partial, current.filter(~has_key), names))

    return _rewrite(source, source.filter(has_key), rows, target, keys, partitions, batch_id, schema, prune_by,
                    False, catalog_table)


def merge_groups(source: DataFrame, target: str, keys: Sequence[str], partitions: Sequence[str],
                 batch_id: BatchId, *, schema: StructType | None = None, prune_by: str | None = None,
                 catalog_table: str | None = None, groups: DataFrame | None = None) -> int:
    """Replace every group of ``keys`` that the source has, as a whole; NULL keys form groups too.

    ``groups`` names the groups to replace instead: one without rows in the source disappears.
    """
    schema = schema or source.schema
    source = source.select(*schema.names)
    groups = source if groups is None else groups
    return _rewrite(groups, groups, lambda current: source, target, keys, partitions, batch_id, schema, prune_by,
                    True, catalog_table)


def changed_values(spark: SparkSession, target: str, batch_id: BatchId, column: str) -> set[str | None]:
    """Values of a partition column where a batch merged through the catalog added, changed or removed rows.

    They stand in the batch's plan, which outlasts the batch, so they are known after a crash.
    A row that moved to another partition counts in both.
    """
    plan = json.loads(fsio.read_text(spark, f"{target}/{VERSIONS}/{_safe(str(batch_id))}/plan.json"))
    naming = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    values = {part.partition("=")[2] for folder in [*plan["rewritten"], *plan["written"]]
              for part in folder.split("/") if part.startswith(f"{column}=")}
    absent = naming.DEFAULT_PARTITION_NAME()
    return {None if v == absent else naming.unescapePathName(v) for v in values}


def _rewrite(source: DataFrame, matching: DataFrame | None, new_rows: Callable[[DataFrame], DataFrame], target: str,
             keys: Sequence[str], partitions: Sequence[str], batch_id: BatchId, schema: StructType | None,
             prune_by: str | None, null_safe: bool, catalog_table: str | None, places: KeyPlaces | None = None) -> int:
    """Common part of the partitioned merges.

    New rows go to folders of their own batch.  Older folders are rewritten only if they
    hold a row that ``matching`` replaces, so a batch that merely inserts rewrites nothing,
    whatever the size of the partition it inserts into.  The list of such folders is bounded
    by the table's folder count and is all the driver sees.

    The result is staged completely before it is published, so rows are written once.  A
    batch that dies in between is finished from its staged copy on retry.  ``source`` is read
    more than once, so a caller with an expensive plan stages it.
    """
    spark, batch = source.sparkSession, str(batch_id)
    schema = schema or source.schema
    slots = [*partitions, BATCH_COLUMN]
    stage = f"{target}/{VERSIONS}/{_safe(batch)}" if catalog_table else staging_folder(spark, target, batch)
    if catalog_table:
        if fsio.exists(spark, f"{stage}/{PUBLISHED}"):  # a repeated batch; its files may be gone or outdated
            return len(json.loads(fsio.read_text(spark, f"{stage}/plan.json"))["rewritten"])
        ensure_table(spark, catalog_table, schema, partitions, target)

    if not fsio.exists(spark, f"{stage}/plan.json"):
        table = spark.read.table(catalog_table) if catalog_table else read_batches(spark, target, schema)
        table = table.select(*dict.fromkeys([*schema.names, *slots]))
        current = table.filter(F.col(BATCH_COLUMN) != batch)
        prune = value_set if prune_by in partitions else value_range
        candidates = current.filter(prune(source, prune_by)) if prune_by else current
        if places:
            candidates = candidates.filter(places.within(source, current, batch))
        touched = table.filter(F.col(BATCH_COLUMN) == batch).select(*slots)  # left by a run whose staged copy is gone
        if matching is not None:
            touched = touched.unionByName(matched(candidates.select(*dict.fromkeys([*keys, *slots])), matching, keys,
                                                  null_safe).select(*slots))
        touched = [tuple(r) for r in touched.distinct().collect()]
        fresh = new_rows(candidates.drop(BATCH_COLUMN)).withColumn(BATCH_COLUMN, F.lit(batch))
        if touched and matching is not None:
            wanted = matching.select(*keys).distinct()
            kept = current.filter(in_folders(slots, touched)).alias("t").join(
                wanted.alias("s"), key_match("t", "s", keys, null_safe), "left_anti")
            fresh = kept.unionByName(fresh)
        write_partitioned(fresh, f"{stage}/rows", slots)
        fsio.write_text(spark, f"{stage}/plan.json", json.dumps({
            "rewritten": [_folder_name(spark, slots, values) for values in touched],
            "written": fsio.folders(spark, f"{stage}/rows", len(slots))}))

    plan = json.loads(fsio.read_text(spark, f"{stage}/plan.json"))
    emptied = sorted(set(plan["rewritten"]) - set(plan["written"]))
    if catalog_table:
        add_partitions(spark, catalog_table, plan["written"], f"{stage}/rows")
        drop_partitions(spark, catalog_table, emptied)  # all their rows were replaced
        spark.catalog.refreshTable(catalog_table)
        fsio.write_text(spark, f"{stage}/{PUBLISHED}", "")
        return len(plan["rewritten"])
    movable = fsio.same_file_system(spark, stage, target)
    if plan["written"] and not movable:  # renames do not cross file systems: copy as a Spark job
        (read_batches(spark, f"{stage}/rows", schema).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy(*slots).parquet(target))
    for folder in plan["written"] if movable else []:
        if fsio.exists(spark, f"{stage}/rows/{folder}"):  # else moved before an interruption
            fsio.delete(spark, f"{target}/{folder}")
            fsio.rename(spark, f"{stage}/rows/{folder}", f"{target}/{folder}")
    for folder in emptied:
        fsio.delete(spark, f"{target}/{folder}")
    _forget_older(spark, stage)
    return len(plan["rewritten"])


def staging_folder(spark: SparkSession, target: str, batch_id: BatchId) -> str:
    """Where a batch's result waits; the same after a restart, in the shared folder."""
    digest = hashlib.md5(target.encode("utf-8")).hexdigest()
    query, _, number = str(batch_id).rpartition("-")
    return f"{shared_dir(spark)}/stridemill/upsert/{digest}/{_safe(query) or 'direct'}/batch={_safe(number)}"


def _safe(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9-]", "_", name)


def _folder_name(spark: SparkSession, slots: Sequence[str], values: tuple) -> str:
    naming = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    return "/".join(naming.getPartitionPathString(c, None if v is None else str(v))
                    for c, v in zip(slots, values))


def _forget_older(spark: SparkSession, stage: str) -> None:
    """Drop the staged copies of a writer's earlier batches; numbers tell which are earlier."""
    parent, name = stage.rsplit("/", 1)
    newest = name.split("=")[1]
    for path in fsio.children(spark, parent):
        number = path.rsplit("=", 1)[1]
        if newest.isdigit() and number.isdigit() and int(number) < int(newest):
            fsio.delete(spark, path)
