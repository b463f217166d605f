"""The run log of a stream whose driver died before :func:`runs.finish` could return it."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fsio
from ..operators.tables import BATCH_COLUMN
from .runs import RunLog

OFFSETS = "source int, batch long, reached long, started long"


def committed_batches(spark: SparkSession, checkpoint: str) -> list[int]:
    """Numbers of the batches whose commit Spark still keeps."""
    names = (p.rsplit("/", 1)[1] for p in fsio.children(spark, f"{checkpoint}/commits"))
    return sorted(int(name) for name in names if name.isdigit())


def _offsets(spark: SparkSession, checkpoint: str) -> DataFrame:
    """How far each batch went in the log of each of its file sources, and when it started (ms)."""
    lines = (spark.read.text(f"{checkpoint}/offsets/*", wholetext=True)
             .select(F.col("_metadata.file_name").cast("long").alias("batch"), F.split("value", "\n").alias("lines")))
    return (lines.select("batch", F.get_json_object(F.get("lines", F.lit(1)), "$.batchTimestampMs").cast("long").alias("started"),
                         F.posexplode(F.slice("lines", 3, F.size("lines"))).alias("source", "offset"))
            .select("source", "batch", F.get_json_object("offset", "$.logOffset").cast("long").alias("reached"), "started"))


def _read_files(spark: SparkSession, checkpoint: str, offsets: DataFrame, first: int) -> DataFrame:
    """(path, modified, batch) of every file that a batch after ``first`` took.

    A source numbers its own steps: a batch takes those after its predecessor's last one, which
    are several where a driver died between the source's step and the batch's offset.
    """
    steps = (spark.read.schema("path string, timestamp long, batchId long").json(f"{checkpoint}/sources/*/*")
             .select(F.regexp_extract("_metadata.file_path", r"/sources/(\d+)/", 1).cast("int").alias("source"),
                     "path", F.col("timestamp").alias("modified"), F.col("batchId").alias("step"))
             .filter("path IS NOT NULL").distinct())
    later = offsets.alias("o").join(F.broadcast(offsets.select("source", "reached", "batch")).alias("b"), (
        F.col("o.source") == F.col("b.source")) & (F.col("b.batch") == F.col("o.batch") - 1), "left")
    spans = later.filter(F.col("o.batch") > first).select(
        "o.source", "o.batch", "o.reached", F.coalesce("b.reached", F.lit(-1)).alias("passed"))
    # One row for each batch that Spark retains.
    return (steps.alias("s").join(F.broadcast(spans).alias("o"), (F.col("s.source") == F.col("o.source"))
                                  & (F.col("step") > F.col("passed")) & (F.col("step") <= F.col("reached")))
            .select("path", "modified", "batch"))


def _path(column: str) -> Column:
    """Scans and logs write a local path with different numbers of slashes."""
    return F.regexp_replace(column, "^file:/+", "file:/")


def _rows_read(landed: DataFrame, files: DataFrame) -> DataFrame:
    """(batch, input): rows of a scan that lie in each batch's files.

    The files' times leave the others out when the scan is planned; no column is read.
    """
    low, high = files.agg(F.min("modified"), F.max("modified")).first()
    changed = F.col("_metadata.file_modification_time")
    counted = (landed.filter((changed >= F.timestamp_millis(F.lit(low))) & (changed < F.timestamp_millis(F.lit(high) + 1)))
               .groupBy(_path("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("n")))
    return (files.select(_path("path").alias("path"), "batch").join(counted, "path")
            .groupBy("batch").agg(F.sum("n").alias("input")))


def _rows_in_files(written: DataFrame, starts: list[tuple[int, int]]) -> DataFrame:
    """(batch, output): rows of the committed files that came between a batch's start and the next one's."""
    numbers, times = zip(*starts)
    begun = F.array(*[F.timestamp_millis(F.lit(t)) for t in times])
    late = F.size(F.filter(begun, lambda t: t <= F.col("changed")))
    return (written.groupBy(F.col("_metadata.file_modification_time").alias("changed")).agg(F.count(F.lit(1)).alias("n"))
            .filter(late > 0).groupBy(F.element_at(F.array(*map(F.lit, numbers)), late).cast("long").alias("batch"))
            .agg(F.sum("n").alias("output")))


def rebuilt_log(spark: SparkSession, checkpoint: str, name: str, landed: DataFrame, written: DataFrame) -> RunLog:
    """Entries of every committed batch of a stream over files, from what it left on disk.

    ``landed`` is a plain batch scan of what the stream reads, ``written`` one of what it writes.
    Batches come from offsets and commits, input rows from the files the source's log names for
    them.  Output rows are those with the batch's name where ``written`` has a ``_batch_id`` (a
    ``foreachBatch`` stream), else those of the file sink's committed files by their time; the
    file system's clock and the driver's must then agree, or rows count for a neighbouring batch.

    Batches without an input row are no entries.  A row counts once, while a live run counts it
    each time a callback reads its batch.  Files that were archived or removed since
    count nothing, so rebuild before archiving, and before an upsert replaces a batch's rows.
    Spark retains ``spark.sql.streaming.minBatchesToRetain`` batches (100); of a longer history
    the oldest of them only tells where the next one starts.  At most so many entries reach the
    driver.  A stream that never committed has an empty log.
    """
    commits = committed_batches(spark, checkpoint)
    if not commits:
        return RunLog()
    first = -1 if commits[0] == 0 else commits[0]
    offsets = spark.createDataFrame(_offsets(spark, checkpoint).collect(), OFFSETS)
    starts = sorted((r["batch"], r["started"]) for r in offsets.groupBy("batch").agg(F.min("started").alias("started")).collect())
    read = _rows_read(landed, _read_files(spark, checkpoint, offsets, first))
    if BATCH_COLUMN in written.columns:
        query = json.loads(fsio.read_text(spark, f"{checkpoint}/metadata"))["id"]
        batch = F.col(BATCH_COLUMN).cast("string")
        out = (written.filter(batch.startswith(f"{query}-")).groupBy(F.substring_index(batch, "-", -1).cast("long").alias("batch"))
               .agg(F.count(F.lit(1)).alias("output")))
    else:
        out = _rows_in_files(written, starts)
    started, log = dict(starts), RunLog()
    for row in read.join(out, "batch", "left").na.fill(0, ["output"]).orderBy("batch").collect():
        if row["batch"] in commits:
            begun = datetime.fromtimestamp(started[row["batch"]] / 1000, timezone.utc).isoformat(timespec="milliseconds")
            log.append({"query": name, "batchId": row["batch"], "inputRows": row["input"], "outputRows": row["output"],
                        "timestamp": begun.replace("+00:00", "Z")})
    return log


def recover_log(spark: SparkSession, table: str, checkpoint: str, name: str, landed: DataFrame, written: DataFrame) -> RunLog:
    """Append to a log table the entries it lacks of a stream's committed batches, and return them.

    Run it before a stream starts again.  A second call appends nothing.  Entries of an earlier
    checkpoint under the same name are older than this one's ``metadata`` and don't count as known.
    """
    if not committed_batches(spark, checkpoint):
        return RunLog()
    since = spark.read.text(f"{checkpoint}/metadata").select("_metadata.file_modification_time").first()[0]
    known = {}
    if spark.catalog.tableExists(table):
        # As many as there are batches of this checkpoint that Spark still retains.
        oldest = committed_batches(spark, checkpoint)[0]
        rows = (spark.read.table(table).filter((F.col("query") == name) & (F.col("batchId") >= oldest)
                                               & (F.col("timestamp").cast("timestamp") >= F.date_trunc("second", F.lit(since)))))
        known = {row["batchId"] for row in rows.select("batchId").distinct().collect()}
    lacking = RunLog(entry for entry in rebuilt_log(spark, checkpoint, name, landed, written)
                     if entry["batchId"] not in known)
    if lacking:
        lacking.append_to(spark, table)
    return lacking
