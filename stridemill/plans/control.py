"""Load control: who loads in full, who from where, and which details are pending."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.transforms import convert_to_unix
from ..operators.dedupe import distinct_by_key, first_value_nulls_first
from ..operators.filters import matched, value_set
from ..operators.joins import load_mode
from ..operators.merge import merge_upsert
from ..operators.tables import BatchId, export_single_csv, held, replace_managed
from ..streaming.runs import RunLog, batch_stream, finish


def control_table(silver: DataFrame) -> DataFrame:
    """Last activity and first ingestion of each athlete.

    Both are taken in one aggregate, which replaces two ranked windows and their join: a
    single exchange of one partial row per athlete and task.
    """
    return _finished(silver.filter(F.col("athlete_id").isNotNull()).groupBy("athlete_id").agg(
        F.max("start_date").alias("start_date"),
        first_value_nulls_first("ingestion_timestamp").alias("ingestion_timestamp")))


def _finished(owners: DataFrame) -> DataFrame:
    flagged = owners.withColumn("full_carga", F.lit(False))
    return flagged.transform(convert_to_unix, "start_date").transform(convert_to_unix, "ingestion_timestamp")


class ControlState:
    """The control table's facts of every athlete, kept up to date batch by batch.

    A batch is summed to a row per athlete first, and only these athletes' rows of the state
    are read (in the buckets they hash to) and replaced.  Latest activity, first ingestion and
    "some ingestion is missing" only ever grow, so batches may come in any order and be
    repeated.  It follows what was inserted: a row that an update takes away or back in time
    stays counted, and :func:`control_table` over the whole table corrects that.
    """

    buckets = 64

    def __init__(self, target: str, catalog_table: str):
        self.target, self.catalog_table = target, catalog_table

    def run_batch(self, batch: DataFrame, batch_id: BatchId) -> None:
        """Merge one batch of silver rows."""
        spark = batch.sparkSession
        stamp = F.col("ingestion_timestamp")
        seen = (batch.filter(F.col("athlete_id").isNotNull()).groupBy("athlete_id").agg(
            F.max("start_date").alias("last"), F.min(stamp).alias("first"), F.bool_or(stamp.isNull()).alias("unstamped"))
            .withColumn("bucket", F.pmod(F.xxhash64("athlete_id"), F.lit(self.buckets)).cast("int")))
        with held(seen, "control") as rows:
            both = rows
            if spark.catalog.tableExists(self.catalog_table):
                state = spark.read.table(self.catalog_table).select(*rows.columns).filter(value_set(rows, "bucket"))
                both = rows.unionByName(matched(state, rows, ["athlete_id"], null_safe=False))
            merged = both.groupBy("athlete_id", "bucket").agg(
                F.max("last").alias("last"), F.min("first").alias("first"), F.bool_or("unstamped").alias("unstamped"))
            with held(merged.select(*rows.columns), "control-merged") as news:
                merge_upsert(news, self.target, ["athlete_id"], ["bucket"], batch_id, prune_by="bucket",
                             catalog_table=self.catalog_table)

    def run_stream(self, silver: DataFrame, checkpoint: str) -> RunLog:
        return finish(batch_stream(silver, self.run_batch, checkpoint, "control"))

    def table(self, spark: SparkSession) -> DataFrame:
        """What :func:`control_table` gives over all rows merged so far."""
        return _finished(spark.read.table(self.catalog_table).select(
            "athlete_id", F.col("last").alias("start_date"),
            F.when(~F.col("unstamped"), F.col("first")).alias("ingestion_timestamp")))


def publish_control(control: DataFrame, csv_path: str, table: str) -> None:
    """The control table as a managed table, and from it as one CSV for the intake side."""
    replace_managed(control, table)
    export_single_csv(control.sparkSession.read.table(table), csv_path)


def split_by_mode(athletes: DataFrame, control: DataFrame, athlete_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """Athletes to load in full, and athletes to load incrementally."""
    modes = load_mode(athletes, control, athlete_col)
    return modes.filter("full_carga"), modes.filter("not full_carga")


def incremental_after(landed: DataFrame, modes: DataFrame, stamp: str = "start_ts",
                      owner: str = "athlete_id") -> DataFrame:
    """Landed records after each athlete's high-water mark.

    All of them for a full load or without a mark, and so for records without an owner or of
    an athlete that ``modes`` doesn't list.
    """
    # an athlete landed several times must not multiply its records
    marks = modes.select(F.col("athlete_id_json").alias(owner), "full_carga", "start_date_unix").distinct()
    mark = F.col("start_date_unix")
    wanted = F.coalesce("full_carga", F.lit(True)) | mark.isNull() | (F.unix_timestamp(stamp) > mark)
    return landed.join(marks, owner, "left").filter(wanted).drop("full_carga", "start_date_unix")


def pending_detail_ids(activities: DataFrame, details: DataFrame | None = None, key: str = "id") -> DataFrame:
    """Distinct non-null activity ids to fetch details for, less those already there."""
    ids = distinct_by_key(activities, key, "id_activity")
    if details is None:
        return ids
    return ids.join(details.select(F.col(key).alias("id_activity")).distinct(), "id_activity", "left_anti")
