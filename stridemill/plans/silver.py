"""Bronze to silver: dedupe, derive, validate, stamp, merge."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import columns as C
from ..functions import transforms as T
from ..operators.dedupe import dedupe_microbatch, latest_ingested
from ..operators.merge import merge_insert, merge_newest
from ..operators.quality import ACTIVITY_RULES, DETAIL_RULES, assert_quality
from ..operators.tables import BATCH_COLUMN, BatchId, append_rows, read_batches, replace_snapshot
from ..schemas import SILVER_COLUMNS
from ..streaming.runs import RunLog, batch_stream, finish

PACE_CLOCK = "pace_clock"


@dataclass(frozen=True)
class Edges:
    """What the measures give where their inputs have no plain answer."""

    non_run_pace: float | None = 0.0
    without_distance: float | None = 0.0
    carry_seconds: bool = True


@dataclass(frozen=True)
class Measure:
    """The bronze columns a derived column is made of, and how."""

    inputs: Sequence[str]
    build: Callable[[Mapping[str, str], Edges], Column]


def _new_pace(c: Mapping[str, str], e: Edges) -> Column:
    return C.moving_pace(c["moving_time"], c["distance"], without_distance=e.without_distance)


# Both loads make their derived columns from this one table.
MEASURES = {
    "start_date": Measure(["start_date"], lambda c, e: C.iso_date(c["start_date"])),
    "distance_km": Measure(["distance"], lambda c, e: C.kilometres(c["distance"])),
    "average_speed_kmh": Measure(["average_speed"], lambda c, e: C.km_per_hour(c["average_speed"])),
    "pace_min_km": Measure(["elapsed_time", "distance", "type"], lambda c, e: C.run_pace(
        c["elapsed_time"], c["distance"], c["type"], non_run_value=e.non_run_pace)),
    "pace_min_km_moving_time": Measure(["moving_time", "distance", "type"], lambda c, e: C.run_pace(
        c["moving_time"], c["distance"], c["type"], non_run_value=e.non_run_pace)),
    "tempo_real": Measure(["moving_time"], lambda c, e: C.hours_minutes_seconds(c["moving_time"])),
    "pace_min_km_new": Measure(["moving_time", "distance"], _new_pace),
    PACE_CLOCK: Measure(["moving_time", "distance"], lambda c, e: C.pace_clock(_new_pace(c, e), e.carry_seconds)),
    "dia_semana": Measure(["start_date"], lambda c, e: C.weekday(C.iso_date(c["start_date"]))),
}


def apply_all_silver_calcs(df: DataFrame, *, type_col: str = "type", distance_col: str = "distance",
                           average_speed_col: str = "average_speed", moving_time_col: str = "moving_time",
                           elapsed_time_col: str = "elapsed_time", start_date_col: str = "start_date",
                           non_run_value_for_pace: float | None = 0.0, pace_clock_col: str = PACE_CLOCK) -> DataFrame:
    """All derived activity measures in one projection."""
    names = {"type": type_col, "distance": distance_col, "average_speed": average_speed_col,
             "moving_time": moving_time_col, "elapsed_time": elapsed_time_col, "start_date": start_date_col}
    edges = Edges(non_run_pace=non_run_value_for_pace)
    return df.withColumns({pace_clock_col if name == PACE_CLOCK else name: measure.build(names, edges)
                           for name, measure in MEASURES.items()})


def apply_detail_calcs(df: DataFrame, *, start_date_col: str = "start_date") -> DataFrame:
    return df.transform(T.add_start_date, start_date_col)


def with_owner(bronze: DataFrame) -> DataFrame:
    return bronze.filter(F.col("athlete_id").isNotNull())


def without_owner(bronze: DataFrame) -> DataFrame:
    """Rows for the errors table."""
    return bronze.filter(F.col("athlete_id").isNull())


def rebuild_activities(bronze: DataFrame, columns: Sequence[str] = SILVER_COLUMNS, pace_clock_col: str = PACE_CLOCK,
                       stream_edges: bool = True) -> DataFrame:
    """Silver snapshot from bronze, whole or only the named columns.

    Bronze is cut to the inputs of ``columns`` before rows are compared, so a narrow request
    reads and shuffles narrow rows.  ``stream_edges`` keeps the incremental load's edge
    cases, so both loads agree.  Without it a missing distance gives a NULL pace and 60
    rounded seconds do not carry.
    """
    raw = [name for column in columns for name in (MEASURES[column].inputs if column in MEASURES else [column])]
    needed = dict.fromkeys(["athlete_id", "id", "start_date", "ingestion_timestamp", *raw])
    latest = latest_ingested(with_owner(bronze.select(*needed)))
    edges = Edges() if stream_edges else Edges(without_distance=None, carry_seconds=False)
    names = {name: name for measure in MEASURES.values() for name in measure.inputs}
    return latest.select(*[
        MEASURES[c].build(names, edges).alias(pace_clock_col if c == PACE_CLOCK else c) if c in MEASURES else F.col(c)
        for c in columns])


def rebuild_silver(spark: SparkSession, bronze: DataFrame, root: str, version: str, table: str | None = None,
                   errors_table: str | None = None, rebuild: Callable[[DataFrame], DataFrame] = rebuild_activities,
                   **options) -> str:
    """The batch silver job: rows without an owner are appended to the errors table, the rest is
    rebuilt whole, written as a new version under ``root`` and published as ``table``."""
    if errors_table:
        append_rows(without_owner(bronze), errors_table)
    return replace_snapshot(rebuild(bronze, **options), root, version, table)


def rebuild_details(bronze: DataFrame) -> DataFrame:
    return apply_detail_calcs(latest_ingested(with_owner(bronze)))


MONTH = "start_month"


@dataclass(frozen=True)
class SilverLoad:
    """What one entity's bronze-to-silver load needs to know.

    ``keep="first"``: deliveries are deduplicated within their batch, then checked, and what
    the table lacks is inserted; where a backlog is cut into batches decides which delivery of
    a redelivered row stays.  ``keep="newest"``: every delivery is checked, and the newest
    valid one of its business key stays; the result is the same however batches are cut.

    The table is laid out by the month of the activity.  Inserting reads only the months of
    the batch; for ``newest`` a row may move between months, so the months of every key are
    kept beside the table, and those of the batch's keys are read.

    ``followers`` are called after each batch is merged, and again when it is repeated: tables
    that are kept up to date with this one (see :mod:`summaries`).
    """

    target: str
    rejects: str
    derive: Callable[[DataFrame], DataFrame]
    rules: Mapping[str, str]
    business_keys: Sequence[str] = ("athlete_id", "id")
    order_cols: Sequence[str] = ("ingestion_timestamp",)
    merge_keys: Sequence[str] = ("athlete_id", "id", "start_date")
    keep: str = "first"
    catalog_table: str | None = None
    followers: Sequence[Callable[[SparkSession, BatchId], None]] = ()
    counts: dict[BatchId, int] = field(default_factory=dict)

    def run_batch(self, batch: DataFrame, batch_id: BatchId) -> None:
        """One micro-batch.  Every step can be repeated after a crash without a trace."""
        newest = self.keep == "newest"
        rows = batch if newest else dedupe_microbatch(batch, self.business_keys, self.order_cols)
        checked = assert_quality(self.derive(rows), self.rules, self.rejects, batch_id)
        try:
            valid = T.add_silver_ingestion_time(checked.valid).withColumn(MONTH, F.date_format("start_date", "yyyy-MM"))
            if newest:
                merge_newest(valid, self.target, self.business_keys, [MONTH], batch_id, newest_by=self.order_cols[0],
                             catalog_table=self.catalog_table, places=f"{self.target}/_places")
            else:
                merge_insert(valid, self.target, self.merge_keys, batch_id, prune_by=MONTH, partitions=[MONTH],
                             catalog_table=self.catalog_table)
            self.counts[batch_id] = self.inserted(batch.sparkSession, batch_id, valid)
        finally:
            checked.release()
        for follow in self.followers:
            follow(batch.sparkSession, batch_id)

    def inserted(self, spark: SparkSession, batch_id: BatchId, valid: DataFrame) -> int:
        """Rows of the table that the batch brought."""
        rows = (spark.read.table(self.catalog_table) if self.catalog_table
                else read_batches(spark, self.target, valid.schema))
        return rows.filter(F.col(BATCH_COLUMN) == str(batch_id)).count()

    def run_stream(self, bronze: DataFrame, checkpoint: str, name: str = "silver") -> RunLog:
        return finish(batch_stream(bronze, self.run_batch, checkpoint, name), self.counts)


def activity_load(target: str, rejects: str, **options) -> SilverLoad:
    return SilverLoad(target, rejects, apply_all_silver_calcs, ACTIVITY_RULES, **options)


def detail_load(target: str, rejects: str, **options) -> SilverLoad:
    return SilverLoad(target, rejects, apply_detail_calcs, DETAIL_RULES, **options)


def silver_schema(bronze_schema: StructType, spark, derive: Callable[[DataFrame], DataFrame]) -> StructType:
    """Schema of the silver table that a load makes of a bronze schema."""
    return T.add_silver_ingestion_time(derive(spark.createDataFrame([], bronze_schema))).schema
