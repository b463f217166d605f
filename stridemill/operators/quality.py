"""Declarative data-quality rules: name -> SQL predicate that marks a bad row.

A predicate that evaluates to NULL is no violation.  All predicates are evaluated in one
projection, each bad row carries every reason, and it is rejected once.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fsio
from ..functions.columns import all_reasons
from ..schemas import REJECT_COLUMNS
from ..session import run_dir
from .tables import BatchId, append_batch

# Rule names and predicates.
ACTIVITY_RULES = {
    "missing_id": "id IS NULL",
    "missing_start_date": "start_date IS NULL",
    "sport_type_missing": "sport_type IS NULL OR sport_type = ''",
    "neg_distance": "distance_km < 0",
    "zero_distance_run": "sport_type = 'Run' AND distance_km = 0",
    "speed_negative": "average_speed_kmh < 0",
    "speed_implausible_run": "sport_type = 'Run' AND average_speed_kmh > 30",
    "pace_negative": "pace_min_km_new < 0",
    "pace_null_when_should": "moving_time > 0 AND distance_km > 0 AND pace_min_km_new IS NULL",
}
DETAIL_RULES = {
    "missing_id": "id IS NULL",
    "missing_start_date": "athlete_id IS NULL",
    "neg_calories": "calories < 0",
}


def annotate(df: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """Add the four reject columns; they are NULL (count 0) on valid rows."""
    with_reasons = df.withColumn("reject_reasons", all_reasons(dict(rules)))
    return with_reasons.withColumns({
        "reject_reason_count": F.when(F.col("reject_reasons").isNull(), 0).otherwise(F.size("reject_reasons")),
        "reject_reason": F.array_join("reject_reasons", "|"),
        "reject_timestamp": F.current_timestamp(),
    })


def valid_rows(annotated: DataFrame) -> DataFrame:
    return annotated.filter(F.col("reject_reasons").isNull()).drop(*REJECT_COLUMNS)


def rejected_rows(annotated: DataFrame) -> DataFrame:
    return annotated.filter(F.col("reject_reasons").isNotNull())


@dataclass(frozen=True)
class Assessment:
    """Annotated rows staged for several reads, with their counts."""

    annotated: DataFrame
    total: int
    rejected: int
    location: str

    @property
    def valid(self) -> DataFrame:
        return valid_rows(self.annotated)

    @property
    def rejects(self) -> DataFrame:
        return rejected_rows(self.annotated)

    def release(self) -> None:
        fsio.delete(self.annotated.sparkSession, self.location)


def assess(df: DataFrame, rules: Mapping[str, str]) -> Assessment:
    """Annotate one micro-batch and write it to the shared folder, so that its source is read
    a single time whatever the batch's size, and a lost executor costs a read."""
    spark, location = df.sparkSession, run_dir(df.sparkSession, "assessed")
    annotated = annotate(df, rules)
    annotated.write.parquet(location)
    staged = spark.read.schema(annotated.schema).parquet(location)
    counts = staged.agg(F.count(F.lit(1)).alias("total"), F.count("reject_reasons").alias("rejected")).first()
    return Assessment(staged, counts["total"], counts["rejected"], location)


def assert_quality(df: DataFrame, rules: Mapping[str, str], reject_path: str, batch_id: BatchId = 0) -> Assessment:
    """Store the rejects of a batch, if it has any, and hand back the assessment.

    Rejects go to the batch's own partition, so a retried batch cannot add them twice.
    """
    outcome = assess(df, rules)
    if outcome.rejected:
        append_batch(outcome.rejects, reject_path, batch_id)
    return outcome
