"""Weekly and monthly summaries kept up to date with the silver table."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.aggregates import iso_year_of, monthly_distribution, weekly_summary
from ..operators.filters import matched, value_set
from ..operators.merge import changed_values, merge_groups
from ..operators.tables import BatchId, held
from .silver import MONTH


@dataclass(frozen=True)
class Summary:
    """A summary of activities, and the period that a day belongs to, column by column."""

    compute: Callable[[DataFrame], DataFrame]
    period: Mapping[str, Callable[[Column], Column]]


WEEKLY = Summary(weekly_summary, {"year": F.year, "week": F.weekofyear})
ISO_WEEKLY = Summary(partial(weekly_summary, iso_year=True), {"year": iso_year_of, "week": F.weekofyear})
MONTHLY = Summary(monthly_distribution, {"month": lambda day: F.trunc(day, "MM")})


class SummaryTable:
    """A summary of a silver table, of which every silver batch recomputes just the periods it touches.

    Make it a follower of the silver load.  The months that a batch changed stand in the
    merge's plan, also those that a corrected activity left.  The periods with a day in them are
    computed anew from the table, of which only the months with days of these periods are
    read, and replaced whole; a period that has no activity any more disappears.  So the table
    equals the full aggregate after late, corrected and repeated rows.  Batches are followed
    in the order in which they were merged.
    """

    def __init__(self, silver_table: str, silver_folder: str, target: str, catalog_table: str,
                 summary: Summary = WEEKLY):
        self.silver_table, self.silver_folder = silver_table, silver_folder
        self.target, self.catalog_table, self.summary = target, catalog_table, summary

    def follow(self, spark: SparkSession, batch_id: BatchId) -> None:
        """Bring in what a merged silver batch changed."""
        self.refresh(spark, changed_values(spark, self.silver_folder, batch_id, MONTH), batch_id)

    def start(self, spark: SparkSession, name: BatchId) -> None:
        """Summarize a silver table that has rows already."""
        self.refresh(spark, [r[0] for r in spark.read.table(self.silver_table).select(MONTH).distinct().collect()], name)

    def refresh(self, spark: SparkSession, months: Iterable[str | None], batch_id: BatchId) -> None:
        """Recompute the periods that have a day in one of the months (``yyyy-MM``; None: no date)."""
        months = list(months)
        if not months:
            return
        keys = list(self.summary.period)
        with held(self._touched(spark, months), "periods") as touched:
            dated = touched.filter(F.col("day").isNotNull())
            read = value_set(dated.select(F.date_format("day", "yyyy-MM").alias(MONTH)), MONTH)
            if None in months:
                read |= F.col(MONTH).isNull()
            groups = touched.select(*keys).distinct()
            rows = self.summary.compute(spark.read.table(self.silver_table).filter(read))
            merge_groups(matched(rows, groups, keys, null_safe=True), self.target, keys, keys[:1], batch_id,
                         prune_by=keys[0], catalog_table=self.catalog_table, groups=groups)

    def _touched(self, spark: SparkSession, months: list[str | None]) -> DataFrame:
        """Every day of every period that has a day in one of the months; a missing date is a day of its own.

        A period may have days in two years and in months apart, so the calendar goes from the
        year before to the year after; its size doesn't depend on the data.
        """
        years = spark.createDataFrame([(int(m[:4]),) for m in months if m], "year int").distinct()
        calendar = years.select(F.explode(F.sequence(F.make_date(F.col("year") - 1, F.lit(1), F.lit(1)),
                                                     F.make_date(F.col("year") + 1, F.lit(12), F.lit(31)))).alias("day")).distinct()
        if None in months:
            calendar = calendar.unionByName(spark.createDataFrame([(None,)], "day date"))
        days = calendar.select("day", *[of(F.col("day")).alias(name) for name, of in self.summary.period.items()])
        month = F.date_format("day", "yyyy-MM")
        hit = month.isin([m for m in months if m]) | F.col("day").isNull()
        return matched(days, days.filter(hit), list(self.summary.period), null_safe=True)
