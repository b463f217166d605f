"""Summaries and checks.  Each is a partial-then-final aggregate over few or well-spread groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact_sum(column: str, decimals: int = 2) -> Column:
    """Sum of values already rounded to ``decimals``, through whole numbers.

    A sum of doubles depends on the order in which tasks finish; this one does not.
    """
    scale = 10 ** decimals
    return F.sum(F.round(F.col(column) * scale).cast("long")) / F.lit(float(scale))


def decimal_sum(column: str) -> Column:
    """Sum of doubles in six decimals, which no order of tasks changes."""
    return F.sum(F.col(column).try_cast("decimal(28,6)")).cast("double")


def exact_avg(column: str, decimals: int = 2) -> Column:
    return F.try_divide(exact_sum(column, decimals), F.count(column))


def iso_year_of(day: Column) -> Column:
    """The year that an ISO week is counted in."""
    return F.extract(F.lit("YEAROFWEEK"), day).cast("int")


def weekly_summary(activities: DataFrame, sport: str = "Run", iso_year: bool = False) -> DataFrame:
    """Totals and averages of one sport per week.

    The default pairs the calendar year with the ISO week, so the days around New Year may
    fall into the other end of the same year; ``iso_year=True`` keeps such weeks whole.
    """
    day = F.col("start_date")
    year = iso_year_of(day) if iso_year else F.year(day)
    return (activities.filter(F.col("sport_type") == sport)
            .groupBy(year.alias("year"), F.weekofyear(day).alias("week"))
            .agg(F.count(F.lit(1)).alias("total_activities"),
                 F.round(exact_sum("distance_km"), 2).alias("total_distance_km"),
                 F.round(decimal_sum("total_elevation_gain"), 2).alias("total_elevation_gain"),
                 F.round(exact_avg("pace_min_km"), 2).alias("avg_pace_min_km"),
                 F.round(exact_avg("average_speed_kmh"), 2).alias("avg_speed_kmh")))


def monthly_distribution(activities: DataFrame) -> DataFrame:
    """Activities, distance and climb per month and sport, with metres climbed per kilometre."""
    month = F.trunc("start_date", "MM")
    km, climb = exact_sum("distance_km"), decimal_sum("total_elevation_gain")
    return (activities.groupBy(month.alias("month"), "sport_type")
            .agg(F.count(F.lit(1)).alias("total_activities"),
                 F.round(km, 2).alias("total_distance_km"),
                 F.round(climb, 2).alias("total_elevation_gain"),
                 F.round(F.when(km > 0, climb / km), 2).alias("elevation_gain_per_km")))


def elevation_per_km(activities: DataFrame) -> DataFrame:
    """Climb per kilometre of each activity; NULL without a positive distance."""
    ratio = F.when(F.col("distance_km") > 0, F.col("total_elevation_gain") / F.col("distance_km"))
    return activities.withColumn("elevation_gain_per_km", F.round(ratio, 2))


def period_over_period(periods: DataFrame, order: Sequence[str], measures: Sequence[str],
                       by: Sequence[str] = ()) -> DataFrame:
    """Each period beside the one before it.

    Runs on an already aggregated frame, one row per period (and ``by`` group).  Without ``by``
    all periods meet in one task, whose size the calendar bounds.
    """
    earlier = Window.partitionBy(*by).orderBy(*order)
    added = {}
    for name in measures:
        before = F.lag(name).over(earlier)
        added[f"previous_{name}"] = before
        added[f"change_{name}"] = F.round(F.col(name) - before, 2)
    return periods.withColumns(added)


def count_by(df: DataFrame, *keys: str, alias: str = "total") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(alias))


def total_count(df: DataFrame, alias: str = "total") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(alias))


def key_uniqueness(df: DataFrame, key: str = "id") -> DataFrame:
    """Non-null and distinct count of a key; equal numbers mean it is unique."""
    return df.agg(F.count(key).alias("total"), F.count_distinct(key).alias("distinct_total"))


def reject_report(rejects: DataFrame, stamp: str = "reject_timestamp") -> DataFrame:
    """Rejects by reason and day, newest day first."""
    return (rejects.groupBy("reject_reason", F.to_date(stamp).alias("dt"))
            .agg(F.count(F.lit(1)).alias("total"))
            .orderBy(F.col("dt").desc(), "reject_reason"))


def duplicated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return count_by(df, *keys).filter("total > 1")


def newest_first(df: DataFrame, stamp: str, *tie_break: str) -> DataFrame:
    """Global descending order.

    Name further columns in ``tie_break``: they let the range exchange split a stamp that a
    large share of the rows has in common.
    """
    return df.orderBy(F.col(stamp).desc(), *tie_break)
