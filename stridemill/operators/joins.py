"""Join-shaped operators: enrichment, lookup and missing-detail search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from .dedupe import dedupe_microbatch


def with_details(activities: DataFrame, details: DataFrame, how: str = "left") -> DataFrame:
    """Activities with their detail row on ``(id, athlete_id)``, columns still qualified ``a`` and ``b``.

    An activity has one detail: the latest ingested, should several be stored.  So an id
    that many rows share on both sides cannot pair them all, and the feature merge, whose
    key holds the id, would keep one of the pairs anyway.

    Works for a streaming left side over a static right side.  No size is assumed for the
    details: Spark broadcasts them when measured small, else sort-merge joins on the
    partitioning the choice of the latest left behind, and splits a skewed partition of the
    activity side.
    """
    order = [c for c in ("ingestion_timestamp",) if c in details.columns]
    one_each = dedupe_microbatch(details, ["athlete_id", "id"], order)
    a, b = activities.alias("a"), one_each.withColumnRenamed("id", "id_sub_activity").alias("b")
    same = (F.col("a.id") == F.col("b.id_sub_activity")) & (F.col("a.athlete_id") == F.col("b.athlete_id"))
    return a.join(b, same, how)


def details_of(activities: DataFrame, details: DataFrame) -> DataFrame:
    """The details of the given activities, every stored version of them."""
    wanted = activities.select("id", "athlete_id").distinct()
    return details.join(wanted, ["id", "athlete_id"], "left_semi")


def missing_details(activities: DataFrame, details: DataFrame, key: str = "id") -> DataFrame:
    """Distinct activity keys without a detail row.

    Keys are made distinct first; that and the anti-join share one exchange, and a key that
    repeats without bound travels once per task.
    """
    known = details.select(key).distinct()
    return activities.select(key).distinct().join(known, key, "left_anti")


def join_control(last_activity: DataFrame, first_ingestion: DataFrame, key: str = "athlete_id") -> DataFrame:
    return last_activity.join(first_ingestion, key, "inner").withColumn("full_carga", F.lit(False))


def load_mode(athletes: DataFrame, control: DataFrame, athlete_col: str = "id") -> DataFrame:
    """Every athlete with its control row; one the control table does not know loads in full.

    Control grows with the number of athletes, so no broadcast is forced: Spark decides
    from its measured size.
    """
    owners = athletes.select(F.col(athlete_col).alias("athlete_id_json"))
    joined = owners.join(control, owners["athlete_id_json"] == control["athlete_id"], "left")
    return joined.withColumn("full_carga", F.coalesce("full_carga", F.lit(True)))


def calorie_report(activities: DataFrame, chosen: DataFrame, since: str | Column | None = None,
                   pace_clock_col: str = "pace_clock") -> DataFrame:
    """Activities joined with the chosen detail of their day, with the report's classes.

    Here, unlike in the feature table, unknown calories count as light.
    """
    a, b = activities.alias("a"), chosen.alias("b")
    if since is not None:
        a = activities.filter(F.col("start_date") >= (F.lit(since).cast("date") if isinstance(since, str)
                                                      else since)).alias("a")
    moment = C.local_timestamp("a.start_date_local")
    plain = ["achievement_count", "pr_count", "has_heartrate", "average_heartrate", "max_heartrate", "start_date",
             "start_date_local", "distance_km", "average_speed_kmh", "average_cadence", "total_elevation_gain",
             "tempo_real", pace_clock_col, "dia_semana"]
    return a.join(b, F.col("a.id") == F.col("b.id"), "inner").select(
        "a.athlete_id", "a.sport_type", "b.calories", *[f"a.{c}" for c in plain],
        C.day_period(moment).alias("periodo_dia"),
        F.weekofyear(moment).alias("semana"),
        F.year(moment).alias("ano"),
        C.calorie_class("b.calories", null_is_light=True).alias("intensidade_calorica"),
        C.duration_class("a.tempo_real").alias("duracao_tipo"),
        F.date_format(moment, "MMM/yyyy").alias("mes_ref"))
