"""The supplied tables seen as activities.

``events`` stands in for the landed documents: every event is one activity, and events of a
high value were delivered twice, the second time a day later and with a corrected distance.
The column texts below are valid both in Spark SQL and in the checking engine's SQL, so
the two sides start from the same rows; everything after the mapping is written twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DateType, TimestampNTZType, TimestampType

REDELIVERED = "value >= 25"
HAS_DETAIL = "value >= 10"

# (column, expression); ids, owners, dates and measures include missing and broken ones
COLUMNS = [
    ("id", "case when event_id % 151 = 0 then null else event_id end"),
    ("athlete_id", "case when event_id % 157 = 0 then null else user_id end"),
    ("achievement_count", "event_id % 4"),
    ("athlete_count", "1 + event_id % 3"),
    ("average_cadence", "cast(70 + event_id % 30 as double)"),
    ("average_heartrate", "cast(case when event_id % 2 = 0 then 90 + event_id % 70 end as double)"),
    ("average_speed", "cast(case when event_id % 89 = 0 then -150 else (event_id * 31) % 1100 end as double) / 100"),
    ("calories", "cast(case when event_id % 13 = 0 then null when event_id % 101 = 0 then -5"
                 " else (event_id * 17) % 900 end as double)"),
    ("distance", "cast(case when event_id % 41 = 0 then null when event_id % 50 = 0 then 0"
                 " when event_id % 97 = 0 then -20 else (event_id * 7919) % 20000 + 500 end"
                 " + 100 * redelivery as double)"),
    ("elapsed_time", "(event_id * 104729) % 14400 + 60 + event_id % 300"),
    ("elev_high", "cast(event_id % 900 as double)"),
    ("elev_low", "cast(event_id % 400 as double)"),
    ("flagged", "event_id % 500 = 0"),
    ("has_heartrate", "event_id % 2 = 0"),
    ("location_city", "concat('City ', cast(user_id % 20 as varchar(9)))"),
    ("location_country", "case when user_id % 3 = 0 then 'Brazil' else 'Portugal' end"),
    ("location_state", "case when user_id % 2 = 0 then 'SP' end"),
    ("manual", "event_id % 20 = 0"),
    ("max_heartrate", "cast(case when event_id % 2 = 0 then 110 + event_id % 70 end as double)"),
    ("max_speed", "cast((event_id * 37) % 1500 as double) / 100"),
    ("moving_time", "case when event_id % 211 = 0 then null else (event_id * 104729) % 14400 + 60 end"),
    ("name", "concat('Session ', cast(event_id % 50 as varchar(9)))"),
    ("pr_count", "event_id % 3"),
    ("sport_type", "case event_type when 'purchase' then 'Run' when 'view' then 'Ride' when 'click' then 'Walk'"
                   " when 'signup' then 'Yoga' else '' end"),
    ("timezone", "'(GMT-03:00) America/Sao_Paulo'"),
    ("total_elevation_gain", "cast((event_id * 13) % 500 as double)"),
    ("type", "case event_type when 'purchase' then 'Run' when 'view' then 'Ride' when 'click' then 'Walk'"
             " when 'signup' then 'Yoga' else '' end"),
    ("workout_type", "case when event_id % 5 = 0 then null else event_id % 4 end"),
]
SPARK_ONLY = [
    ("start_date", "case when event_id % 113 = 0 then 'n/a'"
                   " else date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") end"),
    ("start_date_local", "date_format(ts - interval 3 hours, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"),
    ("ingestion_timestamp", "cast(case when redelivery = 1 then ts + interval 1 day else ts end as timestamp)"),
]
CHECK_ONLY = [
    ("start_date", "case when event_id % 113 = 0 then 'n/a' else strftime(ts, '%Y-%m-%dT%H:%M:%SZ') end"),
    ("start_date_local", "strftime(ts - interval 3 hours, '%Y-%m-%dT%H:%M:%SZ')"),
    ("ingestion_timestamp", "case when redelivery = 1 then ts + interval 1 day else ts end"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    copies = F.when(F.expr(REDELIVERED), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return table(spark, sf_dir, "events").withColumn("redelivery", F.explode(copies))


def _mapped(delivered: DataFrame) -> DataFrame:
    return delivered.selectExpr(*[f"{text} AS {name}" for name, text in [*COLUMNS, *SPARK_ONLY]], "redelivery")


def bronze_activities(spark: SparkSession, sf_dir: str, redelivery: int | None = None) -> DataFrame:
    rows = _mapped(deliveries(spark, sf_dir))
    if redelivery is not None:
        rows = rows.filter(F.col("redelivery") == redelivery)
    return rows.drop("redelivery", "calories")


def bronze_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(deliveries(spark, sf_dir).filter(HAS_DETAIL)).drop("redelivery")


def activity_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed form: the owner is nested and nothing is stamped yet."""
    rows = bronze_activities(spark, sf_dir, redelivery=0)
    owner = F.struct(F.col("athlete_id").alias("id"), F.lit(1).cast("long").alias("resource_state"))
    return rows.withColumn("athlete", owner).drop("athlete_id", "ingestion_timestamp")


def plain(df: DataFrame) -> DataFrame:
    """Dates, timestamps and lists as text, so that results compare across engines."""
    def shown(field):
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, DateType):
            return column.cast("string").alias(field.name)
        if isinstance(field.dataType, (TimestampType, TimestampNTZType)):
            return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(field.name)
        if isinstance(field.dataType, ArrayType):
            return F.array_join(column.cast("array<string>"), "|").alias(field.name)
        return column
    return df.select(*[shown(f) for f in df.schema.fields])
