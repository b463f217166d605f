"""DataFrame-level forms of :mod:`stridemill.functions.columns`.

Each is a ``DataFrame -> DataFrame`` step with column-name parameters, made to be chained
with ``DataFrame.transform``; Catalyst collapses a chain of them into one projection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import columns as C


def add_start_date(df: DataFrame, src_col: str = "start_date", out_col: str = "start_date") -> DataFrame:
    return df.withColumn(out_col, C.iso_date(src_col))


def add_distance_km(df: DataFrame, distance_col: str = "distance", out_col: str = "distance_km",
                    decimals: int = 2) -> DataFrame:
    return df.withColumn(out_col, C.kilometres(distance_col, decimals))


def add_average_speed_kmh(df: DataFrame, avg_speed_col: str = "average_speed",
                          out_col: str = "average_speed_kmh", decimals: int = 2) -> DataFrame:
    return df.withColumn(out_col, C.km_per_hour(avg_speed_col, decimals))


def add_pace_min_km(df: DataFrame, elapsed_time_col: str = "elapsed_time", distance_col: str = "distance",
                    type_col: str = "type", out_col: str = "pace_min_km", decimals: int = 2,
                    only_for_run: bool = True, non_run_value: float | None = None) -> DataFrame:
    return df.withColumn(out_col, C.run_pace(elapsed_time_col, distance_col, type_col, decimals,
                                             only_for_run, non_run_value))


def add_pace_min_km_moving_time(df: DataFrame, moving_time_col: str = "moving_time",
                                distance_col: str = "distance", type_col: str = "type",
                                out_col: str = "pace_min_km_moving_time", decimals: int = 2,
                                only_for_run: bool = True, non_run_value: float | None = None) -> DataFrame:
    return add_pace_min_km(df, moving_time_col, distance_col, type_col, out_col, decimals,
                           only_for_run, non_run_value)


def add_tempo_real(df: DataFrame, seconds_col: str = "moving_time", out_col: str = "tempo_real") -> DataFrame:
    return df.withColumn(out_col, C.hours_minutes_seconds(seconds_col))


def add_pace_min_km_new(df: DataFrame, moving_time_col: str = "moving_time", distance_col: str = "distance",
                        out_col: str = "pace_min_km_new", decimals: int = 3,
                        without_distance: float | None = 0.0) -> DataFrame:
    return df.withColumn(out_col, C.moving_pace(moving_time_col, distance_col, decimals, without_distance))


def add_pace_clock(df: DataFrame, pace_min_col: str = "pace_min_km_new", out_col: str = "pace_clock",
                   carry: bool = True) -> DataFrame:
    return df.withColumn(out_col, C.pace_clock(pace_min_col, carry))


def add_dia_semana(df: DataFrame, date_col: str = "start_date", out_col: str = "dia_semana",
                   pattern: str = "E") -> DataFrame:
    return df.withColumn(out_col, C.weekday(date_col, pattern))


def add_periodo_dia(df: DataFrame, col_start_local: str = "start_date_local",
                    wall_time: bool = False) -> DataFrame:
    return df.withColumn("periodo_dia", C.day_period(C.local_timestamp(col_start_local, wall_time)))


def add_semana_ano_mes(df: DataFrame, col_start_local: str = "start_date_local",
                       wall_time: bool = False) -> DataFrame:
    moment = C.local_timestamp(col_start_local, wall_time)
    return df.withColumns({"semana": F.weekofyear(moment), "ano": F.year(moment),
                           "mes_ref": F.date_format(moment, "MMM/yyyy")})


def add_intensidade_calorica(df: DataFrame, col_calories: str = "calories",
                             null_is_light: bool = False) -> DataFrame:
    return df.withColumn("intensidade_calorica", C.calorie_class(col_calories, null_is_light))


def add_duracao_tipo(df: DataFrame, col_tempo_real: str = "tempo_real") -> DataFrame:
    return df.withColumn("duracao_tipo", C.duration_class(col_tempo_real))


def convert_to_unix(df: DataFrame, column_name: str, new_column_name: str | None = None) -> DataFrame:
    is_text = isinstance(df.schema[column_name].dataType, StringType)
    return df.withColumn(new_column_name or f"{column_name}_unix", C.epoch_seconds(column_name, is_text))


def add_activity_date(df: DataFrame, src_col: str = "start_date_local", out_col: str = "activity_date") -> DataFrame:
    return df.withColumn(out_col, F.to_date(C.local_timestamp(src_col)))


def add_ingestion_time(df: DataFrame, out_col: str = "ingestion_timestamp") -> DataFrame:
    return df.withColumn(out_col, F.current_timestamp())


def add_silver_ingestion_time(df: DataFrame) -> DataFrame:
    return add_ingestion_time(df, "silver_ingestion_timestamp")


def add_athlete_id(df: DataFrame, src_field: str = "athlete.id", out_col: str = "athlete_id") -> DataFrame:
    """Lift the owner id out of the nested profile."""
    return df.withColumn(out_col, F.col(src_field))
