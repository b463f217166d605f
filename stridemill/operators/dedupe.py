"""One row per key: latest, first and best records.

``row_number() = 1`` is pruned by Spark inside every map task before the exchange
(``WindowGroupLimit``), so a key that holds a third of all rows ships one row per task
instead of the whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, MapType, StructType, ArrayType, VariantType


def _orderable(kind: DataType) -> bool:
    if isinstance(kind, (MapType, VariantType)):
        return False
    if isinstance(kind, ArrayType):
        return _orderable(kind.elementType)
    if isinstance(kind, StructType):
        return all(_orderable(f.dataType) for f in kind.fields)
    return True


def dedupe_microbatch(df: DataFrame, business_keys: Sequence[str], order_cols: Sequence[str]) -> DataFrame:
    """Latest row per business key, by all ``order_cols`` descending.

    Every other comparable column follows in the order, so that ties have one outcome.
    """
    leading = [*business_keys, *order_cols]
    rest = [f"`{f.name}`" for f in df.schema.fields if f.name not in leading and _orderable(f.dataType)]
    ranked = Window.partitionBy(*business_keys).orderBy(*[F.col(c).desc() for c in [*order_cols, *rest]])
    return df.withColumn("_rank", F.row_number().over(ranked)).filter("_rank = 1").drop("_rank")


def latest_ingested(df: DataFrame) -> DataFrame:
    """Batch form: latest ingestion of each ``(athlete_id, id, start_date)``."""
    return dedupe_microbatch(df, ["athlete_id", "id", "start_date"], ["ingestion_timestamp"])


def best_per_day(df: DataFrame, day_col: str = "activity_date", sport_col: str = "sport_type") -> DataFrame:
    """The activity with most calories, then achievements, then duration, of each day and sport."""
    return dedupe_microbatch(df, [day_col, sport_col], ["calories", "achievement_count", "elapsed_time"])


def last_value(df: DataFrame, key: str, value: str) -> DataFrame:
    """Greatest ``value`` per key, NULL only if a key has nothing else.

    Equals rank 1 of a descending window, as a hash aggregate that combines before the exchange.
    """
    return df.groupBy(key).agg(F.max(value).alias(value))


def first_value_nulls_first(value: str) -> Column:
    """Aggregate equal to rank 1 of an ascending window, where one NULL wins over everything."""
    return F.when(F.count(value) == F.count(F.lit(1)), F.min(value))


def earliest_value(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(first_value_nulls_first(value).alias(value))


def distinct_by_key(df: DataFrame, key: str, alias: str) -> DataFrame:
    """Distinct non-null values of one column under a new name."""
    return df.select(F.col(key).alias(alias)).filter(F.col(alias).isNotNull()).distinct()
