"""Filters and joins by the keys of a batch, as the merges use them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_match(left: str, right: str, keys: Sequence[str], null_safe: bool) -> Column:
    pairs = [(F.col(f"{left}.{k}"), F.col(f"{right}.{k}")) for k in keys]
    return reduce(and_, [a.eqNullSafe(b) if null_safe else a == b for a, b in pairs])


def value_range(df: DataFrame, column: str) -> Column:
    """Filter that keeps the range of ``column`` seen in ``df`` (one small aggregate)."""
    seen = df.agg(F.min(column).alias("low"), F.max(column).alias("high"),
                  (F.count(F.lit(1)) > F.count(column)).alias("has_null")).first()
    if seen["low"] is None:
        return F.col(column).isNull() if seen["has_null"] else F.lit(False)
    within = F.col(column).between(F.lit(seen["low"]), F.lit(seen["high"]))
    return within | F.col(column).isNull() if seen["has_null"] else within


def value_set(df: DataFrame, column: str) -> Column:
    """Filter that keeps the values of ``column`` seen in ``df``.

    For columns with few values, such as months: they come to the driver, and the filter
    prunes partitions.
    """
    seen = [r[0] for r in df.select(column).distinct().collect()]
    within = F.col(column).isin([v for v in seen if v is not None])
    return within | F.col(column).isNull() if None in seen else within


def matched(target: DataFrame, source: DataFrame, keys: Sequence[str], null_safe: bool) -> DataFrame:
    """Target rows whose keys the source has."""
    wanted = source.select(*keys).distinct()
    return target.alias("t").join(wanted.alias("w"), key_match("t", "w", keys, null_safe), "left_semi")


def unmatched(source: DataFrame, target: DataFrame, keys: Sequence[str], null_safe: bool = True) -> DataFrame:
    """Source rows whose keys the target lacks.

    The target's share is cut to distinct, actually occurring keys before the anti-join:
    a key repeated in a third of the target arrives there once.
    """
    present = matched(target.select(*keys), source, keys, null_safe).distinct()
    return source.alias("s").join(present.alias("p"), key_match("s", "p", keys, null_safe), "left_anti")


def in_folders(slots: Sequence[str], folders: list[tuple]) -> Column:
    """Filter on partition columns only, as one set lookup, so pruning happens before the scan."""
    absent, between = "\u0001", "\u0002"
    label = F.concat_ws(between, *[F.coalesce(F.col(c).cast("string"), F.lit(absent)) for c in slots])
    return label.isin([between.join(absent if v is None else str(v) for v in row) for row in folders])
