"""Silver to features: enrich activities with their details and classify them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import transforms as T
from ..operators.filters import matched, value_range, value_set
from ..operators.joins import details_of, with_details
from ..operators.merge import merge_groups, merge_upsert
from ..operators.tables import BatchId, held, snapshot
from ..schemas import FEATURE_PARTITIONS, FEATURES
from ..streaming.runs import RunLog, batch_stream, finish
from .silver import MONTH

MERGE_KEYS = ("athlete_id", "start_date", "id_sub_activity")
WATERMARK = ("silver_ingestion_timestamp", "7 days")
_FROM_DETAIL = ("calories", "id_sub_activity")
_DERIVED = ("periodo_dia", "semana", "ano", "mes_ref", "intensidade_calorica", "duracao_tipo")


# What an activity gives to its feature row, apart from the keys of its detail.
_FROM_ACTIVITY = tuple(c for c in FEATURES.names if c not in (*_FROM_DETAIL, *_DERIVED))


def build_features(joined: DataFrame, pace_clock_col: str = "pace_clock", wall_time: bool = False) -> DataFrame:
    """The 24 feature columns of a join whose sides are qualified ``a`` and ``b``."""
    plain = [pace_clock_col if c == "pace_clock" else c for c in FEATURES.names if c not in _DERIVED]
    base = joined.select(*[F.col(f"{'b' if c in _FROM_DETAIL else 'a'}.{c}").alias(c) for c in plain])
    return (base
            .transform(T.add_periodo_dia, wall_time=wall_time)
            .transform(T.add_semana_ano_mes, wall_time=wall_time)
            .transform(T.add_intensidade_calorica)
            .transform(T.add_duracao_tipo))


def features(activities: DataFrame, details: DataFrame, **options) -> DataFrame:
    """Enriched and classified activities; of the details only what the join needs is read."""
    needed = [c for c in ("id", "athlete_id", "calories", "ingestion_timestamp") if c in details.columns]
    return build_features(with_details(activities, details.select(*needed)), **options)


def activity_columns(activities: DataFrame) -> DataFrame:
    """The columns of activities that :func:`features` reads.

    A micro-batch is read as its stream names it, and a staged table is written whole: neither
    is cut to the columns that a later step takes, so streams and staged rows are cut by this.
    """
    return activities.select(*dict.fromkeys(["id", *_FROM_ACTIVITY]))


class FeatureLoad:
    """Incremental feature table: new silver activities, enriched from the details at hand."""

    def __init__(self, target: str, catalog_table: str | None = None):
        self.target, self.catalog_table = target, catalog_table
        self.counts: dict[BatchId, int] = {}

    def run_batch(self, batch: DataFrame, batch_id: BatchId) -> None:
        """Merge one batch of feature rows."""
        with held(batch, "features") as rows:
            self.counts[batch_id] = rows.count()
            if self.counts[batch_id]:
                merge_upsert(rows, self.target, MERGE_KEYS, FEATURE_PARTITIONS, batch_id,
                             order_cols=("start_date_local",), prune_by="start_date",
                             catalog_table=self.catalog_table)

    def run_stream(self, activities: DataFrame, details: DataFrame, checkpoint: str) -> RunLog:
        """``activities`` streams, ``details`` is the table each micro-batch joins.

        The join is made batch by batch: details are cut to the batch's activities before the
        latest of each is chosen, so a batch ranks its own details and not all history.
        """
        def enrich(batch: DataFrame, batch_id: BatchId) -> None:
            with held(batch, "activities") as rows:
                self.run_batch(features(rows, details_of(rows, details)), batch_id)

        marked = activities.withWatermark(*WATERMARK)
        return finish(batch_stream(activity_columns(marked), enrich, checkpoint, "features"), self.counts)


class FeatureDays:
    """Feature table that equals the full rebuild, in whatever order activities and details arrive.

    A stream of activities and a stream of details drive it, one run after the other.  Each
    batch names the athlete-days it touches; these are computed anew from the two tables as
    they are by then and replaced whole, so neither order nor repetition matters, and a
    later version of a detail counts too.  ``activities`` and ``details`` open the tables that
    the streams read; they are called for every batch.

    An activity that a correction moves to another day leaves a row on its old day until that
    day is touched: pass such days to :meth:`refresh`.
    """

    days = ("athlete_id", "start_date")

    def __init__(self, target: str, activities: Callable[[], DataFrame], details: Callable[[], DataFrame],
                 catalog_table: str | None = None):
        self.target, self.activities, self.details = target, activities, details
        self.catalog_table = catalog_table
        self.counts: dict[BatchId, int] = {}

    def refresh(self, days: DataFrame, batch_id: BatchId) -> None:
        """Replace the feature rows of the given athletes and days."""
        with held(days.select(*self.days).distinct(), "days") as touched:
            near = self.activities().filter(value_range(touched, "start_date"))
            if dict(near.dtypes).get(MONTH) == "string":  # silver's layout: read the days' months only
                near = near.filter(value_set(touched.select(F.date_format("start_date", "yyyy-MM").alias(MONTH)), MONTH))
            with held(activity_columns(matched(near, touched, self.days, null_safe=True)), "activities") as rows:
                known = details_of(rows, self.details().filter(value_range(rows, "id")))
                merge_groups(features(rows, known), self.target, self.days, FEATURE_PARTITIONS, batch_id,
                             schema=FEATURES, prune_by="start_date", catalog_table=self.catalog_table, groups=touched)
                self.counts[batch_id] = rows.count()

    def run_activities(self, batch: DataFrame, batch_id: BatchId) -> None:
        self.refresh(batch, batch_id)

    def run_details(self, batch: DataFrame, batch_id: BatchId) -> None:
        """The days of a batch of details: of the activities, keys and days near its ids are read."""
        with held(batch.select("id", "athlete_id").distinct(), "details") as keys:
            near = self.activities().select("id", *self.days).filter(value_range(keys, "id"))
            self.refresh(matched(near, keys, ["id", "athlete_id"], null_safe=False), batch_id)

    def run_streams(self, activities: DataFrame, details: DataFrame, checkpoint: str) -> RunLog:
        """Drain both streams; each has its checkpoint below ``checkpoint``."""
        log = RunLog()
        for name, stream, each in (("activities", activities.select(*self.days), self.run_activities),
                                   ("details", details.select("id", "athlete_id"), self.run_details)):
            log += finish(batch_stream(stream, each, f"{checkpoint}/{name}", f"feature_{name}"), self.counts)
        return log


def late_groups(table: DataFrame, activities: DataFrame, details: DataFrame) -> DataFrame:
    """Feature rows, computed anew, of each athlete and day whose missing detail has since arrived."""
    days = ("athlete_id", "start_date")
    waiting = table.filter(F.col("id_sub_activity").isNull()).select(*days).distinct()
    arrived = (activities.join(details.select("id", "athlete_id"), ["id", "athlete_id"], "left_semi")
               .select("id", *days))
    known = table.select(F.col("id_sub_activity").alias("id"), *days)
    news = arrived.join(known, ["id", *days], "left_anti").select(*days).distinct().join(waiting, [*days], "left_semi")
    return features(activities.join(news, [*days], "left_semi"), details)


def refresh_late_details(target: str, activities: DataFrame, details: DataFrame, batch_id: BatchId) -> int:
    """Maintenance job: bring details that came after their activity into the feature table.

    The affected athlete-days are recomputed from silver and replaced whole, so no row is
    matched by guess.  Use batch ids apart from the stream's.
    """
    spark = activities.sparkSession
    table = snapshot(spark, target, FEATURES)
    with held(late_groups(table, activities, details), "late-details") as rows:
        if rows.isEmpty():
            return 0
        return merge_groups(rows, target, ("athlete_id", "start_date"), FEATURE_PARTITIONS, batch_id,
                            prune_by="start_date")
