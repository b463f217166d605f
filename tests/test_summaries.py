import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import listed
from stridemill.operators import aggregates as A
from stridemill.operators import tables as B
from stridemill.operators.merge import changed_values, merge_newest
from stridemill.plans.features import FeatureDays, features
from stridemill.plans.silver import MONTH
from stridemill.plans.summaries import ISO_WEEKLY, MONTHLY, WEEKLY, SummaryTable
from stridemill.schemas import FEATURES
from stridemill.session import run_dir
from stridemill.suite.table_queries import scratch_database

SILVER = ("athlete_id long, id long, sport_type string, start_date date, distance_km double,"
          " total_elevation_gain double, pace_min_km double, average_speed_kmh double, ingestion_timestamp timestamp")
KEYS = ["athlete_id", "id"]


def deliveries(seed, count, days):
    draw = random.Random(seed)
    return [(draw.choice([1, 2]), draw.randrange(12), draw.choice(["Run", "Run", "Ride", None]),
             draw.choice([None, *days]), draw.randrange(2000) / 100, float(draw.randrange(300)),
             draw.choice([None, 4.25, 5.5]), 10.0, datetime(2025, 1, 1) + timedelta(seconds=n))
            for n in range(count)]


def summarized(spark, summary, batches):
    """Silver merged batch by batch, each followed at once; a batch may come again."""
    database, work = scratch_database(spark, "followed"), run_dir(spark, "followed_data")
    kept = SummaryTable(f"{database}.silver", f"{work}/silver", f"{work}/summary", f"{database}.summary", summary)
    for number, rows in batches:
        batch = spark.createDataFrame(rows, SILVER).withColumn(MONTH, F.date_format("start_date", "yyyy-MM"))
        merge_newest(batch, f"{work}/silver", KEYS, [MONTH], number, newest_by="ingestion_timestamp",
                     catalog_table=f"{database}.silver", places=f"{work}/places")
        kept.follow(spark, number)
    return spark.read.table(f"{database}.silver"), spark.read.table(f"{database}.summary").drop(B.BATCH_COLUMN), kept


# days around New Year, where calendar year and week part, and two months further on
DAYS = [date(2023, 12, 30) + timedelta(days=n) for n in range(12)] + [date(2024, 12, 29), date(2024, 12, 31), date(2025, 3, 3)]


@pytest.mark.parametrize("name, summary, full", [
    ("weekly", WEEKLY, A.weekly_summary), ("monthly", MONTHLY, A.monthly_distribution),
    ("iso", ISO_WEEKLY, lambda rows: A.weekly_summary(rows, iso_year=True))])
def test_followed_summary_equals_the_full_one(spark, name, summary, full):
    rows = deliveries(name, 40, DAYS)
    batches = [(2, rows[20:30]), (0, rows[:10]), (0, rows[:10]), (1, rows[10:20]), (3, rows[30:])]
    table, kept, _ = summarized(spark, summary, batches)
    assert listed(kept.select(*full(table).columns)) == listed(full(table))


def test_period_that_loses_its_last_activity_goes(spark):
    first = (1, 1, "Run", date(2024, 1, 31), 5.0, 10.0, 5.0, 10.0, datetime(2025, 1, 1))
    moved = (1, 1, "Run", date(2024, 5, 2), 5.0, 10.0, 5.0, 10.0, datetime(2025, 1, 2))
    _, kept, _ = summarized(spark, MONTHLY, [(0, [first]), (1, [moved])])
    assert listed(kept.select("month", "total_activities")) == [(date(2024, 5, 1), 1)]


def test_batch_without_news_and_later_start(spark):
    rows = deliveries(5, 20, DAYS)
    table, kept, follower = summarized(spark, WEEKLY, [(0, rows), ("again-0", [])])
    assert changed_values(spark, follower.silver_folder, "again-0", MONTH) == set()
    late = SummaryTable(follower.silver_table, follower.silver_folder, f"{follower.target}-late",
                        f"{follower.catalog_table}_late", WEEKLY)
    late.start(spark, "start")
    assert listed(spark.read.table(late.catalog_table).drop(B.BATCH_COLUMN)) == listed(kept)


def test_only_months_of_touched_periods_are_read(spark, monkeypatch):
    days = [date(2024, m, 15) for m in range(1, 13)]
    rows = [(1, n, "Run", day, 5.0, 10.0, 5.0, 10.0, datetime(2025, 1, 1)) for n, day in enumerate(days)]
    _, _, follower = summarized(spark, MONTHLY, [(0, rows)])
    seen = []
    monkeypatch.setattr(follower, "summary", type(MONTHLY)(
        lambda df: seen.append(df.select(MONTH).distinct().collect()) or MONTHLY.compute(df), MONTHLY.period))
    follower.refresh(spark, ["2024-07"], "one")
    assert seen == [[("2024-07",)]]


def plain_silver(spark, rows):
    names = {f.name: f.dataType.simpleString() for f in FEATURES.fields
             if f.name not in ("calories", "id_sub_activity", "periodo_dia", "semana", "ano", "mes_ref",
                               "intensidade_calorica", "duracao_tipo")}
    base = spark.createDataFrame(rows, "id long, athlete_id long, start_date date")
    return base.select("id", *[F.col(n) if n in base.columns else
                               (F.concat(F.coalesce(F.col("start_date").cast("string"), F.lit("2024-01-01")), F.lit("T10:00:00Z"))
                                if n == "start_date_local" else F.lit("00:40:00") if n == "tempo_real" else
                                F.col("id").cast(kind) if n == "achievement_count" else F.lit(None).cast(kind)).alias(n)
                               for n, kind in names.items()])


@pytest.mark.parametrize("seed", [1, 2])
def test_features_equal_the_rebuild_in_any_order(spark, seed):
    draw = random.Random(seed)
    work = run_dir(spark, "any-order")
    days = [date(2024, 1, 30), date(2024, 1, 31), date(2024, 2, 1), None]
    acts = [(n, draw.choice([1, 2]), draw.choice(days)) for n in range(16)] + [(None, 1, days[0])]
    owner = {n: a for n, a, _ in acts}
    found = [(n, owner[n], float(draw.randrange(900)), datetime(2024, 3, 1) + timedelta(days=v))
             for n in draw.sample(range(16), 10) for v in range(draw.choice([1, 1, 2]))] + [(99, 1, 5.0, None)]
    draw.shuffle(acts), draw.shuffle(found)
    silver = plain_silver(spark, acts)
    shape = "id long, athlete_id long, calories double, ingestion_timestamp timestamp"
    stored = spark.createDataFrame(found, shape)

    def opened(name, like):
        return lambda: B.snapshot(spark, f"{work}/{name}", like.schema)

    load = FeatureDays(f"{work}/features", opened("activities", silver), opened("details", stored))
    steps = [("activities", k, plain_silver(spark, acts[k::2])) for k in (0, 1)]
    steps += [("details", k, spark.createDataFrame(found[k::2], shape)) for k in (0, 1)]
    draw.shuffle(steps)
    logged = 0
    for name, number, rows in steps:
        B.append_batch(rows, f"{work}/{name}", number)
        streams = [B.stream_batches(spark, f"{work}/{n}", like.schema) if B.read_batches(
            spark, f"{work}/{n}", like.schema).count() else None for n, like in (("activities", silver), ("details", stored))]
        if None not in streams:
            logged += len(load.run_streams(*streams, f"{work}/checkpoint"))
    assert logged >= 3
    expected = features(silver, stored).select(*FEATURES.names)
    assert listed(B.snapshot(spark, f"{work}/features", FEATURES)) == listed(expected)
    load.run_details(stored, "again-0")  # a repeat changes nothing
    assert listed(B.snapshot(spark, f"{work}/features", FEATURES)) == listed(expected)
