import random
from datetime import date, datetime

from pyspark.sql import functions as F

from conftest import listed
from stridemill import fsio
from stridemill.operators import joins as J
from stridemill.operators import tables as B
from stridemill.plans import control as K
from stridemill.session import run_dir
from stridemill.sources.files import read_control
from stridemill.suite.table_queries import scratch_database

SILVER = "athlete_id long, start_date date, ingestion_timestamp timestamp"


def silver(spark):
    return spark.createDataFrame([
        (1, date(2025, 1, 5), datetime(2025, 1, 6, 1)), (1, date(2025, 1, 9), datetime(2025, 1, 10, 1)),
        (2, date(2025, 2, 1), None), (2, None, datetime(2025, 2, 2)), (3, None, datetime(2025, 3, 1)),
        (None, date(2025, 1, 1), datetime(2025, 1, 1))], SILVER)


def test_control_table(spark):
    assert listed(K.control_table(silver(spark))) == [
        (1, date(2025, 1, 9), datetime(2025, 1, 6, 1), False, 1736380800, 1736125200),
        (2, date(2025, 2, 1), None, False, 1738368000, None),
        (3, None, datetime(2025, 3, 1), False, None, 1740787200)]


def test_one_exchange(spark):
    plan = K.control_table(silver(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan and "Join" not in plan


def test_publish_and_read_back(spark):
    work = run_dir(spark, "control")
    spark.sql(f"CREATE DATABASE control_db LOCATION '{work}/db'")
    for _ in range(2):
        K.publish_control(K.control_table(silver(spark)), f"{work}/control.csv", "control_db.control")
    assert not fsio.exists(spark, f"{work}/control.csv.staging")
    with open(f"{work}/control.csv", encoding="utf-8") as lines:
        head = lines.readline().strip()
    assert head == ("athlete_id,start_date,ingestion_timestamp,full_carga,start_date_unix,ingestion_timestamp_unix")
    back = read_control(spark, f"{work}/control.csv")
    assert listed(back.select("athlete_id", "start_date", "start_date_unix", "full_carga")) == [
        (1, date(2025, 1, 9), 1736380800, False), (2, date(2025, 2, 1), 1738368000, False), (3, None, None, False)]


def test_modes_and_incremental(spark):
    athletes = spark.createDataFrame([(1,), (3,), (4,)], "id long")
    control = K.control_table(silver(spark))
    full, incremental = K.split_by_mode(athletes, control)
    assert listed(full.select("athlete_id_json")) == [(4,)]
    assert listed(incremental.select("athlete_id_json")) == [(1,), (3,)]
    landed = spark.createDataFrame([
        (10, 1, datetime(2025, 1, 9)), (11, 1, datetime(2025, 1, 9, 0, 0, 1)), (12, 4, datetime(2020, 1, 1)),
        (13, 3, datetime(2020, 1, 1)), (14, 5, datetime(2025, 1, 1)), (15, None, datetime(2025, 1, 1))], "id long, athlete_id long, start_ts timestamp")
    taken = K.incremental_after(landed, J.load_mode(athletes.union(athletes), control))
    assert listed(taken.select("id")) == [(11,), (12,), (13,), (14,), (15,)]
    assert taken.columns == ["athlete_id", "id", "start_ts"]


def test_pending_ids(spark):
    activities = spark.createDataFrame([(1,), (1,), (2,), (None,)], "id long")
    details = spark.createDataFrame([(2,), (2,), (None,)], "id long")
    assert listed(K.pending_detail_ids(activities)) == [(1,), (2,)]
    assert listed(K.pending_detail_ids(activities, details)) == [(1,)]
    assert listed(J.missing_details(activities, details)) == [(1,), (None,)]


def test_export_is_one_file_for_many_partitions(spark):
    work = run_dir(spark, "csv")
    B.export_single_csv(spark.range(0, 100, 1, 8).withColumn("t", F.lit('a "quoted", text')), f"{work}/all.csv")
    with open(f"{work}/all.csv", encoding="utf-8") as lines:
        assert sum(1 for _ in lines) == 101


def test_control_state_equals_the_table_in_any_order_and_with_repeats(spark):
    draw = random.Random(4)
    shape = "athlete_id long, start_date date, ingestion_timestamp timestamp"
    moments = [datetime(2024, 1, d, 8) for d in range(1, 28)]
    rows = [(draw.choice([1, 2, 3, 4, 5, None]), draw.choice([None, *[m.date() for m in moments]]),
             draw.choice(moments) if draw.random() < 0.95 else None) for _ in range(80)]
    work = run_dir(spark, "control-state")
    state = K.ControlState(f"{work}/control", f"{scratch_database(spark, 'control_state')}.control")
    batches = [rows[k::4] for k in range(4)]
    for number in (3, 1, 1, 0, 2, 3):
        state.run_batch(spark.createDataFrame(batches[number], shape), number)
    assert listed(state.table(spark)) == listed(K.control_table(spark.createDataFrame(rows, shape)))
    # another stream that brings the same rows again
    state.run_batch(spark.createDataFrame(rows, shape), "other-0")
    assert listed(state.table(spark)) == listed(K.control_table(spark.createDataFrame(rows, shape)))
