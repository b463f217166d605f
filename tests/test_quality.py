import scenario
from conftest import listed
from stridemill.operators import quality as Q
from stridemill.plans.silver import apply_all_silver_calcs
from stridemill.session import run_dir

SHAPE = ("id long, athlete_id long, start_date date, sport_type string, distance_km double, average_speed_kmh double,"
         " pace_min_km_new double, moving_time long, calories double")


def frame(spark, **values):
    base = {"id": 1, "athlete_id": 2, "start_date": "2025-01-01", "sport_type": "Ride", "distance_km": 1.0,
            "average_speed_kmh": 10.0, "pace_min_km_new": 6.0, "moving_time": 360, "calories": 10.0, **values}
    import datetime
    if base["start_date"]:
        base["start_date"] = datetime.date.fromisoformat(base["start_date"])
    return spark.createDataFrame([tuple(base.values())], SHAPE)


def reasons(spark, rules=Q.ACTIVITY_RULES, **values):
    return Q.annotate(frame(spark, **values), rules).first()["reject_reasons"]


def test_each_rule(either_ansi):
    s = either_ansi
    assert reasons(s) is None
    assert reasons(s, id=None) == ["missing_id"]
    assert reasons(s, start_date=None) == ["missing_start_date"]
    assert reasons(s, sport_type=None) == ["sport_type_missing"]
    assert reasons(s, sport_type="") == ["sport_type_missing"]
    assert reasons(s, distance_km=-0.5) == ["neg_distance"]
    assert reasons(s, sport_type="Run", distance_km=0.0) == ["zero_distance_run"]
    assert reasons(s, average_speed_kmh=-1.0) == ["speed_negative"]
    assert reasons(s, sport_type="Run", average_speed_kmh=30.01) == ["speed_implausible_run"]
    assert reasons(s, sport_type="Run", average_speed_kmh=30.0) is None
    assert reasons(s, average_speed_kmh=99.0) is None
    assert reasons(s, pace_min_km_new=-1.0) == ["pace_negative"]
    assert reasons(s, pace_min_km_new=None) == ["pace_null_when_should"]
    assert reasons(s, distance_km=None, average_speed_kmh=None, pace_min_km_new=None) is None


def test_all_reasons_in_rule_order(spark):
    row = Q.annotate(frame(spark, id=None, sport_type="", average_speed_kmh=-1.0), Q.ACTIVITY_RULES).first()
    assert row["reject_reasons"] == ["missing_id", "sport_type_missing", "speed_negative"]
    assert (row["reject_reason_count"], row["reject_reason"]) == (3, "missing_id|sport_type_missing|speed_negative")
    assert row["reject_timestamp"] is not None


def test_detail_rules(spark):
    assert reasons(spark, Q.DETAIL_RULES, athlete_id=None, calories=-1.0) == ["missing_start_date", "neg_calories"]
    assert reasons(spark, Q.DETAIL_RULES, calories=None) is None


def test_split_is_complete_and_retry_adds_nothing(spark):
    path = run_dir(spark, "rejects")
    derived = apply_all_silver_calcs(scenario.bronze(spark))
    for _ in range(2):
        outcome = Q.assert_quality(derived, Q.ACTIVITY_RULES, path, batch_id=4)
        assert (outcome.total, outcome.rejected) == (6, 3)
        assert outcome.valid.columns == derived.columns
        assert outcome.valid.count() + outcome.rejects.count() == outcome.total
        outcome.release()
    assert listed(spark.read.parquet(path).select("reject_reason")) == [
        ("missing_id",), ("zero_distance_run",), ("zero_distance_run",)]


def test_no_rejects_write_nothing(spark):
    from stridemill import fsio
    path = run_dir(spark, "rejects")
    Q.assert_quality(frame(spark), Q.ACTIVITY_RULES, path).release()
    assert not fsio.exists(spark, path)
