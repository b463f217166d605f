"""Steps whose work per row must not grow with the shape of a row or of the batch."""

import pytest

from conftest import listed
from stridemill.operators.filters import unmatched
from stridemill.operators.tables import BATCH_COLUMN, read_batches
from stridemill.plans import features as plans
from stridemill.schemas import FEATURES
from stridemill.session import run_dir
from stridemill.sources.evolution import conform, parse_lines

LAPS = "id long, laps array<struct<lap:long, km:double, at:struct<x:long, y:struct<z:long>>>>, at struct<x:struct<s:long>>, km double"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("fields", [LAPS, "id long, laps array<struct<lap:long, km:double, at:struct<x:long>>>",
                                    "id long, athlete struct<id:long>, event_type string, value double"])
def test_a_document_is_copied_once_to_find_what_is_left_over(spark, fields):
    schema = spark.createDataFrame([], fields).schema
    plan = optimized(conform(parse_lines(spark.createDataFrame([], "value string")), schema))
    assert plan.count("as map<string,variant>") == 1
    kept = next(line for line in plan.splitlines() if "map_filter" in line)
    assert "exists(" not in kept  # the check of arrays is done once, not for each field of the document


@pytest.mark.parametrize("line, rescued", [
    ('{"id":1,"laps":[{"lap":1,"at":{"x":1,"y":{"z":2}}}],"km":1.5}', None),
    ('{"id":1,"laps":null,"more":null}', None), ("{}", None),
    ('{"id":1,"laps":[{"at":{"y":{"z":2.5}}}]}', '{"laps":[{"at":{"y":{"z":2.5}}}]}'),
    ('{"id":1,"laps":[{"at":{"y":{"z":2,"w":1}}}],"more":1}', '{"laps":[{"at":{"y":{"w":1,"z":2}}}],"more":1}'),
    ('{"id":"00000000000000012","km":"00000000000000012"}', '{"km":"00000000000000012"}'),
    ('{"at":{"x":{"s":1},"t":null},"more":null}', '{"at":{"t":null,"x":{"s":1}}}'),
    ('{"at":{"x":5}}', '{"at":{"x":5}}'), ("[3]", "3"), ("{broken", "{broken"),
])
def test_what_is_left_over(spark, line, rescued):
    schema = spark.createDataFrame([], LAPS).schema
    rows = conform(parse_lines(spark.createDataFrame([(line,)], "value string")), schema)
    assert listed(rows.select("_rescued_data")) == [(rescued,)]

def test_feature_streams_read_only_what_features_need(spark, monkeypatch):
    empty = run_dir(spark, "empty")
    spark.range(0).write.parquet(empty)
    activities = spark.readStream.schema(
        "id long, notes string, silver_ingestion_timestamp timestamp, " + ", ".join(
            f"{c} {FEATURES[c].dataType.simpleString()}" for c in FEATURES.names)).parquet(empty)
    details = spark.readStream.schema("id long, athlete_id long, laps string").parquet(empty)
    seen = {}
    monkeypatch.setattr(plans, "batch_stream", lambda stream, each, checkpoint, name: seen.update({name: stream.columns}))
    monkeypatch.setattr(plans, "finish", lambda query, written: [])
    plans.FeatureLoad("none").run_stream(activities, details, "none")
    plans.FeatureDays("none", None, None).run_streams(activities, details, "none")
    assert "notes" not in seen["features"] and {"id", "athlete_id", "start_date", "pace_clock"} <= set(seen["features"])
    assert seen["feature_activities"] == ["athlete_id", "start_date"] and seen["feature_details"] == ["id", "athlete_id"]


def test_a_first_batch_moves_nothing_to_join_an_empty_table(spark):
    rows = spark.range(10).selectExpr("id", "cast(id as string) AS name")
    known = read_batches(spark, run_dir(spark, "absent"), rows.schema).drop(BATCH_COLUMN)
    assert known.dtypes == rows.dtypes and known.count() == 0
    assert "Join" not in optimized(unmatched(rows, known, ["id"]))
