"""Every registered query against its SQL, and the shape of its plan."""

import glob
import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import rows_of
from stridemill.suite import batch_queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="supplied tables are not here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        connection.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    frame = queries()[name](spark, SF_DIR)
    found = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    cursor = duck.execute(oracle_sql()[name])
    expected = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    assert found == expected
    assert found[1] or name == "j4_orders_without_lines"


@pytest.mark.parametrize("name", sorted(batch_queries.QUERIES))
def test_plan_has_no_pairwise_join(spark, name):
    plan = queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scans_read_only_needed_columns_and_filter_early(spark):
    plan = queries()["s4_table_scan"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double>" in plan
    plan = queries()["p6_runs"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan


def test_entry(spark):
    assert entry(spark).columns == ["year", "week", "total_activities", "total_distance_km", "total_elevation_gain",
                                    "avg_pace_min_km", "avg_speed_kmh"]
