import pytest
from pyspark.sql import functions as F

import scenario
from conftest import listed
from stridemill import fsio
from stridemill.operators import aggregates as A
from stridemill.operators import tables as B
from stridemill.schemas import BRONZE_ACTIVITY, FEATURE_PARTITIONS, FEATURES, struct
from stridemill.session import build_session, run_dir, shared_dir
from stridemill.sources import files


@pytest.fixture(scope="module")
def database(spark):
    folder = run_dir(spark, "db")
    spark.sql(f"CREATE DATABASE tables_db LOCATION '{folder}'")
    return "tables_db"


def test_typed_rows_keep_their_nesting(spark, database):
    B.append_rows(scenario.bronze(spark), f"{database}.bronze")
    B.append_rows(scenario.bronze(spark).limit(1), f"{database}.bronze")
    rows = spark.read.table(f"{database}.bronze")
    assert rows.schema["map"].dataType == BRONZE_ACTIVITY["map"].dataType
    assert rows.count() == 7
    assert rows.filter("id in (606062, 606063) or id is null").select(F.element_at("end_latlng", 1)).distinct().collect(
        ) == [(-23.66,)]


def test_snapshot_replacement(spark, database):
    root = run_dir(spark, "snapshots")
    name = f"{database}.silver"
    B.replace_snapshot(spark.range(3), root, "v1", name)
    B.replace_snapshot(spark.read.table(name).withColumn("extra", F.lit("x")), root, "v2", name)
    assert spark.read.table(name).columns == ["id", "extra"]
    assert spark.read.parquet(f"{root}/v1").count() == 3


def test_truncate_widen_drop(spark, database):
    name = f"{database}.widened"
    B.replace_managed(spark.range(3), name)
    B.add_columns(spark, name, silver_ingestion_timestamp="TIMESTAMP COMMENT 'when it came in'")
    assert spark.read.table(name).filter("silver_ingestion_timestamp is null").count() == 3
    B.truncate(spark, name)
    assert spark.read.table(name).isEmpty()
    B.drop(spark, name, f"{database}.never_there")
    assert not spark.catalog.tableExists(name)


def test_external_table_with_comment(spark, database):
    work = run_dir(spark, "external")
    B.append_batch(spark.range(4), f"{work}/t", 0)
    B.register_external(spark, f"{database}.external", f"{work}/t", comment="The owner's rows")
    B.recover_partitions(spark, f"{database}.external")
    assert files.read_table(spark, f"{database}.external").count() == 4
    described = {r[0]: r[1] for r in spark.sql(f"DESCRIBE EXTENDED {database}.external").collect()}
    assert described["Comment"] == "The owner's rows"


def test_partitioned_table(spark, database):
    work = run_dir(spark, "partitioned")
    B.create_partitioned(spark, f"{database}.features", FEATURES, FEATURE_PARTITIONS, f"{work}/f", {"made.for": "test"})
    rows = spark.createDataFrame([(1, 2024, "Jan/2024"), (2, 2025, "Jan/2025")], "athlete_id long, ano int, mes_ref string")
    padded = rows.select(*[F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name)
                           for f in FEATURES.fields])
    B.write_partitioned(padded, f"{work}/f", FEATURE_PARTITIONS)
    B.recover_partitions(spark, f"{database}.features")
    wanted = spark.read.table(f"{database}.features").filter("ano = 2025")
    assert wanted.select("athlete_id", "mes_ref").collect() == [(2, "Jan/2025")]
    assert "PartitionFilters: [isnotnull(ano" in wanted._jdf.queryExecution().executedPlan().toString()


def test_create_as_select_refuses_to_overwrite(spark, database):
    B.create_as_select(spark, f"{database}.chosen", spark.range(2))
    with pytest.raises(Exception, match="(?i)already exists"):
        B.create_as_select(spark, f"{database}.chosen", spark.range(2))


def test_compaction_keeps_rows_and_catalog_follows(spark, database):
    work, schema = run_dir(spark, "compact"), struct(id="long", late="string")
    for batch in range(4):
        rows = spark.range(batch * 10, batch * 10 + 10)
        B.append_batch(rows if batch < 2 else rows.withColumn("late", F.lit("x")), f"{work}/old", batch)
    B.register_external(spark, f"{database}.packed", f"{work}/old", comment="It's small")
    B.recover_partitions(spark, f"{database}.packed")
    B.compact(spark, f"{work}/old", schema, f"{work}/new", cluster_by=["id"], catalog_table=f"{database}.packed")
    assert listed(B.snapshot(spark, f"{work}/new", schema)) == listed(B.snapshot(spark, f"{work}/old", schema))
    assert all(len(fsio.data_files(spark, f"{work}/new/_batch_id={n}")) == (n == 3) for n in range(4))
    packed = spark.read.table(f"{database}.packed")
    assert (packed.count(), packed.filter("late = 'x'").count()) == (40, 20)
    assert spark.catalog.getTable(f"{database}.packed").description == "It's small"
    assert not any(B.append_batch(spark.range(1), f"{work}/new", n) for n in range(4))


def test_reset_checkpoints(spark):
    work = run_dir(spark, "reset")
    fsio.write_text(spark, f"{work}/checkpoint/offsets", "x")
    B.reset_checkpoints(spark, f"{work}/checkpoint", f"{work}/none")
    assert not fsio.exists(spark, f"{work}/checkpoint")


def test_small_texts_round_trip(spark):
    path = f"{run_dir(spark, 'text')}/note"
    for text in ("first", "zweite Fassung ü"):
        fsio.write_text(spark, path, text)
        assert fsio.read_text(spark, path) == text


def test_catalog_choice_and_csv_escapes(spark, database):
    B.replace_managed(spark.range(2), f"{database}.plain")
    try:
        assert files.read_table(spark, "plain", database=database).count() == 2
    finally:
        files.use(spark, database="default")
    path = f"{run_dir(spark, 'csv')}/c.csv"
    fsio.write_text(spark, path, 'a,b\n1,"x \\"y\\", z"\n')
    assert files.read_csv(spark, path, struct(a="long", b="string")).collect() == [(1, 'x "y", z')]


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert build_session() is not None


def weekly(spark, *rows):
    return spark.createDataFrame(rows, "sport_type string, start_date string, distance_km double,"
                                       " total_elevation_gain double, pace_min_km double, average_speed_kmh double"
                                 ).withColumn("start_date", F.to_date("start_date"))


def test_weekly_summary_and_year_edges(spark):
    runs = weekly(spark, ("Run", "2025-12-29", 10.0, 5.0, 5.0, 12.0), ("Run", "2025-01-01", 5.01, None, 6.01, 10.0),
                  ("Ride", "2025-01-01", 50.0, 5.0, 0.0, 30.0), ("Run", None, None, None, None, None))
    assert listed(A.weekly_summary(runs)) == [
        (2025, 1, 2, 15.01, 5.0, 5.51, 11.0), (None, None, 1, None, None, None, None)]
    assert listed(A.weekly_summary(runs, iso_year=True).select("year", "week")) == [(2025, 1), (2026, 1), (None, None)]


def test_exact_sum_does_not_depend_on_order(spark):
    df = spark.range(0, 20000, 1, 9).select((F.col("id") * 0.01 % 7.13).alias("x")).select(F.round("x", 2).alias("x"))
    sums = {df.repartition(n).agg(A.exact_sum("x")).first()[0] for n in (1, 3, 8)}
    assert len(sums) == 1


def test_period_over_period_and_monthly(spark):
    runs = weekly(spark, ("Run", "2025-01-03", 10.0, 50.0, 5.0, 12.0), ("Run", "2025-02-03", 4.0, 10.0, 5.0, 12.0),
                  ("Yoga", "2025-02-03", 0.0, 0.0, None, None))
    months = A.monthly_distribution(runs)
    assert listed(months.select("sport_type", "total_distance_km", "elevation_gain_per_km")) == [
        ("Run", 10.0, 5.0), ("Run", 4.0, 2.5), ("Yoga", 0.0, None)]
    compared = A.period_over_period(months.filter("sport_type = 'Run'"), ["month"], ["total_distance_km"])
    assert listed(compared.select("previous_total_distance_km", "change_total_distance_km")) == [
        (10.0, -6.0), (None, None)]
    assert A.elevation_per_km(runs).select("elevation_gain_per_km").collect() == [(5.0,), (2.5,), (None,)]


def test_shuffle_settings_follow_the_size():
    from stridemill.session import shuffle_settings
    assert shuffle_settings(None) == {}
    for size, parts in ((1e9, "200"), (100e12, str(-(-int(100e12) // (256 * 1024 ** 2))))):
        found = shuffle_settings(size)
        assert found["spark.sql.shuffle.partitions"] == parts
        assert found["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] == parts
        assert found["spark.sql.adaptive.advisoryPartitionSizeInBytes"] == str(256 * 1024 ** 2)


def test_reports_come_in_order(spark):
    rejects = spark.createDataFrame([("b", "2025-01-02"), ("a", "2025-01-02"), ("a", "2025-01-03"), ("a", "2025-01-03")],
                                    "reject_reason string, reject_timestamp string")
    assert A.reject_report(rejects).select("reject_reason", F.col("dt").cast("string"), "total").collect() == [
        ("a", "2025-01-03", 2), ("a", "2025-01-02", 1), ("b", "2025-01-02", 1)]
    stamps = spark.createDataFrame([(1, 5), (2, 9), (3, 9), (4, None)], "id long, t long")
    assert [r.id for r in A.newest_first(stamps, "t", "id").collect()] == [2, 3, 1, 4]


def test_ordered_queries_keep_their_order(spark):
    from stridemill.suite import registry
    queries, folder = registry.queries(), "/root/testdata/sf0.001"
    rows = queries["o1_newest_first"](spark, folder).collect()
    assert len(rows) > 1
    top = [r.o_totalprice for r in queries["s8_catalog_top_n"](spark, folder).collect()]
    assert top == sorted(top, reverse=True)
    final = [(r.sport_type, r.id) for r in queries["k9_create_as_select"](spark, folder).collect()]
    assert len(final) > 1


def test_snapshot_with_new_columns_is_never_absent(spark, database, monkeypatch):
    root, name = run_dir(spark, "moved"), f"{database}.moved"
    B.replace_snapshot(spark.range(3), root, "v1", name)
    seen, real = [], type(spark).sql

    def watched(session, text, *args, **kwargs):
        out = real(session, text, *args, **kwargs)
        seen.append(spark.catalog.tableExists(name))
        return out
    with monkeypatch.context() as patch:
        patch.setattr(type(spark), "sql", watched)
        B.replace_snapshot(spark.range(5).withColumn("extra", F.lit("x")), root, "v2", name)
    assert seen and all(seen) and spark.read.table(name).filter("extra = 'x'").count() == 5
    B.replace_snapshot(spark.range(2).select(F.col("id").cast("string")), root, "v3", name)
    assert spark.read.table(name).schema["id"].dataType.simpleString() == "string"


def test_clean_up_removes_the_applications_folders_and_databases(spark, monkeypatch):
    from stridemill import session
    monkeypatch.setattr(session, "_application_dir", lambda s: f"{shared_dir(s)}/stridemill/other-app")
    folder = run_dir(spark, "gone")
    spark.sql(f"CREATE DATABASE gone_db LOCATION '{folder}'")
    B.replace_managed(spark.range(2), "gone_db.t")
    session.clean_up(spark)
    assert not fsio.exists(spark, folder) and not spark.catalog.databaseExists("gone_db")
    assert spark.catalog.databaseExists("default")
