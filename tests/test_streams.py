import json
import os

import pytest
from pyspark.sql import functions as F

import scenario
from conftest import listed
from stridemill import fsio
from stridemill.operators import filters
from stridemill.operators import merge as M
from stridemill.operators import tables as B
from stridemill.operators.joins import details_of
from stridemill.plans import silver as S
from stridemill.plans.features import FeatureLoad, features, late_groups, refresh_late_details
from stridemill.schemas import ACTIVITY_DOCUMENT, BRONZE_ACTIVITY, FEATURES, struct
from stridemill.session import run_dir
from stridemill.sources.bronze import BronzeLoader, archive_landing, load_bronze
from stridemill.sources.evolution import SchemaStore, observed_schema, parse_lines, widen
from stridemill.streaming.runs import append_stream, batch_stream, finish


def land(folder, name, *documents):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w", encoding="utf-8") as out:
        out.writelines(json.dumps(d) + "\n" for d in documents)


def test_bronze_load_is_incremental(spark):
    work = run_dir(spark, "bronze")
    loader = BronzeLoader(f"{work}/landing", f"{work}/checkpoint", "json", declared=ACTIVITY_DOCUMENT,
                          name_filter="*.json", spark=spark)

    def load():
        return loader.write_to_bronze(loader.standardize(loader.read_autoloader()), f"{work}/bronze")

    land(f"{work}/landing", "a.json", {"id": 1, "athlete": {"id": 9}, "laps": "unknown field"}, {"id": 2})
    land(f"{work}/landing", "skipped.txt", {"id": 99})
    first = load()
    assert (first.input_rows, first[0]["query"]) == (2, "bronze_loader")
    land(f"{work}/landing", "b.json", {"id": 3, "athlete": {"id": 8}})
    assert load().input_rows == 1
    assert load() == []
    rows = spark.read.parquet(f"{work}/bronze")
    assert listed(rows.select("id", "athlete_id")) == [(1, 9), (2, None), (3, 8)]
    assert rows.filter("ingestion_timestamp is null").isEmpty()


def test_owner_documents_keep_their_own_id_and_projection(spark):
    work = run_dir(spark, "owners")
    land(f"{work}/landing", "a.json", {"id": 1, "username": "x"})
    loader = BronzeLoader(f"{work}/landing", f"{work}/checkpoint", "json", spark=spark)
    stream = loader.read_autoloader(["id", "upper(username) AS username"])
    query = loader.write_to_bronze(loader.standardize(stream, owner_documents=True), f"{work}/bronze",
                                   await_termination=False)
    finish(query)
    assert spark.read.parquet(f"{work}/bronze").select("id", "username").collect() == [(1, "X")]
    assert SchemaStore(spark, loader.schema_path).load().names == ["id", "username"]


def test_evolving_intake(spark):
    work = run_dir(spark, "evolving")
    loader = BronzeLoader(f"{work}/landing", f"{work}/checkpoint", "json", spark=spark)
    land(f"{work}/landing", "a.json", {"id": 1, "athlete": {"id": 9}, "empty": [], "none": None, "pace": 5})
    loader.load_evolving(f"{work}/bronze")
    land(f"{work}/landing", "b.json", {"id": "bad", "athlete": {"id": 8, "team": "t"}, "note": "new", "pace": 5.5},
         {"id": 3, "athlete": {"id": 7}, "tags": [1.5, 2]})
    log = loader.load_evolving(f"{work}/bronze")
    assert (log.input_rows, log.output_rows) == (2, 2)
    assert loader.load_evolving(f"{work}/bronze") == []
    stored = SchemaStore(spark, loader.schema_path).load()
    assert set(stored.names) == {"athlete", "empty", "id", "pace", "note", "tags"}
    assert stored["athlete"].dataType.names == ["id", "team"]
    shape = struct(id="long", athlete_id="long", pace="long", note="string", _rescued_data="string")
    assert listed(B.snapshot(spark, f"{work}/bronze", shape)) == [
        (1, 9, 5, None, None), (3, 7, None, None, None), (None, 8, None, "new", '{"id":"bad","pace":5.5}')]


def test_broken_lines_and_arrays_are_kept(spark):
    work = run_dir(spark, "broken")
    loader = BronzeLoader(f"{work}/landing", f"{work}/checkpoint", "json", spark=spark)
    os.makedirs(f"{work}/landing")
    with open(f"{work}/landing/a.json", "w", encoding="utf-8") as out:
        out.write('{"id":1}\n{broken\n[{"id":2},{"id":3}]\n\n"text"\n{"it\'s":4,"b c":5}\n')
    loader.load_evolving(f"{work}/bronze")
    rows = spark.read.parquet(f"{work}/bronze")
    assert listed(rows.select("id", "`it's`", "b c", "_rescued_data")) == [
        (1, None, None, None), (2, None, None, None), (3, None, None, None), (None, 4, 5, None),
        (None, None, None, '"text"'), (None, None, None, "{broken")]


def test_whole_files_as_documents(spark):
    work = run_dir(spark, "pages")
    loader = BronzeLoader(f"{work}/landing", f"{work}/checkpoint", "json", options={"wholetext": "true"}, spark=spark)
    os.makedirs(f"{work}/landing")
    with open(f"{work}/landing/page.json", "w", encoding="utf-8") as out:
        json.dump([{"id": 1, "athlete": {"id": 9}}, {"id": 2, "athlete": {"id": 9}}], out, indent=2)
    loader.load_evolving(f"{work}/bronze")
    assert listed(spark.read.parquet(f"{work}/bronze").select("id", "athlete_id")) == [(1, 9), (2, 9)]


def test_landing_to_features(spark):
    """The whole flow: JSON landing, bronze, silver, features."""
    work = run_dir(spark, "flow")
    loader = BronzeLoader(f"{work}/landing", f"{work}/bronze_checkpoint", "json", declared=ACTIVITY_DOCUMENT,
                          spark=spark)
    scenario.bronze(spark).select(*ACTIVITY_DOCUMENT.names).write.json(f"{work}/landing")
    loader.write_to_bronze(loader.standardize(loader.read_autoloader()), f"{work}/bronze")
    bronze = spark.read.parquet(f"{work}/bronze").schema
    S.activity_load(f"{work}/silver", f"{work}/rejects").run_stream(
        B.stream_batches(spark, f"{work}/bronze", bronze), f"{work}/silver_checkpoint")
    silver = S.silver_schema(bronze, spark, S.apply_all_silver_calcs)
    FeatureLoad(f"{work}/features").run_stream(
        B.stream_batches(spark, f"{work}/silver", silver), details_for(spark, (606062, 155180511, 650.0)),
        f"{work}/feature_checkpoint")
    assert listed(B.snapshot(spark, f"{work}/features", FEATURES).select("id_sub_activity", "start_date_local")) == [
        (606062, "2025-10-23T09:32:00Z"), (None, "2024-12-28T13:59:37Z"), (None, "2025-10-23T09:32:00Z")]


def test_widen_keeps_stored_types():
    old = struct(a="long", s=struct(x="long"))
    assert widen(old, struct(b="string", a="double", s=struct(y="string", x="string"))) == struct(
        a="long", s=struct(x="long", y="string"), b="string")


def test_archive_moves_what_was_read(spark):
    work = run_dir(spark, "archive")
    loader = BronzeLoader(f"{work}/processing", f"{work}/checkpoint", "json", declared=struct(id="long"), spark=spark)

    def load():
        loader.write_to_bronze(loader.read_autoloader(), f"{work}/bronze")

    land(f"{work}/processing", "a b.json", {"id": 1})
    assert archive_landing(spark, f"{work}/processing", f"{work}/day=0", f"{work}/checkpoint") == 0
    load()
    land(f"{work}/processing", "late.json", {"id": 2})
    assert archive_landing(spark, f"{work}/processing", f"{work}/day=1", f"{work}/checkpoint") == 1
    assert sorted(os.listdir(f"{work}/processing"))[-1] == "late.json" and os.path.exists(f"{work}/day=1/a b.json")
    load()
    assert listed(spark.read.parquet(f"{work}/bronze").select("id")) == [(1,), (2,)]
    assert archive_landing(spark, f"{work}/processing", f"{work}/day=2", f"{work}/checkpoint") == 1


def test_source_can_archive_what_it_consumed(spark):
    work = run_dir(spark, "clean")
    loader = BronzeLoader(f"{work}/landing", f"{work}/checkpoint", "json", declared=struct(id="long"),
                          archive_path=f"{work}/archive", spark=spark)
    for name in ("a", "b", "c"):
        land(f"{work}/landing", f"{name}.json", {"id": 1})
        loader.write_to_bronze(loader.read_autoloader(), f"{work}/bronze")
    assert spark.read.parquet(f"{work}/bronze").count() == 3
    archived = [name for _, _, names in os.walk(f"{work}/archive") for name in names if name.endswith(".json")]
    assert "a.json" in archived


def silver_stream(spark, work, frames, load=None):
    load = load or S.activity_load(f"{work}/silver", f"{work}/rejects")
    logs = []
    for number, frame in frames:
        B.append_batch(frame, f"{work}/bronze", number)
        logs.append(load.run_stream(B.stream_batches(spark, f"{work}/bronze", frame.schema), f"{work}/checkpoint"))
    return load, logs


def silver_rows(spark, work):
    schema = S.silver_schema(BRONZE_ACTIVITY, spark, S.apply_all_silver_calcs)
    return B.snapshot(spark, f"{work}/silver", schema)


def test_silver_stream_on_scenario_rows(spark):
    work = run_dir(spark, "silver")
    bronze = scenario.bronze(spark)
    again = bronze.withColumn("name", F.lit("redelivered"))
    _, logs = silver_stream(spark, work, [(0, bronze), (1, again)])
    assert [(log.input_rows, log.output_rows) for log in logs] == [(6, 3), (6, 0)]
    rows = silver_rows(spark, work)
    assert listed(rows.select("id", "name")) == [(6060601, None), (606062, None), (606063, None)]
    assert rows.filter("silver_ingestion_timestamp is null").isEmpty()
    assert spark.read.parquet(f"{work}/rejects").count() == 6


def test_stream_equals_batch(spark):
    work = run_dir(spark, "silver")
    bronze = scenario.bronze(spark)
    silver_stream(spark, work, [(0, bronze.filter("id > 606062")), (1, bronze.filter("id <= 606062 or id is null"))])
    batch = S.rebuild_activities(bronze).filter("id in (6060601, 606062, 606063)")
    assert listed(silver_rows(spark, work).select(*batch.columns)) == listed(batch)


def test_killed_between_rejects_and_merge(spark, monkeypatch):
    work = run_dir(spark, "silver")
    load = S.activity_load(f"{work}/silver", f"{work}/rejects")

    def dies(*_, **__):
        raise RuntimeError("lost driver")

    with monkeypatch.context() as patch:
        patch.setattr(S, "merge_insert", dies)
        with pytest.raises(Exception, match="lost driver"):
            silver_stream(spark, work, [(0, scenario.bronze(spark))], load)
    assert spark.read.parquet(f"{work}/rejects").count() == 3
    load.run_stream(B.stream_batches(spark, f"{work}/bronze", BRONZE_ACTIVITY), f"{work}/checkpoint")
    assert (silver_rows(spark, work).count(), spark.read.parquet(f"{work}/rejects").count()) == (3, 3)


def test_detail_stream(spark):
    work = run_dir(spark, "details")
    load = S.detail_load(f"{work}/silver", f"{work}/rejects")
    silver_stream(spark, work, [(0, scenario.detail(spark))], load)
    assert spark.read.parquet(f"{work}/silver").select("id", F.col("start_date").cast("string")).collect() == [
        (200002, "2025-10-23")]


def details_for(spark, *rows):
    return spark.createDataFrame(rows, "id long, athlete_id long, calories double")


def test_features_and_late_details(spark):
    work = run_dir(spark, "features")
    silver_stream(spark, work, [(0, scenario.bronze(spark))])
    schema = S.silver_schema(BRONZE_ACTIVITY, spark, S.apply_all_silver_calcs)
    early = details_for(spark, (606062, 155180511, 650.0), (606063, 1, 10.0))
    load = FeatureLoad(f"{work}/features")
    stream = B.stream_batches(spark, f"{work}/silver", schema)
    log = load.run_stream(stream, early, f"{work}/feature_checkpoint")
    assert log.output_rows == 3
    assert load.run_stream(stream, early, f"{work}/feature_checkpoint") == []

    def table():
        return B.snapshot(spark, f"{work}/features", FEATURES)

    assert listed(table().select("id_sub_activity", "calories", "intensidade_calorica", "duracao_tipo", "mes_ref")) == [
        (606062, 650.0, "alta", "média", "Oct/2025"), (None, None, None, "curta", "Dec/2024"),
        (None, None, None, "média", "Oct/2025")]
    silver = silver_rows(spark, work)
    assert listed(table()) == listed(features(silver, early))

    late = early.unionByName(details_for(spark, (606063, 155180511, 310.0)))
    for batch in (1_000_000, 1_000_001):
        refresh_late_details(f"{work}/features", silver, late, batch)
        assert listed(table()) == listed(features(silver, late))
    assert late_groups(table(), silver, late).isEmpty()
    load.run_stream(stream, late, f"{work}/feature_checkpoint")
    assert table().count() == 3


def test_feature_replay_is_stable_with_missing_details(spark):
    target = run_dir(spark, "features")
    batch = features(S.rebuild_activities(scenario.bronze(spark)), details_for(spark))
    load = FeatureLoad(target)
    for number in (0, 0, 1):
        load.run_batch(batch, number)
    # the rows with equal content, one athlete's 606062 and 606063 among them, all stay
    assert B.snapshot(spark, target, FEATURES).count() == batch.count() == 6


def test_several_stored_details_do_not_multiply(spark):
    silver = S.rebuild_activities(scenario.bronze(spark)).filter("id = 606062")
    stored = spark.createDataFrame([(606062, 155180511, float(n), scenario.STAMP.replace(minute=n)) for n in range(9)],
                                   "id long, athlete_id long, calories double, ingestion_timestamp timestamp")
    assert features(silver, stored).select("calories").collect() == [(8.0,)]


def test_stream_as_sql_view_and_run_log(spark):
    work = run_dir(spark, "view")
    B.append_batch(spark.range(10), f"{work}/in", 0)
    B.stream_batches(spark, f"{work}/in", struct(id="long")).createOrReplaceTempView("numbers_stream")
    log = finish(append_stream(spark.sql("SELECT id FROM numbers_stream WHERE id % 10 > 6"), f"{work}/out",
                               f"{work}/checkpoint", "numbers"))
    assert listed(spark.read.parquet(f"{work}/out")) == [(7,), (8,), (9,)]
    saved = log.to_df(spark).first()
    assert (saved["query"], saved["batchId"], saved["inputRows"]) == ("numbers", 0, 10)


def deliveries(spark):
    """Keys delivered again across files, some of them bad, one moving to another month."""
    base = scenario.bronze(spark).filter("id in (606062, 606063)").withColumn("name", F.lit("v0"))
    frames = [base]
    for n, change in enumerate(({"name": F.lit("v1")}, {"distance": F.lit(0.0)}, {"start_date": F.lit("2025-12-02T08:00:00Z")}), 1):
        later = base.withColumns(change).withColumn(
            "ingestion_timestamp", F.col("ingestion_timestamp") + F.expr(f"make_interval(0, 0, 0, {n})"))
        frames.append(later if n < 3 else later.filter("id = 606063"))
    return frames


@pytest.mark.parametrize("order", [(0, 1, 2, 3), (3, 1, 0, 2)])
def test_newest_wins_however_batches_are_cut(spark, order):
    found = []
    for split in (False, True):
        work = run_dir(spark, "newest")
        frames = deliveries(spark)
        for i in order:
            B.append_batch(frames[i], f"{work}/bronze", i)
        load = S.activity_load(f"{work}/silver", f"{work}/rejects", keep="newest")
        stream = B.stream_batches(spark, f"{work}/bronze", frames[0].schema, max_bytes_per_trigger=1 if split else None)
        log = load.run_stream(stream, f"{work}/checkpoint")
        assert (len(log) > 1) == split
        found.append((listed(silver_rows(spark, work).drop("silver_ingestion_timestamp", "ingestion_timestamp")),
                      spark.read.parquet(f"{work}/rejects").count()))
    assert found[0] == found[1]
    assert listed(silver_rows(spark, work).select("id", "name", F.col("start_date").cast("string"))) == [
        (606062, "v1", "2025-10-23"), (606063, "v0", "2025-12-02")]


def test_default_load_sets_no_byte_limit(spark):
    work = run_dir(spark, "limit")
    for n in range(5):
        B.append_batch(spark.range(n * 10, n * 10 + 10), f"{work}/in", n)
    log = finish(append_stream(B.stream_batches(spark, f"{work}/in", struct(id="long")), f"{work}/out", f"{work}/c", "nolimit"))
    assert (len(log), log.input_rows, log.output_rows) == (1, 50, 50)
    assert BronzeLoader(f"{work}/in", f"{work}/c2", "parquet", spark=spark).stream_options == {}


def test_every_batch_is_logged(spark):
    work = run_dir(spark, "long")
    for n in range(12):
        B.append_batch(spark.range(n, n + 1).coalesce(1), f"{work}/in", n)
    before = spark.conf.get("spark.sql.streaming.numRecentProgressUpdates")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    try:
        stream = B.stream_batches(spark, f"{work}/in", struct(id="long"), max_bytes_per_trigger=1)
        log = finish(append_stream(stream, f"{work}/out", f"{work}/checkpoint", "long"))
    finally:
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", before)
    assert (len(log), log.input_rows, log.output_rows) == (12, 12, 12)


def test_reset_checkpoints_and_second_streams_lose_nothing(spark):
    work = run_dir(spark, "reset")
    schema = struct(id="long")

    def merge(batch, batch_id):
        B.append_batch(batch, f"{work}/appended", batch_id)
        M.merge_upsert(batch.withColumn("part", F.lit("p")), f"{work}/upserted", ["id"], ["part"], batch_id)

    def run(source, checkpoint):
        finish(batch_stream(B.stream_batches(spark, source, schema), merge, checkpoint, "reset"))

    B.append_batch(spark.range(3), f"{work}/in", 0)
    run(f"{work}/in", f"{work}/c1")
    B.reset_checkpoints(spark, f"{work}/c1")
    B.append_batch(spark.range(3, 5), f"{work}/in", 1)
    run(f"{work}/in", f"{work}/c1")
    B.append_batch(spark.range(100, 102), f"{work}/other", 0)
    run(f"{work}/other", f"{work}/c2")
    upserted = B.snapshot(spark, f"{work}/upserted", struct(id="long", part="string"))
    assert listed(upserted.select("id")) == [(n,) for n in (0, 1, 100, 101, 2, 3, 4)]
    assert spark.read.parquet(f"{work}/appended").count() == 3 + 5 + 2


def test_plain_intake_rescues_what_its_schema_lacks(spark):
    work = run_dir(spark, "rescue")
    os.makedirs(f"{work}/landing")
    with open(f"{work}/landing/a.json", "w", encoding="utf-8") as out:
        out.write('{"id":1,"athlete":{"id":9,"team":"t"},"new":5}\n{broken\n{"id":"x"}\n{"id":99999999999999999999}\n')
    load_bronze(f"{work}/landing", f"{work}/bronze", "json", f"{work}/checkpoint", spark=spark,
                declared=struct(id="long", athlete=struct(id="long")))
    rows = spark.read.parquet(f"{work}/bronze")
    assert listed(rows.select("id", "athlete_id", "_rescued_data")) == [
        (1, 9, '{"athlete":{"id":9,"team":"t"},"new":5}'), (None, None, '{"id":"x"}'),
        (None, None, '{"id":99999999999999999999}'), (None, None, "{broken")]
    land(f"{work}/athlete/x", "o.json", {"id": 4, "username": "u"})
    load_bronze(f"{work}/athlete/x", f"{work}/owners", "json", f"{work}/c2", spark=spark)
    assert "athlete_id" not in spark.read.parquet(f"{work}/owners").columns


def test_types_are_rewritten_and_not_their_names(spark):
    lines = spark.createDataFrame([('{"VARIANT":1,"OBJECT<":2,"a:b":1.5,"big":99999999999999999999,"mix":1,"e":{}}',), ('{"mix":"x"}',)], "value string")
    seen = observed_schema(parse_lines(lines))
    assert {f.name: f.dataType.simpleString() for f in seen.fields} == {
        "VARIANT": "bigint", "OBJECT<": "bigint", "a:b": "double", "big": "string", "mix": "string", "e": "string"}


def test_feature_batches_rank_only_their_own_details(spark):
    silver = S.rebuild_activities(scenario.bronze(spark)).filter("id = 606062")
    stored = details_for(spark, (606062, 155180511, 1.0), (7, 7, 2.0))
    plan = features(silver, details_of(silver, stored))._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and plan.index("Window") < plan.index("LeftSemi")
    assert features(silver, details_of(silver, stored)).select("calories").collect() == [(1.0,)]


def test_an_old_activity_reads_only_its_month(spark):
    work = run_dir(spark, "months")
    bronze = scenario.bronze(spark)
    silver_stream(spark, work, [(0, bronze)])
    months = {p.rsplit("=", 1)[1] for p in fsio.data_files(spark, f"{work}/silver")}
    assert months == {"2024-12", "2025-10"}
    current = B.read_batches(spark, f"{work}/silver", S.silver_schema(BRONZE_ACTIVITY, spark, S.apply_all_silver_calcs).add(S.MONTH, "string"))
    old = spark.createDataFrame([("2024-12",)], f"{S.MONTH} string")
    files_read = current.filter(filters.value_set(old, S.MONTH)).select(F.input_file_name()).distinct().collect()
    assert files_read and all("2024-12" in r[0] for r in files_read)
