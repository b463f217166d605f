"""Queries that go through written tables, files and streams in the shared folder."""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..functions import transforms as T
from ..operators import tables as B
from ..operators.merge import merge_insert, merge_upsert
from ..operators.quality import ACTIVITY_RULES, assert_quality
from ..operators.upkeep import compact_merged, reclaim
from ..plans import control as K
from ..plans import silver as S
from ..plans.features import FeatureDays, FeatureLoad, features
from ..plans.summaries import MONTHLY, WEEKLY, Summary, SummaryTable
from ..schemas import ATHLETE, CONTROL, FEATURE_PARTITIONS, FEATURES, struct
from ..session import run_dir
from ..sources import files
from ..sources.bronze import BronzeLoader, archive_landing, load_bronze
from ..sources.evolution import SchemaStore
from ..streaming.recovery import recover_log
from ..streaming.runs import append_stream, batch_stream, finish
from .batch_queries import CHECKED_COLUMNS, OWNER_STAMPS, chosen, details, silver
from .mapping import activity_documents, bronze_activities, bronze_details, plain, table

EVENTS = struct(event_id="long", ts="timestamp_ntz", user_id="long", event_type="string", value="double",
                props="string")


def scratch_database(spark: SparkSession, label: str) -> str:
    """A database of its own whose managed tables lie in the shared folder."""
    folder = run_dir(spark, label)
    name = folder.rsplit("/", 1)[1].replace("-", "_")
    spark.sql(f"CREATE DATABASE {name} LOCATION '{folder}'")
    return name


def event_loader(spark: SparkSession, sf_dir: str, work: str) -> BronzeLoader:
    return BronzeLoader(sf_dir, f"{work}/checkpoint", "parquet", declared=EVENTS, name_filter="events.parquet",
                        spark=spark)


# sources

def s1_bronze_stream(spark, sf_dir):
    work = run_dir(spark, "s1")
    loader = event_loader(spark, sf_dir, work)
    rows = loader.read_autoloader(["event_id AS id", "user_id AS athlete_id", "event_type", "value"])
    loader.write_to_bronze(loader.get_ingestion_time_column(rows), f"{work}/bronze")
    return spark.read.parquet(f"{work}/bronze").drop("ingestion_timestamp")


def s1_bronze_rescue(spark, sf_dir):
    """The bronze job over documents with an undeclared field, oversized ids and broken lines."""
    work = run_dir(spark, "s1_rescue")
    events = table(spark, sf_dir, "events")
    owner, error = F.struct(F.col("user_id").alias("id")).alias("athlete"), F.col("event_type") == "error"
    fields = [owner, F.col("event_type"), F.col("value"), F.col("event_id").alias("VARIANT")]
    (events.filter(~error).select(F.col("event_id").alias("id"), *fields).write.json(f"{work}/landing/events"))
    (events.filter(error).select(F.to_json(F.struct(*fields)).alias("line"))
     .select(F.concat(F.lit('{"id":99999999999999999999,'), F.expr("substring(line, 2)")))
     .write.text(f"{work}/landing/large"))
    events.filter(error).select(F.concat(F.lit("{broken "), "event_id")).write.text(f"{work}/landing/broken")
    load_bronze(f"{work}/landing/*", f"{work}/bronze", "json", f"{work}/checkpoint", spark=spark,
                declared=struct(id="long", athlete=struct(id="long"), event_type="string", value="double"))
    return spark.read.parquet(f"{work}/bronze").drop("ingestion_timestamp", "athlete")


def _lap_documents(events):
    """Activities with laps; those of errors have a field and a fraction that the others lack."""
    error = F.col("event_type") == "error"
    laps = F.array(*[F.struct(F.lit(k).alias("lap"), (F.col("event_id") % 7 + 0.5).alias("km"),
                              F.when(error & (F.lit(k) == 2), F.col("event_id") % 100).alias("pulse"),
                              F.struct(F.col("user_id").alias("x"), F.when(error, F.col("event_id")).alias("y")).alias("at"))
                     for k in (1, 2)])
    return events.select(F.col("event_id").alias("id"), F.struct(F.col("user_id").alias("id")).alias("athlete"), laps.alias("laps"))


def s1_array_rescue(spark, sf_dir):
    """The bronze job over documents with undeclared fields inside an array of objects."""
    work = run_dir(spark, "s1_arrays")
    _lap_documents(table(spark, sf_dir, "events")).write.json(f"{work}/landing")
    load_bronze(f"{work}/landing", f"{work}/bronze", "json", f"{work}/checkpoint", spark=spark, declared=struct(
        id="long", athlete=struct(id="long"), laps=ArrayType(struct(lap="long", km="double", at=struct(x="long")))))
    return spark.read.parquet(f"{work}/bronze").select(
        "id", "athlete_id", F.col("laps")[1]["km"].alias("km"), F.col("laps")[1]["at"]["x"].alias("x"), "_rescued_data")


def s2_array_evolution(spark, sf_dir):
    """Two intakes: the second lands new fields inside an array of objects."""
    work = run_dir(spark, "s2_arrays")
    loader = BronzeLoader(f"{work}/landing/*", f"{work}/checkpoint", "json", spark=spark)
    events = table(spark, sf_dir, "events")
    for part in (F.col("event_type") != "error", F.col("event_type") == "error"):
        _lap_documents(events.filter(part)).write.json(f"{work}/landing/{uuid.uuid4().hex}")
        loader.load_evolving(f"{work}/bronze")
    shape = SchemaStore(spark, loader.schema_path).load().add("_rescued_data", "string")
    laps = B.snapshot(spark, f"{work}/bronze", shape).select("id", F.inline("laps"), "_rescued_data")
    return laps.select("id", "lap", "km", "pulse", "at.x", "at.y", "_rescued_data")


def s2_schema_evolution(spark, sf_dir):
    """Two intakes: the second lands new fields (one named like a type, one with integers beyond
    BIGINT), ids of another type and broken lines."""
    work = run_dir(spark, "s2")
    events = table(spark, sf_dir, "events")
    owner = F.struct(F.col("user_id").alias("id")).alias("athlete")
    early = F.col("event_type").isin("view", "click")
    loader = BronzeLoader(f"{work}/landing/*", f"{work}/checkpoint", "json", spark=spark)
    (events.filter(early).select(F.col("event_id").alias("id"), owner, F.col("event_type").alias("kind"))
     .write.json(f"{work}/landing/one"))
    loader.load_evolving(f"{work}/bronze")
    later = events.filter(~early)
    errors = later.filter("event_type = 'error'")
    line = F.to_json(F.struct(F.concat(F.lit("E"), F.col("event_id")).alias("id"), owner, F.col("event_type").alias("kind"),
                              "value", F.col("event_id").alias("VARIANT")))
    (errors.select(line.alias("line"))
     .select(F.concat(F.expr("substring(line, 1, length(line) - 1)"), F.lit(',"big":99999999999999999999}')))
     .write.text(f"{work}/landing/two"))
    errors.select(F.concat(F.lit("{broken "), F.col("event_id"))).write.text(f"{work}/landing/broken")
    (later.filter("event_type <> 'error'").select(F.col("event_id").alias("id"), owner,
                                                  F.col("event_type").alias("kind"), "value")
     .write.json(f"{work}/landing/three"))
    loader.load_evolving(f"{work}/bronze")
    shape = struct(id="long", athlete_id="long", kind="string", value="double", VARIANT="long", big="string",
                   _rescued_data="string")
    return B.snapshot(spark, f"{work}/bronze", shape)


def s3_stream_from_table(spark, sf_dir):
    work = run_dir(spark, "s3")
    B.append_batch(table(spark, sf_dir, "events"), f"{work}/bronze", 0)
    stream = B.stream_batches(spark, f"{work}/bronze", EVENTS)
    finish(append_stream(stream.select("event_id", "user_id", "event_type", "value"), f"{work}/out",
                         f"{work}/checkpoint", "s3"))
    return spark.read.parquet(f"{work}/out")


def s4_table_scan(spark, sf_dir):
    database = scratch_database(spark, "s4")
    B.register_external(spark, f"{database}.orders", f"{sf_dir}/orders.parquet")
    return files.read_table(spark, f"{database}.orders").select("o_orderkey", "o_orderstatus",
                                                                              "o_totalprice")


def s5_json_documents(spark, sf_dir):
    work = run_dir(spark, "s5")
    (table(spark, sf_dir, "customer")
     .select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"), F.col("c_mktsegment").alias("bio"),
             F.col("c_acctbal").alias("weight"), F.col("c_nationkey").alias("not_declared"))
     .write.json(f"{work}/athletes"))
    return files.read_documents(spark, f"{work}/athletes", ATHLETE).select("id", "username", "bio", "weight",
                                                                           "country")


def _control_text(df: DataFrame) -> DataFrame:
    return df.withColumn("ingestion_timestamp", F.date_format("ingestion_timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def s6_csv_scan(spark, sf_dir):
    work = run_dir(spark, "s6")
    B.export_single_csv(_control_text(K.control_table(silver(spark, sf_dir, *OWNER_STAMPS))), f"{work}/control.csv")
    return plain(files.read_control(spark, f"{work}/control.csv"))


def s7_stream_view_sql(spark, sf_dir):
    work = run_dir(spark, "s7")
    event_loader(spark, sf_dir, work).read_autoloader().createOrReplaceTempView("bronze_stream")
    rows = spark.sql("SELECT user_id AS athlete_id, event_id AS id, upper(event_type) AS kind FROM bronze_stream")
    finish(append_stream(rows, f"{work}/out", f"{work}/checkpoint", "s7"))
    return spark.read.parquet(f"{work}/out")


def s8_catalog_top_n(spark, sf_dir):
    database = scratch_database(spark, "s8")
    B.register_external(spark, f"{database}.orders", f"{sf_dir}/orders.parquet")
    before = spark.catalog.currentDatabase()
    try:
        rows = files.read_table(spark, "orders", database=database)
    finally:
        files.use(spark, database=before)
    return (rows.orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(10)
            .select("o_orderkey", "o_custkey", "o_totalprice"))


# sinks

def k2_run_log(spark, sf_dir):
    work = run_dir(spark, "k2")
    database = scratch_database(spark, "k2_log")
    loader = event_loader(spark, sf_dir, work)
    log = loader.write_to_bronze(loader.read_autoloader(), f"{work}/bronze")
    log.append_to(spark, f"{database}.run_log")
    return (spark.read.table(f"{database}.run_log").groupBy("query")
            .agg(F.sum("inputRows").alias("input_rows"), F.sum("outputRows").alias("output_rows")))


def k2_recovered_log(spark, sf_dir):
    """The log of a stream that nobody finished, rebuilt from its checkpoint and its files."""
    work = run_dir(spark, "k2")
    database = scratch_database(spark, "k2_recovered")
    loader = event_loader(spark, sf_dir, work)
    query = loader.write_to_bronze(loader.read_autoloader(), f"{work}/bronze", await_termination=False)
    query.awaitTermination()
    for _ in range(2):  # the second call finds nothing to add
        recover_log(spark, f"{database}.run_log", loader.checkpoint_path, "bronze_loader",
                    landed=spark.read.options(**loader.options).schema(EVENTS).parquet(sf_dir),
                    written=spark.read.parquet(f"{work}/bronze"))
    return (spark.read.table(f"{database}.run_log").groupBy("query")
            .agg(F.sum("inputRows").alias("input_rows"), F.sum("outputRows").alias("output_rows")))


def k4_append(spark, sf_dir):
    database = scratch_database(spark, "k4")
    bronze, runs = bronze_activities(spark, sf_dir), F.col("sport_type") == "Run"
    for version, part in (("v1", runs), ("v2", ~runs)):  # two batch jobs, each with its errors
        S.rebuild_silver(spark, bronze.filter(part), run_dir(spark, "k4_data"), version, None, f"{database}.errors",
                         columns=("id",))
    return plain(spark.read.table(f"{database}.errors").select("id", "sport_type", "ingestion_timestamp"))


def k5_overwrite_schema(spark, sf_dir):
    database, work = scratch_database(spark, "k5"), run_dir(spark, "k5_data")
    bronze = bronze_activities(spark, sf_dir)
    S.rebuild_silver(spark, bronze, work, "v1", f"{database}.silver", columns=("id", "start_date"))
    S.rebuild_silver(spark, bronze, work, "v2", f"{database}.silver")
    return plain(spark.read.table(f"{database}.silver"))


def k6_overwrite_table(spark, sf_dir):
    database = scratch_database(spark, "k6")
    control = K.control_table(silver(spark, sf_dir, *OWNER_STAMPS))
    B.replace_managed(control.withColumn("full_carga", F.lit(True)), f"{database}.control")
    B.replace_managed(control, f"{database}.control")
    return plain(spark.read.table(f"{database}.control"))


def k7_external_table(spark, sf_dir):
    database, work = scratch_database(spark, "k7"), run_dir(spark, "k7_data")
    B.append_batch(bronze_activities(spark, sf_dir), f"{work}/bronze", 0)
    B.register_external(spark, f"{database}.bronze", f"{work}/bronze", comment="Landed activities")
    B.recover_partitions(spark, f"{database}.bronze")
    return spark.sql(f"SELECT count(*) AS total, count(id) AS with_id FROM {database}.bronze")


def k8_partitioned_table(spark, sf_dir):
    database, work = scratch_database(spark, "k8"), run_dir(spark, "k8_data")
    B.create_partitioned(spark, f"{database}.features", FEATURES, FEATURE_PARTITIONS, f"{work}/features",
                         {"stridemill.layout": "rebalanced"})
    B.write_partitioned(features(silver(spark, sf_dir), details(spark, sf_dir)), f"{work}/features",
                        FEATURE_PARTITIONS)
    B.recover_partitions(spark, f"{database}.features")
    return plain(spark.read.table(f"{database}.features").select(*FEATURES.names))


def k9_create_as_select(spark, sf_dir):
    database = scratch_database(spark, "k9")
    B.create_as_select(spark, f"{database}.final", chosen(spark, sf_dir).orderBy("sport_type", "id"))
    return spark.read.table(f"{database}.final")


def k10_csv_export(spark, sf_dir):
    database, work = scratch_database(spark, "k10"), run_dir(spark, "k10_data")
    K.publish_control(_control_text(K.control_table(silver(spark, sf_dir, *OWNER_STAMPS))), f"{work}/control.csv",
                      f"{database}.control")
    return plain(files.read_csv(spark, f"{work}/control.csv", CONTROL))


def k11_typed_insert(spark, sf_dir):
    database = scratch_database(spark, "k11")
    spark.sql(f"CREATE TABLE {database}.bronze (id BIGINT, athlete STRUCT<id: BIGINT, resource_state: BIGINT>,"
              " map STRUCT<id: STRING, summary_polyline: STRING>, start_latlng ARRAY<DOUBLE>,"
              " ingestion_timestamp TIMESTAMP) USING parquet")
    table(spark, sf_dir, "events").createOrReplaceTempView("insert_source")
    spark.sql(f"INSERT INTO {database}.bronze (id, athlete, map, start_latlng, ingestion_timestamp)"
              " SELECT event_id, named_struct('id', user_id, 'resource_state', 1L),"
              " named_struct('id', concat('map', event_id), 'summary_polyline', ''), array(value, -value),"
              " CAST(ts AS TIMESTAMP) FROM insert_source")
    return spark.read.table(f"{database}.bronze").select(
        "id", F.col("athlete.id").alias("athlete_id"), F.col("map.id").alias("map_id"),
        F.size("start_latlng").alias("points"), F.element_at("start_latlng", 1).alias("first_point"))


def k12_maintenance(spark, sf_dir):
    """Truncate, widen and drop; then a stream whose checkpoint is reset before more rows come."""
    database, work = scratch_database(spark, "k12"), run_dir(spark, "k12_data")
    name = f"{database}.silver"
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "event_type")
    B.append_rows(events.select("id"), name)
    B.truncate(spark, name)
    B.add_columns(spark, name, note="STRING COMMENT 'added later'")
    B.append_rows(events.select("id"), f"{database}.gone")
    B.drop(spark, f"{database}.gone")
    early = F.col("event_type").isin("view", "click")

    def merge(batch: DataFrame, batch_id: B.BatchId) -> None:
        merge_insert(batch, f"{work}/merged", ["id"], batch_id)

    for batch, part in enumerate((early, ~early)):
        B.append_batch(events.filter(part), f"{work}/bronze", batch)
        stream = B.stream_batches(spark, f"{work}/bronze", events.schema)
        finish(batch_stream(stream, merge, f"{work}/checkpoint", "k12"))
        B.reset_checkpoints(spark, f"{work}/checkpoint")
    merged = B.snapshot(spark, f"{work}/merged", events.schema)
    B.append_rows(merged.select("id", F.concat(F.lit("kept "), "event_type").alias("note")), name)
    return spark.read.table(name)


def k13_archive(spark, sf_dir):
    """A stream reads the landing, a file comes late, what was read is archived, the late one is read next."""
    work = run_dir(spark, "k13")
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "event_type")
    shape = struct(id="long", event_type="string")
    landing, checkpoint = f"{work}/landing/processing_data", f"{work}/checkpoint"
    loader = BronzeLoader(landing, checkpoint, "json", declared=shape, spark=spark)
    late = F.col("event_type") == "error"
    for part, day in ((~late, "2024-01-31"), (late, "2024-02-01")):
        rows.filter(part).write.mode("append").json(landing)
        if day == "2024-02-01":  # what is there now came after the run
            archive_landing(spark, landing, f"{work}/landing/2024-01-31", checkpoint)
        loader.write_to_bronze(loader.read_autoloader(), f"{work}/bronze")
    archived = files.read_documents(spark, f"{work}/landing/2024-01-31", shape).select("id", F.lit(True).alias("archived"))
    return (spark.read.parquet(f"{work}/bronze").join(archived, "id", "left")
            .select("id", "event_type", F.coalesce("archived", F.lit(False)).alias("archived")))


def p1_nested_owner(spark, sf_dir):
    """Owner id out of the nested profile, over landed JSON documents."""
    work = run_dir(spark, "p1")
    documents = activity_documents(spark, sf_dir).select("id", "athlete", "start_date")
    documents.write.json(f"{work}/landing")
    landed = files.read_documents(spark, f"{work}/landing", documents.schema)
    return T.add_athlete_id(landed).select("id", "athlete_id")


# merges

def j6_merge_insert(spark, sf_dir):
    database, target = scratch_database(spark, "j6"), f"{run_dir(spark, 'j6_data')}/orders"
    name = f"{database}.orders"
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    keys = ["o_orderkey", "o_custkey"]
    merge_insert(orders.filter("o_orderdate < TIMESTAMP_NTZ '1997-01-01 00:00:00'"), target, keys, 0, catalog_table=name)
    changed = orders.withColumn("o_totalprice", F.col("o_totalprice") * 2)
    for _ in range(2):  # a replayed batch changes nothing
        merge_insert(changed, target, keys, 1, prune_by="o_orderkey", catalog_table=name)
    return plain(spark.read.table(name).select(*orders.columns))


def j7_merge_upsert(spark, sf_dir):
    database, target = scratch_database(spark, "j7"), f"{run_dir(spark, 'j7_data')}/orders"
    name, keys, slots = f"{database}.orders", ["o_orderkey"], ["year", "status"]
    base, fresh = _upserted_orders(spark, sf_dir)
    merge_upsert(base.filter("o_day < DATE '1998-01-01'"), target, keys, slots, 0, catalog_table=name)
    for _ in range(2):
        merge_upsert(fresh, target, keys, slots, 1, prune_by="o_orderkey", catalog_table=name)
    return plain(spark.read.table(name).select(*base.columns))


def _upserted_orders(spark, sf_dir):
    """Orders, some without a key, and later ones at another price and partly in another partition."""
    key = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderkey"))
    base = table(spark, sf_dir, "orders").select(
        key.alias("o_orderkey"), "o_custkey", "o_totalprice", "o_orderpriority",
        F.to_date("o_orderdate").alias("o_day"), F.col("o_orderstatus").alias("status"),
        F.year("o_orderdate").alias("year"))
    moved = F.when(F.col("o_orderpriority") == "1-URGENT", "U").otherwise(F.col("status"))
    fresh = base.filter("o_day >= DATE '1997-06-01'").withColumns({"o_totalprice": F.col("o_totalprice") * 2,
                                                                   "status": moved})
    return base, fresh


def j7_packed_upsert(spark, sf_dir):
    """The same upserts in smaller batches, with packing and removal of old files in between and a repeat of all."""
    database, target = scratch_database(spark, "j7_packed"), f"{run_dir(spark, 'j7_packed_data')}/orders"
    name, slots = f"{database}.orders", ["year", "status"]
    base, fresh = _upserted_orders(spark, sf_dir)
    batches = [base.filter("o_day < DATE '1995-01-01'"), base.filter("o_day between DATE '1995-01-01' and DATE '1996-12-31'"),
               base.filter("o_day between DATE '1997-01-01' and DATE '1997-12-31'"), fresh]
    for batch, rows in enumerate([*batches, *batches]):
        merge_upsert(rows, target, ["o_orderkey"], slots, batch % 4, prune_by="o_orderkey", catalog_table=name)
        if batch in (2, 4):
            compact_merged(spark, name, target)
            reclaim(spark, name, target, older_than=0)
    return plain(spark.read.table(name).select(*base.columns))


# quality and streams

def q4_stored_rejects(spark, sf_dir):
    rejects = f"{run_dir(spark, 'q4')}/rejects"
    latest = S.dedupe_microbatch(bronze_activities(spark, sf_dir), ["athlete_id", "id"], ["ingestion_timestamp"])
    derived = S.apply_all_silver_calcs(latest)
    for _ in range(2):  # a retried batch must not store its rejects twice
        assert_quality(derived, ACTIVITY_RULES, rejects, batch_id=0).release()
    return spark.read.parquet(rejects).select("id", "athlete_id", "reject_reason")


def t2_restarted_stream(spark, sf_dir):
    """Two runs on one checkpoint; the second sees only what was added in between."""
    work = run_dir(spark, "t2")
    events = table(spark, sf_dir, "events")
    for batch, part in enumerate((F.col("value") < 20, F.col("value") >= 20)):
        B.append_batch(events.filter(part), f"{work}/bronze", batch)
        stream = B.stream_batches(spark, f"{work}/bronze", EVENTS).select("event_id", "event_type")
        finish(append_stream(stream, f"{work}/out", f"{work}/checkpoint", "t2"))
    return spark.read.parquet(f"{work}/out")


def _run_silver(spark: SparkSession, sf_dir: str, work: str, catalog_table: str | None = None) -> S.SilverLoad:
    """First deliveries, then second ones, each as a run of the silver stream."""
    load = S.activity_load(f"{work}/silver", f"{work}/rejects", catalog_table=catalog_table)
    for batch in (0, 1):
        rows = bronze_activities(spark, sf_dir, redelivery=batch)
        B.append_batch(rows, f"{work}/bronze", batch)
        load.run_stream(B.stream_batches(spark, f"{work}/bronze", rows.schema), f"{work}/silver_checkpoint")
    return load


def _silver_schema(spark: SparkSession, sf_dir: str) -> StructType:
    return S.silver_schema(bronze_activities(spark, sf_dir).schema, spark, S.apply_all_silver_calcs)


def t4_silver_stream(spark, sf_dir):
    database, work = scratch_database(spark, "t4"), run_dir(spark, "t4_data")
    _run_silver(spark, sf_dir, work, f"{database}.silver")
    return plain(spark.read.table(f"{database}.silver").select(*CHECKED_COLUMNS))


def t4_newest_stream(spark, sf_dir):
    """The newest valid delivery of every activity, the second deliveries first, with upkeep in between."""
    database, work = scratch_database(spark, "t4_newest"), run_dir(spark, "t4_newest_data")
    name = f"{database}.silver"
    load = S.activity_load(f"{work}/silver", f"{work}/rejects", keep="newest", catalog_table=name)
    for batch in (1, 0):
        rows = bronze_activities(spark, sf_dir, redelivery=batch)
        B.append_batch(rows, f"{work}/bronze", batch)
        load.run_stream(B.stream_batches(spark, f"{work}/bronze", rows.schema), f"{work}/silver_checkpoint")
        compact_merged(spark, name, f"{work}/silver")
        reclaim(spark, name, f"{work}/silver", older_than=0)
    return plain(spark.read.table(name).select(*CHECKED_COLUMNS))


def t4_stream_rejects(spark, sf_dir):
    work = run_dir(spark, "t4_rejects")
    _run_silver(spark, sf_dir, work)
    return spark.read.parquet(f"{work}/rejects").select("id", "athlete_id", "reject_reason")


def t4_detail_stream(spark, sf_dir):
    work = run_dir(spark, "t4_details")
    rows = bronze_details(spark, sf_dir)
    B.append_batch(rows, f"{work}/bronze", 0)
    load = S.detail_load(f"{work}/silver", f"{work}/rejects")
    load.run_stream(B.stream_batches(spark, f"{work}/bronze", rows.schema), f"{work}/checkpoint")
    return plain(spark.read.parquet(f"{work}/silver").select("id", "athlete_id", "start_date", "calories"))


def c1_control_batches(spark, sf_dir):
    """The control table kept up to date by batches of silver rows, one of them repeated."""
    database, work = scratch_database(spark, "c1_batches"), run_dir(spark, "c1_batches_data")
    state = K.ControlState(f"{work}/control", f"{database}.control")
    rows = silver(spark, sf_dir).select("athlete_id", "id", "start_date", "ingestion_timestamp")
    with B.held(rows, "c1-silver") as kept:
        for batch in (2, 0, 1, 0):
            state.run_batch(kept.filter(F.pmod(F.coalesce("id", F.lit(0)), F.lit(3)) == batch), batch)
    return plain(state.table(spark))


def t3_feature_stream(spark, sf_dir):
    """Silver stream, watermarked, joined with the detail snapshot and upserted."""
    work = run_dir(spark, "t3")
    _run_silver(spark, sf_dir, work)
    details(spark, sf_dir).write.parquet(f"{work}/details")
    stream = B.stream_batches(spark, f"{work}/silver", _silver_schema(spark, sf_dir))
    FeatureLoad(f"{work}/features").run_stream(stream, spark.read.parquet(f"{work}/details"),
                                               f"{work}/feature_checkpoint")
    return plain(B.snapshot(spark, f"{work}/features", FEATURES))


def t3_any_order(spark, sf_dir):
    """Features kept equal to the full rebuild: details come before, with and after their activities."""
    work = run_dir(spark, "t3_any_order")
    parts = []
    for name, rows in (("activities", silver(spark, sf_dir)), ("details", details(spark, sf_dir))):
        half = F.pmod(F.coalesce("id", F.lit(0)), F.lit(2)) == (0 if name == "activities" else 1)
        parts.append((f"{work}/{name}", rows.schema, [rows.filter(half), rows.filter(~half)]))
    load = FeatureDays(f"{work}/features", *[partial(B.snapshot, spark, path, schema) for path, schema, _ in parts])
    for batch in (0, 1):
        for path, _, halves in parts:
            B.append_batch(halves[batch], path, batch)
        load.run_streams(*[B.stream_batches(spark, path, schema) for path, schema, _ in parts], f"{work}/checkpoint")
    return plain(B.snapshot(spark, f"{work}/features", FEATURES))


def _followed(spark: SparkSession, sf_dir: str, label: str, keep: str, batches: tuple[int, ...],
              summary: Summary) -> DataFrame:
    """A summary that followed a silver stream, delivery by delivery."""
    database, work = scratch_database(spark, label), run_dir(spark, f"{label}_data")
    kept = SummaryTable(f"{database}.silver", f"{work}/silver", f"{work}/summary", f"{database}.summary", summary)
    load = S.activity_load(f"{work}/silver", f"{work}/rejects", keep=keep, catalog_table=f"{database}.silver",
                           followers=[kept.follow])
    for batch in batches:
        rows = bronze_activities(spark, sf_dir, redelivery=batch)
        B.append_batch(rows, f"{work}/bronze", batch)
        load.run_stream(B.stream_batches(spark, f"{work}/bronze", rows.schema), f"{work}/silver_checkpoint")
    return plain(spark.read.table(f"{database}.summary").drop(B.BATCH_COLUMN))


def a1_weekly_batches(spark, sf_dir):
    """Weekly runs kept up to date with the newest valid deliveries, the second deliveries first."""
    return _followed(spark, sf_dir, "a1_batches", "newest", (1, 0), WEEKLY)


def a8_monthly_batches(spark, sf_dir):
    """Monthly distribution kept up to date with a silver table that inserts what it lacks."""
    return _followed(spark, sf_dir, "a8_batches", "first", (0, 1), MONTHLY)


QUERIES = {f.__name__: f for f in (
    s1_bronze_stream, s1_bronze_rescue, s1_array_rescue, s2_schema_evolution,
    s2_array_evolution, s3_stream_from_table, s4_table_scan, s5_json_documents, s6_csv_scan,
    s7_stream_view_sql, s8_catalog_top_n, k2_run_log, k2_recovered_log, k4_append, k5_overwrite_schema, k6_overwrite_table,
    k7_external_table, k8_partitioned_table, k9_create_as_select, k10_csv_export, k11_typed_insert, k12_maintenance,
    k13_archive, p1_nested_owner, j6_merge_insert, j7_merge_upsert, j7_packed_upsert, q4_stored_rejects,
    a1_weekly_batches, a8_monthly_batches, c1_control_batches, t2_restarted_stream,
    t3_any_order, t3_feature_stream, t4_silver_stream, t4_newest_stream, t4_stream_rejects, t4_detail_stream)}
