"""Queries over the supplied tables that are one lazy plan each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import transforms as T
from ..operators import aggregates as A
from ..operators import dedupe as D
from ..operators import joins as J
from ..operators.quality import ACTIVITY_RULES, DETAIL_RULES, annotate, rejected_rows, valid_rows
from ..plans import control as K
from ..plans import silver as S
from ..plans.features import features
from ..schemas import SILVER_COLUMNS
from .mapping import bronze_activities, bronze_details, plain, table

CHECKED_COLUMNS = ("id", "athlete_id", "start_date", "sport_type", "distance_km", "average_speed_kmh", "pace_min_km",
                   "pace_min_km_moving_time", "tempo_real", "pace_min_km_new", "pace_clock", "dia_semana")


DETAIL_COLUMNS = ("id", "athlete_id", "sport_type", "start_date", "start_date_local", "calories", "achievement_count",
                  "elapsed_time", "ingestion_timestamp")
RUN_MEASURES = ("sport_type", "start_date", "distance_km", "total_elevation_gain", "pace_min_km", "average_speed_kmh")
OWNER_STAMPS = ("athlete_id", "start_date", "ingestion_timestamp")


def silver(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Silver activities, whole or only some columns."""
    return S.rebuild_activities(bronze_activities(spark, sf_dir), columns or SILVER_COLUMNS)


def details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.rebuild_details(bronze_details(spark, sf_dir).select(*DETAIL_COLUMNS))


def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One incremental batch over everything: deduplicated, derived, annotated."""
    latest = D.dedupe_microbatch(bronze_activities(spark, sf_dir), ["athlete_id", "id"], ["ingestion_timestamp"])
    return annotate(S.apply_all_silver_calcs(latest), ACTIVITY_RULES)


def best(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.add_activity_date(details(spark, sf_dir))
    return D.best_per_day(rows.select("id", "athlete_id", "sport_type", "activity_date", "calories",
                                      "achievement_count", "elapsed_time"))


def chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best(spark, sf_dir).filter("calories > 0").select("sport_type", "id", "calories")


def athletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))


# projections and filters

def p2_stamps(spark, sf_dir):
    stamped = bronze_activities(spark, sf_dir).transform(T.add_ingestion_time).transform(T.add_silver_ingestion_time)
    return stamped.select("id", F.col("ingestion_timestamp").isNotNull().alias("stamped"),
                          (F.col("ingestion_timestamp") == F.col("silver_ingestion_timestamp")).alias("same_stamp"))


def p3_silver_projection(spark, sf_dir):
    return plain(silver(spark, sf_dir))


def p4_qualified_projection(spark, sf_dir):
    joined = J.with_details(silver(spark, sf_dir, "id", "athlete_id", "sport_type", "distance_km"),
                            details(spark, sf_dir).select("id", "athlete_id", "calories", "ingestion_timestamp"))
    return joined.select("a.id", "a.athlete_id", "a.sport_type", "a.distance_km", "b.calories", "b.id_sub_activity")


def p5_owner_split(spark, sf_dir):
    bronze = bronze_activities(spark, sf_dir).select("id", "athlete_id")
    owned = S.with_owner(bronze).withColumn("is_error", F.lit(False))
    return owned.unionByName(S.without_owner(bronze).withColumn("is_error", F.lit(True)))


def p6_runs(spark, sf_dir):
    return silver(spark, sf_dir, "id", "sport_type", "distance_km").filter(F.col("sport_type") == "Run").drop("sport_type")


def p7_predicates(spark, sf_dir):
    rows = silver(spark, sf_dir, "id", "name", "type", "start_date")
    chosen_rows = (F.col("type") == "Run") & (F.col("name").isin("Session 7", "Session 21")
                                              | (F.col("start_date") == F.lit("2024-01-10").cast("date")))
    return plain(rows.filter(chosen_rows).select("id", "name", "start_date"))


def p8_since(spark, sf_dir):
    silver(spark, sf_dir, "id", "start_date").createOrReplaceTempView("recent_source")
    return plain(spark.sql("SELECT id, start_date FROM recent_source WHERE start_date >= DATE '2024-01-15'"))


def p9_distinct(spark, sf_dir):
    return bronze_activities(spark, sf_dir).select("id").distinct()


def p10_transform_chain(spark, sf_dir):
    return plain(checked(spark, sf_dir).select(*CHECKED_COLUMNS))


def p11_existence(spark, sf_dir):
    found = not rejected_rows(checked(spark, sf_dir)).isEmpty()
    return table(spark, sf_dir, "events").agg((F.lit(found) & (F.count(F.lit(1)) > 0)).alias("has_rejects"))


# joins

def j1_features(spark, sf_dir):
    return plain(features(silver(spark, sf_dir), details(spark, sf_dir)))


def j2_control_join(spark, sf_dir):
    rows = silver(spark, sf_dir, *OWNER_STAMPS)
    return plain(J.join_control(D.last_value(rows, "athlete_id", "start_date"),
                                D.earliest_value(rows, "athlete_id", "ingestion_timestamp")))


def j3_calorie_report(spark, sf_dir):
    return plain(J.calorie_report(silver(spark, sf_dir), chosen(spark, sf_dir), since="2024-01-05"))


def j4_missing_details(spark, sf_dir):
    return J.missing_details(silver(spark, sf_dir, "id"), details(spark, sf_dir))


def j4_orders_without_lines(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "id")
    return J.missing_details(orders, table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "id"))


def j5_load_mode(spark, sf_dir):
    modes = J.load_mode(athletes(spark, sf_dir), K.control_table(silver(spark, sf_dir, *OWNER_STAMPS)))
    return plain(modes.select("athlete_id_json", "athlete_id", "start_date", "full_carga"))


# aggregates

def a1_weekly_runs(spark, sf_dir):
    return A.weekly_summary(silver(spark, sf_dir, *RUN_MEASURES))


def a2_type_counts(spark, sf_dir):
    return A.count_by(silver(spark, sf_dir, "type"), "type")


def a3_key_uniqueness(spark, sf_dir):
    return A.key_uniqueness(silver(spark, sf_dir, "id"))


def a4_reject_report(spark, sf_dir):
    return plain(A.reject_report(rejected_rows(checked(spark, sf_dir)), stamp="ingestion_timestamp"))


def a5_total_count(spark, sf_dir):
    return A.total_count(table(spark, sf_dir, "lineitem"))


def a6_duplicate_keys(spark, sf_dir):
    return A.duplicated_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def a7_distinct_ids(spark, sf_dir):
    return D.distinct_by_key(bronze_activities(spark, sf_dir), "id", "id_activity")


def a8_monthly(spark, sf_dir):
    return plain(A.monthly_distribution(silver(spark, sf_dir, *RUN_MEASURES)))


def a8_elevation_per_km(spark, sf_dir):
    rows = silver(spark, sf_dir, "id", "athlete_id", "distance_km", "total_elevation_gain")
    return A.elevation_per_km(rows).select("id", "athlete_id", "elevation_gain_per_km")


def a8_period_over_period(spark, sf_dir):
    weeks = A.weekly_summary(silver(spark, sf_dir, *RUN_MEASURES)).select("year", "week", "total_activities", "total_distance_km")
    return A.period_over_period(weeks, ["year", "week"], ["total_activities", "total_distance_km"])


# windows and order

def w1_latest_activity(spark, sf_dir):
    rows = bronze_activities(spark, sf_dir).select("id", "athlete_id", "start_date", "distance", "ingestion_timestamp")
    return plain(D.dedupe_microbatch(rows, ["athlete_id", "id"], ["ingestion_timestamp"]))


def w1_latest_line(spark, sf_dir):
    return plain(D.dedupe_microbatch(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_shipdate"]))


def w2_last_activity(spark, sf_dir):
    return plain(D.last_value(silver(spark, sf_dir, *OWNER_STAMPS), "athlete_id", "start_date"))


def w3_first_ingestion(spark, sf_dir):
    return plain(D.earliest_value(silver(spark, sf_dir, *OWNER_STAMPS), "athlete_id", "ingestion_timestamp"))


def w4_best_per_day(spark, sf_dir):
    return plain(best(spark, sf_dir))


def o1_newest_first(spark, sf_dir):
    rows = bronze_activities(spark, sf_dir).select("id", "ingestion_timestamp")
    return plain(A.newest_first(rows, "ingestion_timestamp", "id"))


def o2_ordinals(spark, sf_dir):
    bronze_activities(spark, sf_dir).createOrReplaceTempView("ordinal_source")
    return spark.sql("SELECT sport_type, CAST(date(ingestion_timestamp) AS STRING) AS day, count(*) AS total"
                     " FROM ordinal_source GROUP BY 1, 2 ORDER BY 2 DESC, 1")


def o3_top_priced_order(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return D.dedupe_microbatch(rows, ["o_custkey"], ["o_totalprice", "o_orderkey"])


# functions

def f1_start_date(spark, sf_dir):
    rows = bronze_activities(spark, sf_dir).select("id", F.col("start_date").alias("text"))
    return plain(T.add_start_date(rows, "text"))


def _silver_columns(*names):
    return lambda spark, sf_dir: plain(silver(spark, sf_dir, "id", "athlete_id", *names))


def f2_distance_km(spark, sf_dir):
    return silver(spark, sf_dir, "id", "athlete_id", "distance", "distance_km")


def f3_speed_kmh(spark, sf_dir):
    return silver(spark, sf_dir, "id", "athlete_id", "average_speed", "average_speed_kmh")


def f4_pace_all_sports(spark, sf_dir):
    return T.add_pace_min_km(bronze_activities(spark, sf_dir), only_for_run=False).select("id", "pace_min_km")


def f10_periodo_dia(spark, sf_dir):
    rows = silver(spark, sf_dir, "id", "start_date_local")
    return T.add_periodo_dia(rows)


def f11_semana_ano_mes(spark, sf_dir):
    return T.add_semana_ano_mes(silver(spark, sf_dir, "id", "start_date_local")).select("id", "semana", "ano", "mes_ref")


def f12_reason_lists(spark, sf_dir):
    return checked(spark, sf_dir).select("id", "athlete_id", "reject_reason", "reject_reason_count")


def f13_calorie_class(spark, sf_dir):
    return T.add_intensidade_calorica(details(spark, sf_dir).select("id", "calories"))


def f14_duration_class(spark, sf_dir):
    return T.add_duracao_tipo(silver(spark, sf_dir, "id", "tempo_real"))


def f15_unix(spark, sf_dir):
    rows = silver(spark, sf_dir, "id", *OWNER_STAMPS)
    return (rows.transform(T.convert_to_unix, "start_date").transform(T.convert_to_unix, "ingestion_timestamp")
            .drop("start_date", "ingestion_timestamp"))


def f16_activity_date(spark, sf_dir):
    return plain(T.add_activity_date(bronze_activities(spark, sf_dir)).select("id", "activity_date"))


def f17_expressions(spark, sf_dir):
    rows = bronze_activities(spark, sf_dir).withColumns({
        "owner": F.expr("named_struct('id', athlete_id)"), "texts": F.array("start_date", "start_date_local")})
    return rows.select("id", F.lit(False).alias("full_carga"),
                       F.coalesce("workout_type", F.lit(-1)).alias("workout"),
                       F.col("distance").cast("long").alias("whole_metres"),
                       F.when(F.col("manual"), "manual").otherwise("device").alias("origin"),
                       F.col("owner.id").alias("owner_id"), F.element_at("texts", 1).alias("first_text"))


# quality

def q1_activity_rules(spark, sf_dir):
    return rejected_rows(checked(spark, sf_dir)).select("id", "athlete_id", "reject_reason")


def q2_detail_rules(spark, sf_dir):
    latest = D.dedupe_microbatch(bronze_details(spark, sf_dir), ["athlete_id", "id"], ["ingestion_timestamp"])
    return annotate(S.apply_detail_calcs(latest), DETAIL_RULES).select("id", "athlete_id", "reject_reason")


def q3_valid_rows(spark, sf_dir):
    return plain(valid_rows(checked(spark, sf_dir)).select(*CHECKED_COLUMNS))


def q3_rejected_rows(spark, sf_dir):
    return plain(rejected_rows(checked(spark, sf_dir)).select(*CHECKED_COLUMNS, "reject_reason"))


# load control

def c1_control_table(spark, sf_dir):
    return plain(K.control_table(silver(spark, sf_dir, *OWNER_STAMPS)))


def c2_split_by_mode(spark, sf_dir):
    full, incremental = K.split_by_mode(athletes(spark, sf_dir), K.control_table(silver(spark, sf_dir, *OWNER_STAMPS)))
    return full.unionByName(incremental).select("athlete_id_json", "full_carga")


def c3_incremental_after(spark, sf_dir):
    early = silver(spark, sf_dir, "sport_type", *OWNER_STAMPS).filter("start_date < DATE '2024-01-03' AND sport_type = 'Run'")
    """Some records have no owner, and the modes do not list the owners of one segment: both load in full."""
    owner = F.when(F.col("event_type") != "error", F.col("user_id"))
    events = table(spark, sf_dir, "events").select("event_id", owner.alias("athlete_id"),
                                                   F.col("ts").cast("timestamp").alias("start_ts"))
    listed = table(spark, sf_dir, "customer").filter("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("athlete_id"))
    owners = events.join(listed, "athlete_id", "left_semi").select(F.col("athlete_id").alias("id")).distinct()
    modes = J.load_mode(owners, K.control_table(early))
    return K.incremental_after(events, modes).select("event_id", "athlete_id")


def c4_pending_ids(spark, sf_dir):
    return K.pending_detail_ids(silver(spark, sf_dir, "id"), details(spark, sf_dir))


QUERIES = {
    f.__name__: f for f in (
        p2_stamps, p3_silver_projection, p4_qualified_projection, p5_owner_split, p6_runs, p7_predicates, p8_since, p9_distinct,
        p10_transform_chain, p11_existence, j1_features, j2_control_join, j3_calorie_report, j4_missing_details,
        j4_orders_without_lines, j5_load_mode, a1_weekly_runs, a2_type_counts, a3_key_uniqueness, a4_reject_report,
        a5_total_count, a6_duplicate_keys, a7_distinct_ids, a8_monthly, a8_elevation_per_km, a8_period_over_period,
        w1_latest_activity, w1_latest_line, w2_last_activity, w3_first_ingestion, w4_best_per_day, o1_newest_first,
        o2_ordinals, o3_top_priced_order, f1_start_date, f2_distance_km, f3_speed_kmh, f4_pace_all_sports,
        f10_periodo_dia, f11_semana_ano_mes, f12_reason_lists, f13_calorie_class, f14_duration_class, f15_unix,
        f16_activity_date, f17_expressions, q1_activity_rules, q2_detail_rules, q3_valid_rows, q3_rejected_rows,
        c1_control_table, c2_split_by_mode, c3_incremental_after, c4_pending_ids)
} | {
    "f4_pace": _silver_columns("pace_min_km"),
    "f5_pace_moving": _silver_columns("pace_min_km_moving_time"),
    "f6_tempo_real": _silver_columns("moving_time", "tempo_real"),
    "f7_pace_new": _silver_columns("pace_min_km_new"),
    "f8_pace_clock": _silver_columns("pace_clock"),
    "f9_dia_semana": _silver_columns("dia_semana"),
}
