"""The same results in plain SQL over the supplied tables, for the side-by-side check."""

from __future__ import annotations

from ..schemas import FEATURES, SILVER_COLUMNS
from .mapping import CHECK_ONLY, COLUMNS, HAS_DETAIL, REDELIVERED

_MAPPED = ", ".join(f"{text} AS {name}" for name, text in [*COLUMNS, *CHECK_ONLY])
# Written out here, so that a wrong predicate in the library does not pass on both sides.
_RULES = [
    ("missing_id", "id is null"), ("missing_start_date", "start_date is null"),
    ("sport_type_missing", "coalesce(sport_type, '') = ''"), ("neg_distance", "distance_km < 0"),
    ("zero_distance_run", "sport_type = 'Run' and distance_km = 0"), ("speed_negative", "average_speed_kmh < 0"),
    ("speed_implausible_run", "sport_type = 'Run' and average_speed_kmh > 30"),
    ("pace_negative", "pace_min_km_new < 0"),
    ("pace_null_when_should", "moving_time > 0 and distance_km > 0 and pace_min_km_new is null"),
]
_DETAIL_RULES = [("missing_id", "id is null"), ("missing_start_date", "athlete_id is null"), ("neg_calories", "calories < 0")]


def rounded(text: str, digits: int) -> str:
    """Half-up rounding of a double's decimal form, the way Spark rounds."""
    return f"cast(round(cast(cast({text} as varchar) as decimal(38, 18)), {digits}) as double)"


def moment(text: str) -> str:
    return f"strftime({text}, '%Y-%m-%d %H:%M:%S.%f')"


def reasons(rules: list[tuple[str, str]]) -> str:
    return "concat_ws('|', " + ", ".join(f"case when {test} then '{name}' end" for name, test in rules) + ")"


def latest(source: str, keys: str, order: str) -> str:
    return (f"select * exclude (rn) from (select *, row_number() over (partition by {keys} order by {order}) as rn"
            f" from {source}) where rn = 1")


DELIVERED = ("delivered as (select *, 0 as redelivery from events union all"
             f" select *, 1 as redelivery from events where {REDELIVERED})")
BRONZE = f"{DELIVERED}, bronze as (select {_MAPPED}, redelivery from delivered)"
DETAILS = f"bronze_details as (select {_MAPPED}, redelivery from delivered where {HAS_DETAIL})"

DATE = "cast(try_strptime(start_date, '%Y-%m-%dT%H:%M:%SZ') as date)"
DERIVED_ONE = f"""select * exclude (start_date), {DATE} as start_date,
  {rounded("distance / 1000e0", 2)} as distance_km,
  {rounded("average_speed * 3.6e0", 2)} as average_speed_kmh,
  case when type = 'Run' then {rounded("(elapsed_time / 60e0) / nullif(distance / 1000e0, 0)", 2)} else 0e0 end
    as pace_min_km,
  case when type = 'Run' then {rounded("(moving_time / 60e0) / nullif(distance / 1000e0, 0)", 2)} else 0e0 end
    as pace_min_km_moving_time,
  case when moving_time is not null then printf('%02d:%02d:%02d', moving_time // 3600, (moving_time % 3600) // 60,
    moving_time % 60) end as tempo_real,
  case when distance > 0 then {rounded("(moving_time / 60e0) / (distance / 1000e0)", 3)} else 0e0 end
    as pace_min_km_new"""
DERIVED_TWO = f"""select *, strftime(start_date, '%a') as dia_semana,
  cast(floor(pace_min_km_new) as bigint) as pace_minutes,
  cast({rounded("(pace_min_km_new - floor(pace_min_km_new)) * 60e0", 0)} as bigint) as pace_seconds"""
DERIVED_THREE = """select * exclude (pace_minutes, pace_seconds),
  case when pace_seconds is not null then printf('%d:%02d', pace_minutes + case when pace_seconds >= 60 then 1 else 0 end,
    pace_seconds % 60) end as pace_clock"""


def derived(name: str, source: str) -> str:
    return (f"{name}_1 as ({DERIVED_ONE} from ({source})), {name}_2 as ({DERIVED_TWO} from {name}_1),"
            f" {name} as ({DERIVED_THREE} from {name}_2)")


STREAM_KEYS, BATCH_KEYS = "athlete_id, id", "athlete_id, id, start_date"
NEWEST = "ingestion_timestamp desc nulls last"
# silver rebuilt in batch, and detail rows in silver form
SILVER = BRONZE + ", " + derived("silver", latest("(select * from bronze where athlete_id is not null)",
                                                  BATCH_KEYS, NEWEST))
SILVER_DETAILS = (DETAILS + ", details as (select * exclude (start_date), " + DATE + " as start_date from ("
                  + latest("(select * from bronze_details where athlete_id is not null)", BATCH_KEYS, NEWEST) + "))")
# one incremental batch over everything, annotated
CHECKED = (BRONZE + ", " + derived("checked_rows", latest("bronze", STREAM_KEYS, NEWEST))
           + f", checked as (select *, nullif({reasons(_RULES)}, '') as reject_reason from checked_rows)")
# two incremental batches: first deliveries, then second ones
TWO_BATCHES = (BRONZE
               + ", " + derived("one_rows", latest("(select * from bronze where redelivery = 0)", STREAM_KEYS, NEWEST))
               + ", " + derived("two_rows", latest("(select * from bronze where redelivery = 1)", STREAM_KEYS, NEWEST))
               + f", one as (select *, nullif({reasons(_RULES)}, '') as reject_reason from one_rows)"
               + f", two as (select *, nullif({reasons(_RULES)}, '') as reject_reason from two_rows)"
               + ", merged as (select * from one where reject_reason is null union all"
                 " select * from two where reject_reason is null and not exists (select 1 from one where"
                 " one.reject_reason is null and one.athlete_id is not distinct from two.athlete_id"
                 " and one.id is not distinct from two.id and one.start_date is not distinct from two.start_date))")

# the newest valid delivery of every activity
NEWEST_VALID = (BRONZE + ", " + derived("every", "select * from bronze")
                + f", valid as (select * from every where {reasons(_RULES)} = ''), newest_valid as ("
                + latest("valid", STREAM_KEYS, NEWEST) + ")")


def shown(columns) -> str:
    special = {"start_date": "cast(start_date as varchar) as start_date",
               "ingestion_timestamp": f"{moment('ingestion_timestamp')} as ingestion_timestamp"}
    return ", ".join(special.get(c, c) for c in columns)


_LOCAL = "strptime(a.start_date_local, '%Y-%m-%dT%H:%M:%SZ')"
PERIOD = f"case when hour({_LOCAL}) < 12 then 'manhã' when hour({_LOCAL}) < 18 then 'tarde' else 'noite' end"
WEEK = f"cast(weekofyear({_LOCAL}) as integer)"
YEAR = f"cast(year({_LOCAL}) as integer)"
MONTH = f"strftime({_LOCAL}, '%b/%Y')"
MINUTES = "cast(split_part(a.tempo_real, ':', 1) as bigint) * 60 + cast(split_part(a.tempo_real, ':', 2) as bigint)"
DURATION = f"case when {MINUTES} >= 60 then 'longa' when {MINUTES} >= 30 then 'média' else 'curta' end"


def effort(calories: str, null_is_light: bool) -> str:
    last = "else 'leve' end" if null_is_light else f"when {calories} < 300 then 'leve' end"
    return f"case when {calories} >= 600 then 'alta' when {calories} >= 300 then 'moderada' {last}"


_FEATURE_TEXT = {"calories": "b.calories", "id_sub_activity": "b.id as id_sub_activity",
                 "start_date": "cast(a.start_date as varchar) as start_date", "periodo_dia": f"{PERIOD} as periodo_dia",
                 "semana": f"{WEEK} as semana", "ano": f"{YEAR} as ano", "mes_ref": f"{MONTH} as mes_ref",
                 "intensidade_calorica": f"{effort('b.calories', False)} as intensidade_calorica",
                 "duracao_tipo": f"{DURATION} as duracao_tipo"}
FEATURE_LIST = ", ".join(_FEATURE_TEXT.get(c, f"a.{c}") for c in FEATURES.names)
FEATURE_JOIN = ("left join (" + latest("details", STREAM_KEYS, NEWEST)
                + ") b on a.id = b.id and a.athlete_id = b.athlete_id")

BEST = ("best as (" + latest("(select *, cast(strptime(start_date_local, '%Y-%m-%dT%H:%M:%SZ') as date) as activity_date"
                             " from details)", "activity_date, sport_type",
                             "calories desc nulls last, achievement_count desc nulls last,"
                             " elapsed_time desc nulls last, id desc nulls last") + ")")
FINAL = "chosen as (select sport_type, id, calories from best where calories > 0)"
CONTROL = """control as (select athlete_id, max(start_date) as start_date,
  case when count(*) = count(ingestion_timestamp) then min(ingestion_timestamp) end as ingestion_timestamp,
  false as full_carga from silver where athlete_id is not null group by athlete_id)"""
CONTROL_COLUMNS = f"""athlete_id, cast(start_date as varchar) as start_date,
  {moment('ingestion_timestamp')} as ingestion_timestamp, full_carga,
  cast(epoch(start_date) as bigint) as start_date_unix,
  cast(floor(epoch(ingestion_timestamp)) as bigint) as ingestion_timestamp_unix"""

_WEEKLY = f"""cast(year(start_date) as integer) as year, cast(weekofyear(start_date) as integer) as week,
  count(*) as total_activities,
  {rounded("cast(sum(cast(round(distance_km * 100) as bigint)) as double) / 100e0", 2)} as total_distance_km,
  {rounded("sum(total_elevation_gain)", 2)} as total_elevation_gain,
  {rounded("(cast(sum(cast(round(pace_min_km * 100) as bigint)) as double) / 100e0) / count(pace_min_km)", 2)}
    as avg_pace_min_km,
  {rounded("(cast(sum(cast(round(average_speed_kmh * 100) as bigint)) as double) / 100e0) / count(average_speed_kmh)", 2)}
    as avg_speed_kmh"""
WEEKLY = f"weekly as (select {_WEEKLY} from silver where sport_type = 'Run' group by 1, 2)"
_KM = "(cast(sum(cast(round(distance_km * 100) as bigint)) as double) / 100e0)"
MONTHLY = f"""select cast(cast(date_trunc('month', start_date) as date) as varchar) as month, sport_type,
  count(*) as total_activities, {rounded(_KM, 2)} as total_distance_km,
  {rounded("sum(total_elevation_gain)", 2)} as total_elevation_gain,
  case when {_KM} > 0 then {rounded(f"sum(total_elevation_gain) / {_KM}", 2)} end as elevation_gain_per_km
  from silver group by date_trunc('month', start_date), sport_type"""

_ORDER_UPSERT = """
base as (select case when o_orderpriority = '5-LOW' then null else o_orderkey end as o_orderkey, o_custkey,
    o_totalprice, o_orderpriority, cast(o_orderdate as date) as o_day, o_orderstatus as status,
    cast(year(o_orderdate) as integer) as year from orders),
old as (select * from base where o_day < date '1998-01-01'),
fresh as (select * replace (o_totalprice * 2 as o_totalprice,
    case when o_orderpriority = '1-URGENT' then 'U' else status end as status) from base
    where o_day >= date '1997-06-01')"""

_NEW_ORDERS = """with old as (select o_orderkey, o_custkey, o_totalprice, o_orderdate from orders
    where o_orderdate < timestamp '1997-01-01')
 select o_orderkey, o_custkey, o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f') as o_orderdate from old
 union all select o_orderkey, o_custkey, o_totalprice * 2, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f') from orders
 where not exists (select 1 from old where old.o_orderkey = orders.o_orderkey and old.o_custkey = orders.o_custkey)"""


def oracle_sql() -> dict[str, str]:
    silver, stream = f"with {SILVER}", f"with {CHECKED}"
    both = f"with {SILVER}, {SILVER_DETAILS}"
    bronze = f"with {BRONZE}"
    features_all = f"{both} select {FEATURE_LIST} from silver a {FEATURE_JOIN}"
    line_order = ", ".join(f"{c} desc nulls last" for c in
                           ("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
                            "l_tax", "l_returnflag", "l_linestatus"))
    silver_plain = shown([c for c in SILVER_COLUMNS])
    valid_columns = shown(["id", "athlete_id", "start_date", "sport_type", "distance_km", "average_speed_kmh",
                           "pace_min_km", "pace_min_km_moving_time", "tempo_real", "pace_min_km_new", "pace_clock",
                           "dia_semana"])
    control_modes = ("select c_custkey as athlete_id_json, athlete_id, cast(start_date as varchar) as start_date,"
                     " coalesce(full_carga, true) as full_carga from customer left join control on"
                     " c_custkey = athlete_id")
    return {
        # sources
        "s1_bronze_stream": "select event_id as id, user_id as athlete_id, event_type, value from events",
        "s1_bronze_rescue":
            "select case when event_type <> 'error' then event_id end as id, user_id as athlete_id, event_type, value,"
            " concat('{\"VARIANT\":', cast(event_id as varchar), case when event_type = 'error' then"
            " ',\"id\":99999999999999999999' else '' end, '}') as _rescued_data from events union all"
            " select null, null, null, null, concat('{broken ', cast(event_id as varchar)) from events"
            " where event_type = 'error'",
        "s1_array_rescue":
            "select event_id as id, user_id as athlete_id, event_id % 7 + 0.5e0 as km, user_id as x, case when event_type"
            " = 'error' then concat('{\"laps\":[', " + ", ',', ".join(
                f"""'{{"at":{{"x":', user_id, ',"y":', event_id, '}},"km":', event_id % 7 + 0.5e0, ',"lap":{k}{"" if k == 1 else ',"pulse":'}'{
                    "" if k == 1 else ", event_id % 100"}, '}}'""" for k in (1, 2))
            + ", ']}') end as _rescued_data from events",
        "s2_array_evolution":
            "select event_id as id, cast(lap as bigint) as lap, event_id % 7 + 0.5e0 as km, case when event_type = 'error' and"
            " lap = 2 then event_id % 100 end as pulse, user_id as x, case when event_type = 'error' then event_id end as y,"
            " cast(null as varchar) as _rescued_data from events, (values (1), (2)) l(lap)",
        "s2_schema_evolution":
            "select case when event_type = 'error' then null else event_id end as id, user_id as athlete_id, event_type"
            " as kind, case when event_type in ('view', 'click') then null else value end as value,"
            " case when event_type = 'error' then event_id end as \"VARIANT\","
            " case when event_type = 'error' then '99999999999999999999' end as big,"
            " case when event_type = 'error' then concat('{\"id\":\"E', cast(event_id as varchar), '\"}') end"
            " as _rescued_data from events union all select null, null, null, null, null, null,"
            " concat('{broken ', cast(event_id as varchar)) from events where event_type = 'error'",
        "s3_stream_from_table": "select event_id, user_id, event_type, value from events",
        "s4_table_scan": "select o_orderkey, o_orderstatus, o_totalprice from orders",
        "s5_json_documents":
            "select c_custkey as id, c_name as username, c_mktsegment as bio, c_acctbal as weight,"
            " cast(null as varchar) as country from customer",
        "s6_csv_scan": f"{silver}, {CONTROL} select {CONTROL_COLUMNS} from control",
        "s7_stream_view_sql": "select user_id as athlete_id, event_id as id, upper(event_type) as kind from events",
        "s8_catalog_top_n": "select o_orderkey, o_custkey, o_totalprice from orders"
                            " order by o_totalprice desc, o_orderkey limit 10",
        # sinks
        "k2_recovered_log": "select 'bronze_loader' as query, count(*) as input_rows, count(*) as output_rows from events",
        "k2_run_log": "select 'bronze_loader' as query, count(*) as input_rows, count(*) as output_rows from events",
        "k4_append": f"{bronze} select id, sport_type, {moment('ingestion_timestamp')} as ingestion_timestamp"
                     " from bronze where athlete_id is null",
        "k5_overwrite_schema": f"{silver} select {silver_plain} from silver",
        "k6_overwrite_table": f"{silver}, {CONTROL} select {CONTROL_COLUMNS} from control",
        "k7_external_table": f"{bronze} select count(*) as total, count(id) as with_id from bronze",
        "k8_partitioned_table": f"{both} select {FEATURE_LIST} from silver a {FEATURE_JOIN}",
        "k9_create_as_select": f"{both}, {BEST}, {FINAL} select sport_type, id, calories from chosen",
        "k10_csv_export": f"{silver}, {CONTROL} select {CONTROL_COLUMNS} from control",
        "k11_typed_insert": "select event_id as id, user_id as athlete_id, concat('map', cast(event_id as varchar))"
                            " as map_id, cast(2 as integer) as points, value as first_point from events",
        "k12_maintenance": "select event_id as id, concat('kept ', event_type) as note from events",
        "k13_archive": "select event_id as id, event_type, event_type <> 'error' as archived from events",
        # projections and filters
        "p1_nested_owner": f"{bronze} select id, athlete_id from bronze where redelivery = 0",
        "p2_stamps": f"{bronze} select id, true as stamped, true as same_stamp from bronze",
        "p3_silver_projection": f"{silver} select {silver_plain} from silver",
        "p4_qualified_projection": f"{both} select a.id, a.athlete_id, a.sport_type, a.distance_km, b.calories, b.id as"
                                   f" id_sub_activity from silver a {FEATURE_JOIN}",
        "p5_owner_split": f"{bronze} select id, athlete_id, athlete_id is null as is_error from bronze",
        "p6_runs": f"{silver} select id, distance_km from silver where sport_type = 'Run'",
        "p7_predicates": f"{silver} select id, name, cast(start_date as varchar) as start_date from silver"
                         " where type = 'Run' and (name in ('Session 7', 'Session 21')"
                         " or start_date = date '2024-01-10')",
        "p8_since": f"{silver} select id, cast(start_date as varchar) as start_date from silver"
                    " where start_date >= date '2024-01-15'",
        "p9_distinct": f"{bronze} select distinct id from bronze",
        "p10_transform_chain": f"{stream} select {valid_columns} from checked",
        "p11_existence": f"{stream} select count(*) > 0 as has_rejects from checked where reject_reason is not null",
        # joins and merges
        "j1_features": features_all,
        "j2_control_join": f"{silver}, {CONTROL} select athlete_id, cast(start_date as varchar) as start_date,"
                           f" {moment('ingestion_timestamp')} as ingestion_timestamp, full_carga from control",
        "j3_calorie_report":
            f"{both}, {BEST}, {FINAL} select a.athlete_id, a.sport_type, b.calories, a.achievement_count, a.pr_count,"
            " a.has_heartrate, a.average_heartrate, a.max_heartrate, cast(a.start_date as varchar) as start_date,"
            " a.start_date_local, a.distance_km, a.average_speed_kmh, a.average_cadence, a.total_elevation_gain,"
            f" a.tempo_real, a.pace_clock, a.dia_semana, {PERIOD} as periodo_dia, {WEEK} as semana, {YEAR} as ano,"
            f" {effort('b.calories', True)} as intensidade_calorica, {DURATION} as duracao_tipo, {MONTH} as mes_ref"
            " from silver a join chosen b on a.id = b.id where a.start_date >= date '2024-01-05'",
        "j4_missing_details": f"{both} select distinct a.id from silver a left join details b on a.id = b.id"
                              " where b.id is null",
        "j4_orders_without_lines": "select distinct o_orderkey as id from orders left join lineitem"
                                   " on o_orderkey = l_orderkey where l_orderkey is null",
        "j5_load_mode": f"{silver}, {CONTROL} {control_modes}",
        "j6_merge_insert": _NEW_ORDERS,
        "j7_merge_upsert":
            f"with {_ORDER_UPSERT} select o_orderkey, o_custkey, o_totalprice, o_orderpriority,"
            " cast(o_day as varchar) as o_day, status, year from (select * from old where o_orderkey is null or"
            " o_orderkey not in (select o_orderkey from fresh where o_orderkey is not null)"
            " union all select * from fresh)",
        "j7_packed_upsert":
            f"with {_ORDER_UPSERT} select o_orderkey, o_custkey, o_totalprice, o_orderpriority,"
            " cast(o_day as varchar) as o_day, status, year from (select * from old where o_orderkey is null or"
            " o_orderkey not in (select o_orderkey from fresh where o_orderkey is not null)"
            " union all select * from fresh)",
        # aggregates
        "a1_weekly_runs": f"{silver}, {WEEKLY} select * from weekly",
        "a1_weekly_batches": f"with {NEWEST_VALID}, silver as (select * from newest_valid), {WEEKLY} select * from weekly",
        "a2_type_counts": f"{silver} select type, count(*) as total from silver group by type",
        "a3_key_uniqueness": f"{silver} select count(id) as total, count(distinct id) as distinct_total from silver",
        "a4_reject_report": f"{stream} select reject_reason, cast(cast(ingestion_timestamp as date) as varchar) as dt, count(*) as total"
                            " from checked where reject_reason is not null group by 1, 2",
        "a5_total_count": "select count(*) as total from lineitem",
        "a6_duplicate_keys": "select l_orderkey, l_linenumber, count(*) as total from lineitem"
                             " group by l_orderkey, l_linenumber having count(*) > 1",
        "a7_distinct_ids": f"{bronze} select distinct id as id_activity from bronze where id is not null",
        "a8_monthly": f"{silver} {MONTHLY}",
        "a8_monthly_batches": f"with {TWO_BATCHES}, silver as (select * from merged) {MONTHLY}",
        "a8_elevation_per_km":
            f"{silver} select id, athlete_id, case when distance_km > 0 then"
            f" {rounded('total_elevation_gain / distance_km', 2)} end as elevation_gain_per_km from silver",
        "a8_period_over_period":
            f"{silver}, {WEEKLY}, lagged as (select year, week, total_activities, total_distance_km,"
            " lag(total_activities) over w as previous_total_activities,"
            " lag(total_distance_km) over w as previous_total_distance_km from weekly window w as"
            " (order by year nulls first, week nulls first)) select *, total_activities - previous_total_activities"
            f" as change_total_activities, {rounded('total_distance_km - previous_total_distance_km', 2)}"
            " as change_total_distance_km from lagged",
        # windows
        "w1_latest_activity": f"{bronze} select id, athlete_id, start_date, distance,"
                              f" {moment('ingestion_timestamp')} as ingestion_timestamp from ("
                              + latest("bronze", STREAM_KEYS, NEWEST) + ")",
        "w1_latest_line": "select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,"
                          " l_discount, l_tax, l_returnflag, l_linestatus, "
                          + moment("l_shipdate") + " as l_shipdate from ("
                          + latest("lineitem", "l_orderkey, l_linenumber", line_order) + ")",
        "w2_last_activity": f"{silver} select athlete_id, cast(start_date as varchar) as start_date from ("
                            + latest("silver", "athlete_id", "start_date desc nulls last") + ")",
        "w3_first_ingestion": f"{silver} select athlete_id, {moment('ingestion_timestamp')} as ingestion_timestamp"
                              " from (" + latest("silver", "athlete_id", "ingestion_timestamp asc nulls first") + ")",
        "w4_best_per_day": f"{both}, {BEST} select id, athlete_id, sport_type,"
                           " cast(activity_date as varchar) as activity_date, calories, achievement_count,"
                           " elapsed_time from best",
        # order
        "o1_newest_first": f"{bronze} select id, {moment('ingestion_timestamp')} as ingestion_timestamp from bronze",
        "o2_ordinals": f"{bronze} select sport_type, cast(ingestion_timestamp as date)::varchar as day,"
                       " count(*) as total from bronze group by 1, 2",
        "o3_top_priced_order": "select o_custkey, o_orderkey, o_totalprice from ("
                               + latest("orders", "o_custkey", "o_totalprice desc nulls last, o_orderkey desc") + ")",
        # functions
        "f1_start_date": f"{bronze} select id, start_date as text, cast({DATE} as varchar) as start_date from bronze",
        "f2_distance_km": f"{silver} select id, athlete_id, distance, distance_km from silver",
        "f3_speed_kmh": f"{silver} select id, athlete_id, average_speed, average_speed_kmh from silver",
        "f4_pace": f"{silver} select id, athlete_id, pace_min_km from silver",
        "f4_pace_all_sports":
            f"{bronze} select id, case when distance > 0 then"
            f" {rounded('(elapsed_time / 60e0) / (distance / 1000e0)', 2)} end as pace_min_km from bronze",
        "f5_pace_moving": f"{silver} select id, athlete_id, pace_min_km_moving_time from silver",
        "f6_tempo_real": f"{silver} select id, athlete_id, moving_time, tempo_real from silver",
        "f7_pace_new": f"{silver} select id, athlete_id, pace_min_km_new from silver",
        "f8_pace_clock": f"{silver} select id, athlete_id, pace_clock from silver",
        "f9_dia_semana": f"{silver} select id, athlete_id, dia_semana from silver",
        "f10_periodo_dia": f"{silver} select a.id, a.start_date_local, {PERIOD} as periodo_dia from silver a",
        "f11_semana_ano_mes": f"{silver} select a.id, {WEEK} as semana, {YEAR} as ano, {MONTH} as mes_ref from silver a",
        "f12_reason_lists": f"{stream} select id, athlete_id, reject_reason, case when reject_reason is null then 0 else"
                            " cast(length(reject_reason) - length(replace(reject_reason, '|', '')) + 1 as integer) end"
                            " as reject_reason_count from checked",
        "f13_calorie_class": f"{both} select id, calories, {effort('calories', False)} as intensidade_calorica"
                             " from details",
        "f14_duration_class": f"{silver} select a.id, a.tempo_real, {DURATION} as duracao_tipo from silver a",
        "f15_unix": f"{silver} select id, athlete_id, cast(epoch(start_date) as bigint) as start_date_unix,"
                    " cast(floor(epoch(ingestion_timestamp)) as bigint) as ingestion_timestamp_unix from silver",
        "f16_activity_date": f"{bronze} select id, cast(cast(strptime(start_date_local, '%Y-%m-%dT%H:%M:%SZ') as date)"
                             " as varchar) as activity_date from bronze",
        "f17_expressions": f"{bronze} select id, false as full_carga, coalesce(workout_type, -1) as workout,"
                           " cast(distance as bigint) as whole_metres, case when manual then 'manual' else 'device' end"
                           " as origin, athlete_id as owner_id, start_date as first_text from bronze",
        # quality
        "q1_activity_rules": f"{stream} select id, athlete_id, reject_reason from checked"
                             " where reject_reason is not null",
        "q2_detail_rules":
            f"{bronze}, {DETAILS} select id, athlete_id, nullif({reasons(_DETAIL_RULES)}, '') as reject_reason from ("
            + latest("bronze_details", STREAM_KEYS, NEWEST) + ")",
        "q3_valid_rows": f"{stream} select {valid_columns} from checked where reject_reason is null",
        "q3_rejected_rows": f"{stream} select {valid_columns}, reject_reason from checked"
                            " where reject_reason is not null",
        "q4_stored_rejects": f"{stream} select id, athlete_id, reject_reason from checked"
                             " where reject_reason is not null",
        # streaming
        "t2_restarted_stream": "select event_id, event_type from events",
        "t3_any_order": features_all,
        "t3_feature_stream": f"with {TWO_BATCHES}, {SILVER_DETAILS}"
                             f" select {FEATURE_LIST} from merged a {FEATURE_JOIN}",
        "t4_silver_stream": f"with {TWO_BATCHES} select {valid_columns} from merged",
        "t4_newest_stream": f"with {NEWEST_VALID} select {valid_columns} from newest_valid",
        "t4_detail_stream":
            f"{bronze}, {DETAILS} select id, athlete_id, cast({DATE} as varchar) as start_date, calories from ("
            + latest("bronze_details", STREAM_KEYS, NEWEST) + ") where id is not null and athlete_id is not null"
            " and (calories >= 0 or calories is null)",
        "t4_stream_rejects": f"with {TWO_BATCHES} select id, athlete_id, reject_reason from one"
                             " where reject_reason is not null union all select id, athlete_id, reject_reason"
                             " from two where reject_reason is not null",
        # load control
        "c1_control_table": f"{silver}, {CONTROL} select {CONTROL_COLUMNS} from control",
        "c1_control_batches": f"{silver}, {CONTROL} select {CONTROL_COLUMNS} from control",
        "c2_split_by_mode": f"{silver}, {CONTROL}, modes as ({control_modes})"
                            " select athlete_id_json, full_carga from modes",
        "c3_incremental_after":
            f"{silver}, early as (select athlete_id, max(start_date) as mark from silver"
            " where start_date < date '2024-01-03' and sport_type = 'Run' group by athlete_id)"
            " select event_id, owner as athlete_id from (select *, case when event_type <> 'error' then user_id end as owner"
            " from events) left join early on owner = athlete_id and owner in (select c_custkey from customer"
            " where c_mktsegment <> 'BUILDING')"
            " where mark is null or floor(epoch(ts)) > epoch(mark)",
        "c4_pending_ids": f"{both} select distinct id as id_activity from silver where id is not null"
                          " and id not in (select id from details where id is not null)",
    }
