"""Declared schemas of the entities that flow through the layers."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, DataType, StructField, StructType


def struct(**fields: str | DataType) -> StructType:
    """Nullable fields in keyword order; needs no running session."""
    built = StructType()
    for name, kind in fields.items():
        built.add(name, kind)
    return built


_numbers = ArrayType(struct(x="double")["x"].dataType)
_texts = ArrayType(struct(x="string")["x"].dataType)
_owner = struct(id="long", resource_state="long")

# One landed activity document.
ACTIVITY_DOCUMENT = struct(
    achievement_count="long", athlete=_owner, athlete_count="long", average_cadence="double",
    average_heartrate="double", average_speed="double", comment_count="long", commute="boolean",
    display_hide_heartrate_option="boolean", distance="double", elapsed_time="long", elev_high="double",
    elev_low="double", end_latlng=_numbers, external_id="string", flagged="boolean", from_accepted_tag="boolean",
    gear_id="string", has_heartrate="boolean", has_kudoed="boolean", heartrate_opt_out="boolean", id="long",
    kudos_count="long", location_city="string", location_country="string", location_state="string", manual="boolean",
    map=struct(id="string", resource_state="long", summary_polyline="string"), max_heartrate="double",
    max_speed="double", moving_time="long", name="string", photo_count="long", pr_count="long", private="boolean",
    resource_state="long", sport_type="string", start_date="string", start_date_local="string",
    start_latlng=_numbers, suffer_score="double", timezone="string", total_elevation_gain="double",
    total_photo_count="long", trainer="boolean", type="string", upload_id="long", upload_id_str="string",
    utc_offset="long", visibility="string", workout_type="long", average_watts="double", device_watts="boolean",
    kilojoules="double")

# What bronze adds to a document.
BRONZE_EXTRAS = struct(_rescued_data="string", athlete_id="long", ingestion_timestamp="timestamp")

_lap = struct(
    activity=struct(id="long", resource_state="long", visibility="string"), athlete=_owner, average_cadence="double",
    average_heartrate="double", average_speed="double", device_watts="boolean", distance="double",
    elapsed_time="long", end_index="long", id="long", lap_index="long", max_heartrate="double", max_speed="double",
    moving_time="long", name="string", pace_zone="long", resource_state="long", split="long", start_date="string",
    start_date_local="string", start_index="long", total_elevation_gain="double", average_watts="double")
_split = struct(
    average_grade_adjusted_speed="double", average_heartrate="double", average_speed="double", distance="double",
    elapsed_time="long", elevation_difference="double", moving_time="long", pace_zone="long", split="long")
_detail_only = struct(
    available_zones=_texts, best_efforts=_texts, calories="double", description="string", device_name="string",
    embed_token="string", hide_from_home="boolean", laps=ArrayType(_lap), perceived_exertion="double",
    photos=struct(count="long", primary="string", use_primary_photo="boolean"),
    prefer_perceived_exertion="boolean", segment_efforts="string", similar_activities="string",
    splits_metric=ArrayType(_split), splits_standard=ArrayType(_split),
    stats_visibility=ArrayType(struct(type="string", visibility="string")))
_detail_map = StructField("map", struct(id="string", polyline="string", resource_state="long",
                                        summary_polyline="string"))

BRONZE_ACTIVITY = StructType(ACTIVITY_DOCUMENT.fields + BRONZE_EXTRAS.fields)
DETAIL_DOCUMENT = StructType([_detail_map if f.name == "map" else f for f in ACTIVITY_DOCUMENT.fields]
                             + _detail_only.fields)
BRONZE_DETAIL = StructType(DETAIL_DOCUMENT.fields + BRONZE_EXTRAS.fields)

ATHLETE = struct(
    id="long", username="string", resource_state="integer", firstname="string", lastname="string", bio="string",
    city="string", state="string", country="string", sex="string", premium="boolean", summit="boolean",
    created_at="string", updated_at="string", badge_type_id="integer", weight="double", profile_medium="string",
    profile="string", friend="string", follower="string")

CONTROL = struct(
    athlete_id="long", start_date="date", ingestion_timestamp="string", full_carga="boolean", start_date_unix="long",
    ingestion_timestamp_unix="long")

FEATURES = struct(
    athlete_id="long", sport_type="string", calories="double", id_sub_activity="long", achievement_count="long",
    pr_count="long", has_heartrate="boolean", average_heartrate="double", max_heartrate="double", start_date="date",
    start_date_local="string", distance_km="double", average_speed_kmh="double", average_cadence="double",
    total_elevation_gain="double", tempo_real="string", pace_clock="string", dia_semana="string",
    periodo_dia="string", semana="integer", ano="integer", mes_ref="string", intensidade_calorica="string",
    duracao_tipo="string")
FEATURE_PARTITIONS = ("ano", "mes_ref")

RUN_LOG = struct(query="string", batchId="long", inputRows="long", outputRows="long", timestamp="string")

# Columns the batch silver rebuild keeps, in table order.
SILVER_COLUMNS = (
    "achievement_count", "athlete_count", "average_cadence", "average_heartrate", "elev_high", "elev_low",
    "flagged", "has_heartrate", "id", "location_city", "location_country", "location_state", "manual",
    "max_heartrate", "max_speed", "moving_time", "name", "pr_count", "sport_type", "start_date",
    "start_date_local", "timezone", "total_elevation_gain", "type", "workout_type", "athlete_id",
    "ingestion_timestamp", "elapsed_time", "distance_km", "average_speed_kmh", "tempo_real",
    "pace_min_km_moving_time", "pace_min_km", "pace_min_km_new", "pace_clock", "dia_semana",
)
REJECT_COLUMNS = ("reject_reasons", "reject_reason_count", "reject_reason", "reject_timestamp")
