"""Schemas of the records and of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "int": T.IntegerType(),
    "long": T.LongType(),
    "string": T.StringType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
    "map": T.MapType(T.StringType(), T.StringType()),
    "list": T.ArrayType(T.StringType()),
}


def of(fields: str) -> T.StructType:
    """A schema of 'name type' pairs, without a session."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (f.split() for f in fields.split(","))])


RECORD = of(
    "source_row int, work_order_id string, title string, category string, appeal_text string, received_at string,"
    " completed_at string, location string, processing_department string, category_level_1 string, category_level_2 string,"
    " category_level_3 string, category_level_4 string, raw_fields map"
)
#: What normalization makes of a record.
PAYLOAD = of(
    "record_key string, work_order_id string, received_at timestamp, completed_at timestamp, title_raw string,"
    " title_normalized string, appeal_text string, category string, processing_department string, department string,"
    " location string, region string, street string, anchor string, organization_subject string, issue_family string,"
    " event_key string, raw_json map, source_row int"
)
STATE = of("missing_in_latest_upload boolean, last_sync_id string, created_at timestamp, updated_at timestamp")
WORK_ORDERS = T.StructType([*PAYLOAD.fields, *STATE.fields])
#: Of a sync's state beside that: the digest of the record that a row was parsed from, what the sync
#: did to it (null: nothing), and the row before, where that changed.
LOGGED = T.StructType([*WORK_ORDERS.fields, *of("record_d1 long, record_d2 long, sync_action string").fields, T.StructField("row_before", WORK_ORDERS)])
SYNC_RUNS = of(
    "id string, file_name string, file_hash string, status string, total_rows long, inserted_rows long, updated_rows long,"
    " missing_rows long, business_columns list, error_message string, created_at timestamp, completed_at timestamp"
)
VERSIONS = T.StructType([*of("sync_id string, record_key string, action string").fields, T.StructField("before", WORK_ORDERS), T.StructField("after", WORK_ORDERS), T.StructField("created_at", T.TimestampType())])
COMPARISON_RUNS = of(
    "id string, sync_id string, time_field string, target_from timestamp, target_to timestamp, reference_from timestamp,"
    " reference_to timestamp, reference_mode string, status string, target_count long, reference_count long, event_count long,"
    " singleton_count long, missing_time_count long, created_at timestamp"
)
MEMBERS = T.StructType([*of("comparison_id string, event_id long, record_key string, side string, event_key string").fields, T.StructField("snapshot", WORK_ORDERS)])
EVENTS = of("comparison_id string, event_id long, event_key string, event_name string, status string, created_at timestamp")
JOBS = of("id string, kind string, status string, payload string, result_json string, progress int, error_message string, created_at timestamp, started_at timestamp, completed_at timestamp")
OVERRIDES = of("comparison_id string, seq long, kind string, event_id long, record_key string, to_event long, name string")
