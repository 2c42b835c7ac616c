"""Logical schemas. Timestamps are TIMESTAMP_NTZ (UTC wall clock) in storage; streams read them as TIMESTAMP."""

from __future__ import annotations

from pyspark.sql.types import (
    BooleanType, DataType, DateType, DecimalType, DoubleType, IntegerType, LongType, StringType, StructField, StructType,
    TimestampNTZType, VariantType,
)

STRING, BIGINT, INT, DOUBLE = StringType(), LongType(), IntegerType(), DoubleType()
BOOLEAN, DATE, TIMESTAMP, VARIANT = BooleanType(), DateType(), TimestampNTZType(), VariantType()
CREDITS, CLOUD_CREDITS = DecimalType(18, 2), DecimalType(18, 4)


def _schema(**columns: DataType) -> StructType:
    return StructType([StructField(name, kind) for name, kind in columns.items()])


METERING_HISTORY = _schema(
    warehouse_name=STRING, start_time=TIMESTAMP, credits_used=CREDITS,
)

QUERY_HISTORY = _schema(
    query_id=STRING, query_text=STRING, warehouse_name=STRING, warehouse_size=STRING, user_name=STRING,
    query_tag=STRING, start_time=TIMESTAMP, end_time=TIMESTAMP, execution_status=STRING, error_code=STRING,
    error_message=STRING, total_elapsed_time=BIGINT, execution_time=BIGINT, compilation_time=BIGINT,
    queued_overload_time=BIGINT, queued_provisioning_time=BIGINT, credits_used_cloud_services=CLOUD_CREDITS,
)

EVENTS_HISTORY = _schema(
    warehouse_name=STRING, timestamp=TIMESTAMP, event_name=STRING, event_reason=STRING,
)

LOAD_HISTORY = _schema(
    warehouse_name=STRING, start_time=TIMESTAMP, avg_running=DOUBLE, avg_queued_load=DOUBLE,
    avg_blocked=DOUBLE,
)

TAG_REFERENCES = _schema(
    object_name=STRING, domain=STRING, tag_name=STRING, tag_value=STRING,
)

RATE_SHEET_DAILY = _schema(
    date=DATE, service_type=STRING, usage_type=STRING, effective_rate=DOUBLE,
)

USAGE_IN_CURRENCY_DAILY = _schema(
    usage_date=DATE, usage_type=STRING, usage=DOUBLE, usage_in_currency=DOUBLE,
)

HOURLY_METERING = _schema(
    warehouse_name=STRING, hour_ts=TIMESTAMP, credits=DOUBLE, tag_cost_center=STRING, _loaded_at=TIMESTAMP,
)

HOURLY_QUERIES = _schema(
    warehouse_name=STRING, hour_ts=TIMESTAMP, query_count=BIGINT, avg_elapsed_ms=DOUBLE, p95_elapsed_ms=DOUBLE,
    total_queue_ms=DOUBLE, queued_queries=BIGINT, failed_queries=BIGINT, total_elapsed_failed_ms=DOUBLE,
    complex_queries=BIGINT, latency_stddev=DOUBLE, _loaded_at=TIMESTAMP,
)

HOURLY_EVENTS = _schema(
    warehouse_name=STRING, hour_ts=TIMESTAMP, event_name=STRING, event_count=BIGINT, _loaded_at=TIMESTAMP,
)

AUDIT_LOG = _schema(
    event_id=STRING, event_timestamp=TIMESTAMP, username=STRING, role_name=STRING, session_id=BIGINT,
    event_type=STRING, event_detail=VARIANT, warehouse_name=STRING, ip_address=STRING,
)

MIGRATION_REQUESTS = _schema(
    request_id=STRING, created_at=TIMESTAMP, requested_by=STRING, requested_role=STRING, warehouse_name=STRING,
    current_type=STRING, target_type=STRING, justification=STRING, assessment_score=DOUBLE,
    estimated_savings=DOUBLE, status=STRING, reviewed_by=STRING, reviewed_at=TIMESTAMP, review_notes=STRING,
    executed_at=TIMESTAMP, rollback_at=TIMESTAMP,
)

WORKLOAD_SLA = _schema(
    sla_id=STRING, workload_class=STRING, warehouse_pattern=STRING, max_p95_latency_sec=DOUBLE,
    max_queue_sec=DOUBLE, max_error_rate_pct=DOUBLE, priority=INT, escalation_contact=STRING,
    created_at=TIMESTAMP, created_by=STRING, is_active=BOOLEAN,
)

SLA_BREACHES = _schema(
    breach_id=STRING, detected_at=TIMESTAMP, warehouse_name=STRING, workload_class=STRING, breach_type=STRING,
    sla_threshold=DOUBLE, actual_value=DOUBLE, breach_window=TIMESTAMP, severity=STRING, acknowledged=BOOLEAN,
    acknowledged_by=STRING, resolution_notes=STRING,
)

REGULATORY_CALENDAR = _schema(
    calendar_id=STRING, event_name=STRING, event_type=STRING, start_date=DATE, end_date=DATE,
    affected_warehouses=STRING, expected_spike_factor=DOUBLE, suppress_anomaly=BOOLEAN, notes=STRING,
    created_by=STRING, created_at=TIMESTAMP,
)

GL_CODE_MAPPING = _schema(
    mapping_id=STRING, warehouse_name=STRING, gl_code=STRING, cost_center=STRING, department=STRING,
    business_line=STRING, allocation_pct=DOUBLE, effective_from=DATE, effective_to=DATE, approved_by=STRING,
    created_at=TIMESTAMP, created_by=STRING,
)

REGION_SUPPORT = _schema(
    cloud_provider=STRING, region=STRING, region_display=STRING, adaptive_ga=BOOLEAN, adaptive_preview=BOOLEAN,
    last_verified=DATE, notes=STRING,
)

MIGRATION_LOG = _schema(
    migration_id=STRING, warehouse_name=STRING, action=STRING, previous_type=STRING, new_type=STRING,
    previous_size=STRING, migrated_by=STRING, migrated_at=TIMESTAMP, baseline_credits_7d=DOUBLE, notes=STRING,
)
