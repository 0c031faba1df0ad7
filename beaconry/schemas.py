"""Schemas of the six signals and of their rollups.

Telemetry is columnar with one open string map per row. `severity` is stored by name and compared
by rank; identifiers are lower-case strings; addresses are canonical strings.
"""

from __future__ import annotations

from pyspark.sql.types import (
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

S, TS, L, I = StringType(), TimestampType(), LongType(), IntegerType()
M = MapType(S, S)


def _struct(*fields) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in fields])


# Keys every signal carries.
ENVELOPE = (
    ("tenant_id", S),
    ("resource_id", S),
    ("site_id", S),
    ("observed_at", TS),
    ("ingested_at", TS),
)

SIGNALS: dict[str, StructType] = {
    "logs": _struct(
        *ENVELOPE, ("source_kind", S), ("source_vendor", S), ("severity", S), ("facility", I),
        ("body", S), ("attributes", M), ("host_name", S), ("service_name", S), ("trace_id", S),
        ("span_id", S),
    ),
    "metrics": _struct(*ENVELOPE, ("metric", S), ("value", DoubleType()), ("unit", S), ("labels", M)),
    "events": _struct(
        *ENVELOPE, ("source_kind", S), ("source_vendor", S), ("severity", S),
        ("event_category", S), ("event_type", S), ("summary", S), ("attributes", M),
    ),
    "states": _struct(
        *ENVELOPE, ("severity", S), ("previous_status", S), ("current_status", S), ("reason", S),
        ("attributes", M),
    ),
    "flows": _struct(
        *ENVELOPE, ("started_at", TS), ("src_address", S), ("dst_address", S), ("src_port", I),
        ("dst_port", I), ("protocol", I), ("bytes", L), ("packets", L), ("sampling_rate", L),
        ("tcp_flags", I), ("tos", I), ("input_if", L), ("output_if", L), ("src_as", L),
        ("dst_as", L), ("src_resource_id", S), ("dst_resource_id", S), ("attributes", M),
    ),
    "spans": _struct(
        *ENVELOPE, ("service_id", S), ("trace_id", S), ("span_id", S), ("parent_span_id", S),
        ("name", S), ("kind", S), ("duration_ns", L), ("status_code", S), ("status_message", S),
        ("sampling_probability", FloatType()), ("scope_name", S), ("attributes", M),
    ),
}

# Days each signal's raw rows are kept (fixed values).
RETENTION_DAYS = {"states": 1095, "events": 365, "logs": 365, "metrics": 30, "flows": 7, "spans": 7}

# Severity names from least to most severe (fixed values); a rank is the place in the list from 1.
SEVERITIES = (
    "trace", "debug", "info", "notice", "warn", "error", "critical", "alert", "emergency",
)

# The identifier a row carries when there is no resource, site or service.
NIL_ID = "00000000-0000-0000-0000-000000000000"


def columns(signal: str) -> list[str]:
    """The explicit column list of a signal."""
    return SIGNALS[signal].fieldNames()
