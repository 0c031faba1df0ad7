"""Raw lines, requests and readings to rows; security events."""

from __future__ import annotations

from pyspark.sql import functions as F

from beaconry.functions.scalars import initial_ttl, ip_scope, protocol_name, ttl_hops
from beaconry.operators import security
from beaconry.plans.registry import query
from beaconry.sources import devices, otlp, syslog

# --- syslog: checked against the parts the lines were made of ---

_NAMES = "['emergency','alert','critical','error','warn','notice','info','debug']"
_READ = "shape IN (0, 1, 2, 3, 4, 5, 8, 9)"
_PARSED = f"""SELECT p.event_id,
    CASE WHEN {_READ} THEN pri // 8 ELSE 1 END AS facility, CASE WHEN {_READ} THEN {_NAMES}[pri % 8 + 1] ELSE 'notice' END AS severity,
    CASE WHEN shape IN (0, 1, 2, 3, 4, 9) THEN epoch_ms(stamp) END AS timestamp,
    CASE WHEN shape IN (0, 1, 2, 3, 4, 9) THEN host END AS hostname,
    CASE WHEN shape IN (0, 1, 3, 4) THEN app END AS app_name, CASE WHEN shape IN (0, 3) THEN pid END AS proc_id,
    CASE WHEN shape = 3 THEN msgid END AS msg_id,
    CASE WHEN shape = 3 THEN 'b@1.n=' || pid || ';ex@32473.path=a]b;ex@32473.user=' || msgid ELSE '' END AS structured,
    CASE WHEN shape = 9 THEN '' WHEN shape = 7 THEN '<0' || pri || '>' || msg WHEN shape = 8 THEN 'yesterday at noon ' || msg ELSE msg END AS message,
    CASE shape WHEN 6 THEN 'no priority' WHEN 7 THEN 'no priority' WHEN 8 THEN 'rfc3164: unreadable timestamp' WHEN 9 THEN 'rfc5424: header ended early' END AS parse_error
    FROM syslog_parts AS p"""
_FIELDS = [
    "event_id", "facility", "severity", "timestamp", "hostname", "app_name", "proc_id", "msg_id", "structured", "message",
    "parse_error",
]

query("parse_syslog", _PARSED)(lambda t: syslog.parse_syslog(t.syslog_lines).select(*_FIELDS))
query("parse_syslog_3164", f"{_PARSED} WHERE shape IN (0, 1, 2, 8)")(
    lambda t: syslog.parse_syslog(t.syslog_lines.where("NOT line RLIKE '^<[0-9]+>[1-9] ' AND line RLIKE '^<(0|[1-9][0-9]{0,2})>'")).select(*_FIELDS)
)
query("parse_syslog_5424", f"{_PARSED} WHERE shape IN (3, 4, 5, 9)")(
    lambda t: syslog.parse_syslog(t.syslog_lines.where("line RLIKE '^<[0-9]+>[1-9] '")).select(*_FIELDS)
)
query(
    "syslog_to_logs",
    f"""WITH parsed AS ({_PARSED}) SELECT q.event_id, coalesce(timestamp, epoch_ms(received_at)) AS observed_at, epoch_ms(received_at) AS ingested_at,
        severity, facility, message AS body, coalesce(hostname, '') AS host_name, coalesce(app_name, '') AS service_name,
        array_to_string(list_sort(list_filter(['host.name=' || hostname, 'service.name=' || app_name, 'process.pid=' || proc_id,
          'syslog.facility=' || facility, 'syslog.msgid=' || msg_id, 'syslog.source.address=' || peer, 'parse.error=' || parse_error,
          CASE WHEN timestamp IS NULL THEN 'syslog.timestamp.missing=true' END,
          CASE WHEN shape = 3 THEN 'syslog.sd.b@1.n=' || pid END, CASE WHEN shape = 3 THEN 'syslog.sd.ex@32473.path=a]b' END,
          CASE WHEN shape = 3 THEN 'syslog.sd.ex@32473.user=' || msg_id END], lambda x: x IS NOT NULL)), ';') AS attributes
        FROM parsed AS q JOIN syslog_parts AS p USING (event_id)""",
)(
    lambda t: syslog.syslog_to_logs(syslog.parse_syslog(t.syslog_lines)).select(
        "event_id", "observed_at", "ingested_at", "severity", "facility", "body", "host_name", "service_name", "attributes"
    )
)

# --- security events: checked against what each line was made to mean ---

query(
    "sec_kv",
    r"""WITH found AS (SELECT event_id, regexp_extract_all(body, '([^\s=]*)=("[^"]*"?|\S*)', 1) AS ks,
          regexp_extract_all(body, '([^\s=]*)=("[^"]*"?|\S*)', 2) AS vs FROM security_lines),
        flat AS (SELECT event_id, unnest(ks) AS key, unnest(vs) AS value, unnest(range(len(ks))) AS place FROM found),
        firsts AS (SELECT event_id, key, arg_min(value, place) AS value FROM flat WHERE key <> '' GROUP BY ALL)
        SELECT event_id, key, CASE WHEN starts_with(value, '"') THEN regexp_replace(value, '^"|"$', '', 'g') ELSE value END AS value FROM firsts""",
)(
    lambda t: t.security_lines.select(
        "event_id", F.explode(security.key_values(F.col("body"))).alias("key", "value")
    )
)
query(
    "sec_cef",
    """SELECT event_id, 'Acme' AS vendor, CASE WHEN topic <> 4 THEN 'Rule | ' || topic END AS name, '5' AS severity,
       CASE topic WHEN 0 THEN 'act=' || act || ';cef.severity=5;dst=' || dst || ';src=' || src
         WHEN 1 THEN 'cef.severity=5;outcome=' || res || ';suser=' || who WHEN 2 THEN 'cef.severity=5;query=' || who || '.example'
         WHEN 3 THEN 'act=logout;cef.severity=5;suser=' || who
         ELSE 'act=' || act || ';cef.severity=5;dpt=' || port || ';dst=' || dst || ';src=' || src END AS fields
       FROM security_parts WHERE shape = 1""",
)(
    lambda t: t.security_lines.select("event_id", security.cef_fields(F.col("body")).alias("c"))
    .where("c IS NOT NULL")
    .select("event_id", "c.vendor", "c.name", F.col("c.fields")["cef.severity"].alias("severity"), "c.fields")
)
query(
    "sec_shape",
    """SELECT event_id, CASE WHEN shape = 0 AND topic <> 4 OR shape = 0 AND topic = 4 THEN 'key_value' WHEN shape = 1 THEN 'cef'
       WHEN shape = 2 AND topic <> 4 THEN 'json' END AS shape FROM security_parts""",
)(lambda t: security.with_shape(t.security_lines).select("event_id", "shape"))

_COMMON = """SELECT event_id, unnest(CASE
    WHEN shape = 0 AND topic = 0 THEN ['source.ip=' || src, 'destination.ip=' || dst, 'destination.port=' || port, 'event.action=' || act, 'vendor.msg=two words']
    WHEN shape = 0 AND topic = 1 THEN ['user.name=' || who, 'event.outcome=' || res, 'source.ip=' || src]
    WHEN shape = 0 AND topic = 2 THEN ['dns.question.name=' || who || '.example', 'dns.response_code=NOERROR', 'dns.question.type=A']
    WHEN shape = 0 AND topic = 3 THEN ['user.name=' || who, 'event.action=connect', 'event.outcome=ok']
    WHEN shape = 0 THEN ['vendor.a=1', 'vendor.b=2', 'vendor.c=' || port]
    WHEN shape = 1 AND topic = 0 THEN ['source.ip=' || src, 'destination.ip=' || dst, 'event.action=' || act, 'vendor.cef.severity=5']
    WHEN shape = 1 AND topic = 1 THEN ['user.name=' || who, 'event.outcome=' || res, 'vendor.cef.severity=5']
    WHEN shape = 1 AND topic = 2 THEN ['dns.question.name=' || who || '.example', 'vendor.cef.severity=5']
    WHEN shape = 1 AND topic = 3 THEN ['user.name=' || who, 'event.action=logout', 'vendor.cef.severity=5']
    WHEN shape = 1 THEN ['source.ip=' || src, 'destination.ip=' || dst, 'destination.port=' || port, 'event.action=' || act, 'vendor.cef.severity=5']
    WHEN shape = 2 AND topic = 0 THEN ['source.ip=' || src, 'destination.ip=' || dst, 'event.action=' || act, 'vendor.deep={"a":[1,2]}']
    WHEN shape = 2 AND topic = 1 THEN ['user.name=' || who, 'event.outcome=' || res, 'vendor.n=' || port]
    WHEN shape = 2 AND topic = 2 THEN ['dns.question.name=' || who || '.example', 'dns.response_code=NXDOMAIN', 'vendor.ok=true']
    WHEN shape = 2 AND topic = 3 THEN ['user.name=' || who, 'event.action=start', 'vendor.x=null']
    ELSE [] END) AS pair FROM security_parts"""
query("sec_ecs", _COMMON)(
    lambda t: security.with_shape(t.security_lines)
    .select("event_id", F.explode(security.to_common(F.col("fields"))).alias("key", "value"))
    .select("event_id", F.concat_ws("=", "key", "value").alias("pair"))
)
_CLASS = """SELECT event_id, tenant_id, resource_id,
    CASE topic WHEN 0 THEN 'network' WHEN 1 THEN 'authentication' WHEN 2 THEN 'dns' WHEN 3 THEN 'vpn' ELSE 'network' END AS event_category,
    CASE topic WHEN 0 THEN CASE WHEN act = 'Deny' THEN 'denied' ELSE 'allowed' END WHEN 1 THEN CASE WHEN res = 'failure' THEN 'failure' ELSE 'success' END
      WHEN 2 THEN 'query' WHEN 3 THEN CASE WHEN shape = 1 THEN 'end' ELSE 'start' END ELSE CASE WHEN act = 'Deny' THEN 'denied' ELSE 'allowed' END END AS event_type,
    CASE WHEN shape = 1 AND topic <> 4 THEN 'Rule | ' || topic
      WHEN topic = 0 THEN CASE WHEN act = 'Deny' THEN 'Denied ' ELSE 'Allowed ' END || src || ' → ' || dst || CASE WHEN shape = 0 THEN ':' || port ELSE '' END
      WHEN topic = 1 THEN CASE WHEN res = 'failure' THEN 'Failed' ELSE 'Succeeded' END || ' for ' || who || CASE WHEN shape = 0 THEN ' from ' || src ELSE '' END
      WHEN topic = 2 THEN 'Resolved ' || who || '.example — ' || CASE WHEN shape = 0 THEN 'NOERROR' ELSE 'NXDOMAIN' END
      WHEN topic = 3 THEN 'Started for ' || who
      ELSE CASE WHEN act = 'Deny' THEN 'Denied ' ELSE 'Allowed ' END || src || ' → ' || dst || ':' || port END AS summary
    FROM security_parts WHERE shape < 3 AND (topic < 4 OR shape = 1)"""


def _events(t):
    lines = t.security_lines.withColumn("attributes", F.create_map(F.lit("host.name"), F.lit("h")))
    return security.security_events(lines)


query("sec_classify", f"SELECT event_id, event_category, event_type FROM ({_CLASS})")(
    lambda t: _events(t).select("event_id", "event_category", "event_type")
)
query("sec_events", _CLASS)(
    lambda t: _events(t).select("event_id", "tenant_id", "resource_id", "event_category", "event_type", "summary")
)

# --- OTLP: each document or span becomes a request of one resource and two scopes ---

_LOG_REQUEST = """SELECT doc_id, tenant_id, ingested_at AS received_at, '{"resourceLogs":[{"resource":{"attributes":[{"key":"host.name","value":{"stringValue":"'
    || host_name || '"}},{"key":"rack","value":{"intValue":"' || (doc_id % 13) || '"}}]},"scopeLogs":[{"scope":{"name":"a"},"logRecords":[{"timeUnixNano":"'
    || CASE WHEN doc_id % 5 = 0 THEN '0' ELSE cast(1704067200 + doc_id * 60 as string) || '000000000' END || '","observedTimeUnixNano":"'
    || CASE WHEN doc_id % 10 = 0 THEN '0' ELSE cast(1704067201 + doc_id * 60 as string) || '500000000' END
    || '","severityNumber":' || (doc_id % 27) || ',"severityText":"S' || (doc_id % 27) || '","body":{"stringValue":"line ' || doc_id
    || '"},"attributes":[{"key":"rack","value":{"boolValue":true}},{"key":"list","value":{"arrayValue":{"values":[{"intValue":"1"},{"stringValue":"b"}]}}}],"traceId":"ABCDEF'
    || (doc_id % 9) || '","spanId":""}]},{"scope":{"name":"b"},"logRecords":[{"timeUnixNano":"1704067200000000000","body":{"kvlistValue":{"values":[{"key":"k","value":{"doubleValue":2.0}}]}}}]}]}]}' AS payload
    FROM logs"""
query(
    "otlp_logs",
    """SELECT doc_id, 'a' AS scope_name, CASE WHEN doc_id % 10 = 0 THEN epoch_ms(ingested_at) WHEN doc_id % 5 = 0 THEN (1704067201 + doc_id * 60) * 1000 + 500
         ELSE (1704067200 + doc_id * 60) * 1000 END AS observed_at, epoch_ms(ingested_at) AS ingested_at,
         CASE WHEN doc_id % 27 BETWEEN 1 AND 4 THEN 'trace' WHEN doc_id % 27 BETWEEN 5 AND 8 THEN 'debug' WHEN doc_id % 27 BETWEEN 13 AND 16 THEN 'warn'
           WHEN doc_id % 27 BETWEEN 17 AND 20 THEN 'error' WHEN doc_id % 27 = 21 THEN 'critical' WHEN doc_id % 27 = 22 THEN 'alert'
           WHEN doc_id % 27 BETWEEN 23 AND 24 THEN 'emergency' ELSE 'info' END AS severity,
         'line ' || doc_id AS body, 'host.name=' || host_name || ';list=[1,b];otlp.severity_text=S' || (doc_id % 27)
           || CASE WHEN doc_id % 10 = 0 THEN ';otlp.timestamp.missing=true' ELSE '' END || ';rack=true' AS attributes, 'abcdef' || (doc_id % 9) AS trace_id FROM logs
       UNION ALL
       SELECT doc_id, 'b', 1704067200000, epoch_ms(ingested_at), 'info', '{k=2}', 'host.name=' || host_name || ';rack=' || (doc_id % 13), '' FROM logs""",
)(
    lambda t: otlp.otlp_logs(t.sql(_LOG_REQUEST)).select(
        "doc_id", "scope_name", "observed_at", "ingested_at", "severity", "body", "attributes", "trace_id"
    )
)


@query(
    "otlp_unreadable",
    "SELECT doc_id, CASE doc_id % 10 WHEN 3 THEN 'not JSON' WHEN 4 THEN 'no payload' ELSE 'no records' END AS reason FROM logs WHERE doc_id % 10 IN (3, 4, 5)",
)
def _(t):
    kind, whole = F.col("doc_id") % 10, F.col("payload")
    spoilt = F.when(kind == 3, F.substring(whole, 1, 60)).when(kind == 4, F.lit(None)).when(kind == 5, F.lit("{}")).otherwise(whole)
    return otlp.unreadable(t.sql(_LOG_REQUEST).withColumn("payload", spoilt), "logs").select("doc_id", "reason")


_METRIC_REQUEST = """SELECT event_id, ingested_at AS received_at, '{"resourceMetrics":[{"scopeMetrics":[{"metrics":[{"name":"g","unit":"By","gauge":{"dataPoints":[{"timeUnixNano":"'
    || CASE WHEN event_id % 7 = 0 THEN '0' ELSE cast(1704067200 + event_id as string) || '000000000' END || '","asInt":"' || event_id
    || '","attributes":[{"key":"cpu","value":{"stringValue":"' || (event_id % 8) || '"}}]}]}},{"name":"s","sum":{"isMonotonic":' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END
    || ',"dataPoints":[{"timeUnixNano":"1704067200000000000","asDouble":' || (event_id % 100) || '.5}]}},{"name":"h","histogram":{"dataPoints":[]}}]}]}]}' AS payload FROM metrics"""
query(
    "otlp_metrics",
    """SELECT event_id, 'g' AS metric, (1704067200 + event_id) * 1000 AS observed_at, cast(event_id as double) AS value, 'By' AS unit, 'cpu=' || (event_id % 8) AS labels
         FROM metrics WHERE event_id % 7 <> 0
       UNION ALL SELECT event_id, 's', 1704067200000, event_id % 100 + 0.5, '', 'otlp.monotonic=' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END FROM metrics""",
)(
    lambda t: otlp.otlp_metrics(t.sql(_METRIC_REQUEST)).select("event_id", "metric", "observed_at", "value", "unit", "labels")
)
query("otlp_metrics_unsupported", "SELECT count(*) + count(*) FILTER (event_id % 7 = 0) AS unsupported FROM metrics")(
    lambda t: otlp.otlp_metrics_unsupported(t.sql(_METRIC_REQUEST))
)
_SPAN_REQUEST = """SELECT l_orderkey, rn, ingested_at AS received_at, '{"resourceSpans":[{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"'
    || service_id || '"}}]},"scopeSpans":[{"scope":{"name":"lib"},"spans":[{"traceId":"' || trace_id || '","spanId":"' || upper(span_id) || '","parentSpanId":"' || parent_span_id
    || '","traceState":"' || CASE rn % 5 WHEN 0 THEN 'ot=p:2' WHEN 1 THEN 'x=1,ot=th:8;rv:1' WHEN 2 THEN 'ot=th:c0' WHEN 3 THEN 'ot=p:99' ELSE '' END || '","name":"' || name || '","kind":' || (rn % 7)
    || ',"startTimeUnixNano":"' || CASE WHEN rn % 9 = 8 THEN '0' ELSE cast(1704067200 + rn as string) || '000000000' END || '","endTimeUnixNano":"'
    || CASE rn % 4 WHEN 3 THEN '1704067199000000000' ELSE cast(1704067200 + rn as string) || '000000123' END || '","status":{"code":' || (rn % 4) || '}}]}]}]}' AS payload FROM spans"""
query(
    "otlp_spans",
    """SELECT l_orderkey, rn, trace_id, span_id, parent_span_id, name, CASE rn % 7 WHEN 2 THEN 'server' WHEN 3 THEN 'client' WHEN 4 THEN 'producer' WHEN 5 THEN 'consumer' ELSE 'internal' END AS kind,
       CASE WHEN rn % 9 = 8 THEN epoch_ms(ingested_at) ELSE (1704067200 + rn) * 1000 END AS observed_at,
       CASE WHEN rn % 9 = 8 THEN CASE rn % 4 WHEN 3 THEN 1704067199000000000 ELSE (1704067200 + rn) * 1000000000 + 123 END WHEN rn % 4 = 3 THEN 0 ELSE 123 END AS duration_ns,
       CASE rn % 4 WHEN 1 THEN 'ok' WHEN 2 THEN 'error' ELSE 'unset' END AS status_code,
       CASE rn % 5 WHEN 0 THEN 0.25 WHEN 1 THEN 0.5 WHEN 2 THEN 0.25 ELSE 0 END AS sampling_probability,
       CASE WHEN rn % 9 <> 8 AND rn % 4 = 3 THEN 'otlp.duration.negative=true;' ELSE '' END || CASE WHEN rn % 9 = 8 THEN 'otlp.timestamp.missing=true;' ELSE '' END || 'service.name=' || service_id AS attributes
       FROM spans""",
)(
    lambda t: otlp.otlp_spans(t.sql(_SPAN_REQUEST)).select(
        "l_orderkey", "rn", "trace_id", "span_id", "parent_span_id", "name", "kind", "observed_at", "duration_ns",
        "status_code", "sampling_probability", "attributes",
    )
)

# Requests with a second group that cannot be read, after one that can.
_SECOND = {
    "logs": ("scopeLogs", "logRecords", "instrumentationLibraryLogs"),
    "metrics": ("scopeMetrics", "metrics", "instrumentationLibraryMetrics"),
    "spans": ("scopeSpans", "spans", "instrumentationLibrarySpans"),
}


@query(
    "otlp_unreadable_parts",
    """WITH requests AS (SELECT 'logs' AS kind, doc_id AS id, 0 AS rn, doc_id % 6 AS fault FROM logs UNION ALL SELECT 'metrics', event_id, 0, event_id % 6 FROM metrics
         UNION ALL SELECT 'spans', l_orderkey, rn, (l_orderkey + rn) % 6 FROM spans)
       SELECT kind, id, rn, CASE fault WHEN 1 THEN 'a scope without records' WHEN 3 THEN 'a metric without points' WHEN 4 THEN 'a scope without records' ELSE 'a group without scopes' END AS reason
       FROM requests WHERE fault < 3 OR fault = 3 AND kind = 'metrics' OR fault = 4""",
)
def _(t):
    found = []
    for kind, text, id, rn in (
        ("logs", _LOG_REQUEST, "doc_id", F.lit(0)), ("metrics", _METRIC_REQUEST, "event_id", F.lit(0)), ("spans", _SPAN_REQUEST, "l_orderkey", F.col("rn"))
    ):
        scopes, items, older = _SECOND[kind]
        unread = [
            f'{{"{scopes}":"oops"}}', f'{{"{scopes}":[{{"{items}":"x"}}]}}', f'{{"{older}":[{{"{items}":[{{}}]}}]}}',
            f'{{"{scopes}":[{{"{items}":[{{"gauge":{{"dataPoints":"x"}}}}]}}]}}', f'{{"{scopes}":[{{"{items}":[{{}},"x"]}}]}}',
        ]
        fault = (F.col(id) + rn) % 6
        second = F.get(F.array(*map(F.lit, unread)), fault.cast("int"))
        spoilt = F.when(second.isNull(), F.col("payload")).otherwise(F.concat(F.expr("left(payload, length(payload) - 2)"), F.lit(","), second, F.lit("]}")))
        bad = otlp.unreadable(t.sql(text).withColumn("payload", spoilt), kind)
        found.append(bad.select(F.lit(kind).alias("kind"), F.col(id).alias("id"), rn.cast("bigint").alias("rn"), "reason"))
    return found[0].unionAll(found[1]).unionAll(found[2])


# Requests in which one number is none: a time in logs and spans, a time or a value in metrics.
@query(
    "otlp_unreadable_numbers",
    """WITH requests AS (SELECT 'logs' AS kind, doc_id AS id, 0 AS rn, doc_id % 4 AS fault, 2 AS records FROM logs
         UNION ALL SELECT 'metrics', event_id, 0, event_id % 4, CASE WHEN event_id % 4 IN (1, 2) THEN 0 WHEN event_id % 7 = 0 THEN 0 ELSE 1 END + 1 FROM metrics
         UNION ALL SELECT 'spans', l_orderkey, rn, (l_orderkey + rn) % 4, 1 FROM spans)
       SELECT kind, id, rn, records, CASE WHEN fault = 1 THEN 'a time that is no number' WHEN fault = 2 AND kind = 'metrics' THEN 'a value that is no number' END AS reason FROM requests""",
)
def _(t):
    found = []
    for kind, text, id, rn, field, read in (
        ("logs", _LOG_REQUEST, "doc_id", F.lit(0), "timeUnixNano", otlp.otlp_logs),
        ("metrics", _METRIC_REQUEST, "event_id", F.lit(0), "timeUnixNano", otlp.otlp_metrics),
        ("spans", _SPAN_REQUEST, "l_orderkey", F.col("rn"), "startTimeUnixNano", otlp.otlp_spans),
    ):
        fault = (F.col(id) + rn) % 4
        spoil = lambda field: F.regexp_replace("payload", f'^(.*?"{field}":")[0-9]+', "$1oops")  # noqa: B023, E731
        spoilt = t.sql(text).withColumn("payload", F.when(fault == 1, spoil(field)).when(fault == 2, spoil("asInt")).otherwise(F.col("payload")))
        key = ["_id", "_rn"]
        named = spoilt.withColumn("_id", F.col(id)).withColumn("_rn", rn.cast("bigint"))
        rows = read(named).groupBy(*key).agg(F.count(F.lit(1)).alias("records"))
        told = named.select(*key).join(rows, key, "left").join(otlp.unreadable(named, kind).select(*key, "reason"), key, "left")
        found.append(told.select(F.lit(kind).alias("kind"), F.col("_id").alias("id"), F.col("_rn").alias("rn"), F.coalesce("records", F.lit(0)).alias("records"), "reason"))
    return found[0].unionAll(found[1]).unionAll(found[2])


# --- flows and readings ---

_LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
query(
    "flow_normalise",
    f"""SELECT {_LINE}, epoch_ms(exported_at) - l_partkey * 100 - 5000 AS started_at, epoch_ms(exported_at) - l_partkey * 100 AS observed_at,
        '10.0.0.' || (l_suppkey % 250) AS src_address, regexp_replace(lower(dst_address), '::0$', '::') AS dst_address, greatest(coalesce(sampling_rate, 1), 1) AS sampling_rate FROM decoded_flows""",
)(
    lambda t: devices.flow_normalise(t.decoded_flows).select(
        *_LINE.split(", "), "started_at", "observed_at", "src_address", "dst_address", "sampling_rate"
    )
)
_SCALARS = "SELECT 'uptime' AS metric, '1.3.6.1.2.1.1.3' AS oid, 's' AS unit UNION ALL SELECT 'private', '1.3.6.1.4.9', '1' UNION ALL SELECT 'other', '1.3.6.1.9', '1'"
_COLUMNS = "SELECT 'network.io.receive' AS metric, '1.3.6.1.2.1.2.2.1.10' AS oid, 'By' AS unit UNION ALL SELECT 'network.io.transmit', '1.3.6.1.2.1.2.2.1.16', 'By'"
_IF_NAMES = "SELECT DISTINCT tenant_id, resource_id, '1' AS index, 'eth1' AS name FROM readings UNION ALL SELECT DISTINCT tenant_id, resource_id, '2.7', 'ae2' FROM readings"
query(
    "snmp_scalars",
    f"""WITH asked AS ({_SCALARS}) SELECT tenant_id, resource_id, epoch_ms(observed_at) AS observed_at, metric, value, unit, '' AS labels
        FROM readings AS r JOIN asked AS a ON r.oid = a.oid OR r.oid = a.oid || '.0'""",
)(lambda t: devices.snmp_scalars(t.readings, t.spark.sql(_SCALARS)))
query(
    "snmp_scalars_missing",
    f"""WITH asked AS ({_SCALARS}), found AS (SELECT r.tenant_id, r.resource_id, r.observed_at, count(DISTINCT metric) AS n FROM readings AS r JOIN asked AS a
          ON r.oid = a.oid OR r.oid = a.oid || '.0' GROUP BY ALL)
        SELECT p.tenant_id, p.resource_id, epoch_ms(p.observed_at) AS observed_at, 3 - coalesce(n, 0) AS skipped
        FROM (SELECT DISTINCT tenant_id, resource_id, observed_at FROM readings) AS p
        LEFT JOIN found AS f ON f.tenant_id = p.tenant_id AND f.resource_id = p.resource_id AND f.observed_at = p.observed_at""",
)(lambda t: devices.snmp_scalars_missing(t.readings, t.spark.sql(_SCALARS)))
query(
    "snmp_interface_columns",
    f"""WITH asked AS ({_COLUMNS}), names AS ({_IF_NAMES}), found AS (SELECT r.*, a.metric, a.unit, substr(r.oid, length(a.oid) + 2) AS index
          FROM readings AS r JOIN asked AS a ON starts_with(r.oid, a.oid || '.'))
        SELECT f.event_id, f.metric, f.value, 'network.interface.index=' || f.index || coalesce(';network.interface.name=' || n.name, '') AS labels
        FROM found AS f LEFT JOIN names AS n ON n.tenant_id = f.tenant_id AND n.resource_id = f.resource_id AND n.index = f.index""",
)(
    lambda t: devices.snmp_interface_columns(t.readings, t.spark.sql(_COLUMNS), t.sql(_IF_NAMES))
    .join(t.readings.select("event_id", "tenant_id", "resource_id", "observed_at"), ["tenant_id", "resource_id", "observed_at"])
    .select("event_id", "metric", "value", "labels")
)

# --- inventory facts ---

query(
    "enrich_site_vendor",
    """SELECT doc_id, coalesce(r.site_id, '00000000-0000-0000-0000-000000000000') AS site_id, coalesce(r.vendor, '') AS source_vendor
       FROM logs AS l LEFT JOIN resources AS r ON r.tenant_id = l.tenant_id AND r.id = l.resource_id""",
)(lambda t: devices.enrich_site_vendor(t.logs, t.resources).select("doc_id", "site_id", "source_vendor"))
_BARE = "lower(regexp_replace(mac, '[:. -]', '', 'g'))"
query(
    "mac_vendor",
    f"""WITH bare AS (SELECT o_orderkey, mac, CASE WHEN regexp_full_match({_BARE}, '[0-9a-f]{{12}}') AND substr({_BARE}, 2, 1) IN ('0', '4', '8', 'c') THEN {_BARE} END AS m FROM macs)
        SELECT o_orderkey, coalesce(r9.organisation, r7.organisation, r6.organisation) AS vendor FROM bare
        LEFT JOIN mac_registry AS r9 ON r9.prefix = substr(m, 1, 9) LEFT JOIN mac_registry AS r7 ON r7.prefix = substr(m, 1, 7)
        LEFT JOIN mac_registry AS r6 ON r6.prefix = substr(m, 1, 6)""",
)(lambda t: devices.mac_vendor(t.macs, t.mac_registry).select("o_orderkey", "vendor"))

# --- scalars ---

# Addresses spread over every special block, some of them not addresses at all.
_ADDRESSES = """SELECT doc_id AS id, CASE doc_id % 12 WHEN 0 THEN '10.1.2.' || (doc_id % 256) WHEN 1 THEN '172.' || (doc_id % 256) || '.0.1' WHEN 2 THEN '192.168.0.1'
    WHEN 3 THEN '127.0.0.1' WHEN 4 THEN '169.254.9.9' WHEN 5 THEN '100.' || (doc_id % 256) || '.1.1' WHEN 6 THEN '8.8.8.' || (doc_id % 300) WHEN 7 THEN 'fe80::1'
    WHEN 8 THEN '' WHEN 9 THEN '01.2.3.4' WHEN 10 THEN ' 203.0.113.7 ' ELSE '1.2.3' END AS address FROM documents"""
query(
    "ip_scope",
    f"""WITH a AS ({_ADDRESSES}), o AS (SELECT id, address, list_transform(string_split(trim(address), '.'), lambda x: try_cast(x as int)) AS p,
          regexp_full_match(trim(address), '(0|[1-9][0-9]{{0,2}})([.](0|[1-9][0-9]{{0,2}})){{3}}') AS ok FROM a)
        SELECT id, CASE WHEN NOT ok OR p[1] > 255 OR p[2] > 255 OR p[3] > 255 OR p[4] > 255 THEN 'unknown' WHEN p[1] = 127 THEN 'loopback'
          WHEN p[1] = 10 OR p[1] = 172 AND p[2] BETWEEN 16 AND 31 OR p[1] = 192 AND p[2] = 168 THEN 'private'
          WHEN p[1] = 169 AND p[2] = 254 THEN 'link_local' WHEN p[1] = 100 AND p[2] BETWEEN 64 AND 127 THEN 'carrier_grade' ELSE 'public' END AS scope FROM o""",
)(lambda t: t.sql(_ADDRESSES).select("id", ip_scope("address").alias("scope")))
query(
    "protocol_name",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE protocol WHEN 1 THEN 'ICMP' WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' WHEN 47 THEN 'GRE' WHEN 50 THEN 'ESP'
       WHEN 58 THEN 'ICMPv6' WHEN 89 THEN 'OSPF' WHEN 132 THEN 'SCTP' ELSE cast(protocol as string) END AS name FROM flows""",
)(lambda t: t.flows.select(*_LINE.split(", "), protocol_name("protocol").alias("name")))
query(
    "ttl_hops",
    """SELECT doc_id, CASE WHEN t <= 64 THEN 64 WHEN t <= 128 THEN 128 WHEN t <= 255 THEN 255 END AS start,
       CASE WHEN t <= 64 THEN 64 WHEN t <= 128 THEN 128 WHEN t <= 255 THEN 255 END - t AS hops FROM (SELECT doc_id, doc_id % 300 AS t FROM documents)""",
)(
    lambda t: t.documents.select(
        "doc_id", initial_ttl(F.col("doc_id") % 300).alias("start"), ttl_hops(F.col("doc_id") % 300).alias("hops")
    )
)
