"""Rollups, rates, transitions, timelines and traces."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from beaconry.functions.predicates import bucketed_window
from beaconry.functions.scalars import time_bucket
from beaconry.operators import rates, rollups, timeline, traces
from beaconry.plans.registry import query

B5 = "(epoch_ms(observed_at) // 300000) * 300000"
B60 = "(epoch_ms(observed_at) // 3600000) * 3600000"

query("rollup_logs_5m", f"SELECT tenant_id, resource_id, severity, {B5} AS bucket, count(*) AS cnt FROM logs GROUP BY ALL")(
    lambda t: rollups.rollup_logs_5m(t.logs)
)
_METRIC_STATES = "min(value) AS min_v, max(value) AS max_v, round(sum(value), 6) AS sum_v, count(value) AS cnt"
query("rollup_metrics_5m", f"SELECT tenant_id, resource_id, metric, {B5} AS bucket, {_METRIC_STATES} FROM metrics GROUP BY ALL")(
    lambda t: rollups.rollup_metrics_5m(t.metrics)
)
query("rollup_metrics_1h", f"SELECT tenant_id, resource_id, metric, {B60} AS bucket, {_METRIC_STATES} FROM metrics GROUP BY ALL")(
    lambda t: rollups.rollup_metrics_1h(rollups.rollup_metrics_5m(t.metrics))
)
query(
    "rollup_flows_5m",
    f"""SELECT tenant_id, resource_id, {B5} AS bucket, src_address, dst_address, dst_port, protocol, sampling_rate,
        sum(bytes) AS bytes, sum(packets) AS packets, count(*) AS records FROM flows GROUP BY ALL""",
)(lambda t: rollups.rollup_flows_5m(t.flows))
query(
    "rollup_service_5m",
    f"""SELECT tenant_id, service_id, name, kind, {B5} AS bucket, count(*) AS requests,
        count(*) FILTER (status_code = 'error') AS errors FROM spans GROUP BY ALL""",
)(lambda t: rollups.rollup_service_5m(t.spans).drop("latency"))


@query(
    "filter_time_bucketed",
    f"""SELECT tenant_id, resource_id, metric, {B5} AS bucket, count(*) AS cnt FROM metrics
        WHERE observed_at >= TIMESTAMP '2024-01-01 06:00:00' AND observed_at < TIMESTAMP '2024-01-03 00:00:00' GROUP BY ALL""",
)
def _(t):
    # The window starts inside a bucket; the bucket is kept whole.
    inside = bucketed_window("bucket", dt.datetime(2024, 1, 1, 6, 2), dt.datetime(2024, 1, 3), 300)
    return rollups.rollup_metrics_5m(t.metrics).where(inside).select("tenant_id", "resource_id", "metric", "bucket", "cnt")


# Readers answer from states; the checking SQL answers from raw rows.
query("read_rollup_logs", f"SELECT tenant_id, severity, {B60} AS hour, count(*) AS count FROM logs GROUP BY ALL")(
    lambda t: rollups.read_rollup_logs(
        rollups.rollup_logs_5m(t.logs), ["tenant_id", "severity", time_bucket("bucket", 3600).alias("hour")]
    )
)
query(
    "read_rollup_metrics",
    "SELECT tenant_id, metric, min(value) AS min, max(value) AS max, round(avg(value), 6) AS avg, count(value) AS count FROM metrics GROUP BY ALL",
)(
    lambda t: rollups.read_rollup_metrics(
        rollups.rollup_metrics_1h(rollups.rollup_metrics_5m(t.metrics)), ["tenant_id", "metric"]
    )
)
query(
    "read_rollup_flows",
    """SELECT tenant_id, src_address, sampling_rate, sum(bytes) AS bytes, sum(packets) AS packets, count(*) AS count
       FROM flows GROUP BY ALL""",
)(
    lambda t: rollups.read_rollup_flows(
        rollups.rollup_flows_5m(t.flows), ["tenant_id", "src_address", "sampling_rate"]
    )
)
# So few values a group that the sketches still hold them one by one.
query(
    "read_rollup_distinct",
    "SELECT tenant_id, metric, count(DISTINCT resource_id) AS \"distinct\" FROM metrics GROUP BY ALL",
)(
    lambda t: rollups.read_rollup_distinct(
        rollups.rollup_distinct_5m(t.metrics, ["tenant_id", "metric"], "resource_id"), ["tenant_id", "metric"]
    )
)
# Sketch quantiles are approximate, so there is no SQL to compare them with.
query("read_rollup_service")(
    lambda t: rollups.read_rollup_service(rollups.rollup_service_5m(t.spans), ["tenant_id", "service_id"])
)

# --- rates and transitions ---

_RATES = """WITH lagged AS (SELECT *, lag(value) OVER w AS pv, lag(observed_at) OVER w AS pt FROM counters
      WINDOW w AS (PARTITION BY tenant_id, resource_id, metric ORDER BY observed_at, event_id)),
    rated AS (SELECT *, CASE WHEN observed_at > pt AND value >= pv
      THEN (value - pv) / ((epoch_ms(observed_at) - epoch_ms(pt)) / 1000) END AS rate FROM lagged)"""

query("counter_rate", f"{_RATES} SELECT event_id, round(rate, 6) AS rate FROM rated")(
    lambda t: rates.counter_rate(t.counters, tie=["event_id"]).select("event_id", "rate")
)
query(
    "rate_agg",
    f"""{_RATES} SELECT {B5} AS bucket, tenant_id, resource_id, metric, round(avg(rate), 6) AS per_second,
        round(max(rate), 6) AS peak FROM rated GROUP BY ALL""",
)(lambda t: rates.rate_agg(t.counters, 300, ["tenant_id", "resource_id", "metric"], tie=["event_id"]))
query(
    "counter_step_class",
    f"""{_RATES} SELECT event_id, CASE WHEN pt IS NULL THEN NULL WHEN observed_at <= pt THEN 'no_time' WHEN value >= pv THEN 'rate'
        WHEN epoch_ms(observed_at) - epoch_ms(pt) < 7200000 THEN 'wrapped' ELSE 'reset' END AS step FROM rated""",
)(lambda t: rates.counter_step_class(t.counters, 32, 3600, tie=["event_id"]).select("event_id", "step"))
_TRANSITIONS = """WITH lagged AS (SELECT s.o_orderkey AS reading_id, s.current_status, coalesce(lag(s.current_status) OVER (PARTITION BY s.tenant_id, s.resource_id ORDER BY s.observed_at, s.o_orderkey),
      r.status, 'unknown') AS was FROM states AS s LEFT JOIN resources AS r ON r.tenant_id = s.tenant_id AND r.id = s.resource_id)
    SELECT reading_id, was AS previous_status, current_status, CASE WHEN current_status = 'up' THEN 'info' ELSE 'error' END AS severity
    FROM lagged WHERE was <> current_status AND was NOT IN ('maintenance', 'decommissioned')"""
query("state_transitions", _TRANSITIONS)(
    lambda t: rates.state_transitions(t.states, t.resources, tie=["o_orderkey"], slice_seconds=86400 * 30).select(
        F.col("o_orderkey").alias("reading_id"), "previous_status", "current_status", "severity"
    )
)
query(
    "latest_per_key",
    """SELECT tenant_id, address, o_orderkey, state FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, address
       ORDER BY last_seen DESC, o_orderkey DESC) AS rn FROM candidates) WHERE rn = 1""",
)(
    lambda t: rates.latest_per_key(t.candidates, ["tenant_id", "address"], ["last_seen", "o_orderkey"]).select(
        "tenant_id", "address", "o_orderkey", "state"
    )
)

# Which clerk priority held each of four jobs, as lease observations.
_LEASES = """SELECT CASE o_orderkey % 4 WHEN 0 THEN 'poll' WHEN 1 THEN 'alert' WHEN 2 THEN 'sweep' ELSE 'run' END AS job,
    o_orderpriority AS holder, o_orderkey % 6 <> 5 AS live,
    cast(o_orderdate as timestamp) + (o_orderkey % 86400) * INTERVAL '1' SECOND AS observed_at, o_orderkey FROM orders"""
query(
    "lease_changes",
    f"""WITH leases AS ({_LEASES}), seen AS (SELECT *, lag(holder) OVER (PARTITION BY job ORDER BY observed_at, o_orderkey) AS was FROM leases WHERE live)
        SELECT job, epoch_ms(observed_at) AS observed_at, was AS previous_holder, holder, o_orderkey FROM seen WHERE was <> holder""",
)(lambda t: rates.lease_changes(t.sql(_LEASES), tie=["o_orderkey"]))

# --- timelines ---

_START, _END, _NOW = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 8), dt.datetime(2024, 1, 9)


def _ties():
    """What orders rows of one instant."""
    padded = lambda c: F.lpad(F.col(c).cast("string"), 12, "0")
    return {
        "states": F.col("o_orderkey").cast("string"), "events": padded("event_id"), "logs": padded("doc_id"),
        "metrics": padded("event_id"), "flows": F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
        "spans": F.col("span_id"),
    }


_SIGNALS = {"states": "states", "events": "platform_events", "logs": "logs", "metrics": "metrics", "flows": "flows", "spans": "spans"}
_SQL_TRACK = {
    # Spans and flows are kept for seven days, so only what began on 2 January or later is left.
    "states": ("states", "0", "cast(o_orderkey as string)", "2024-01-01"),
    "events": ("platform_events", "1", "lpad(cast(event_id as string), 12, '0')", "2024-01-01"),
    "logs": ("logs", "2", "lpad(cast(doc_id as string), 12, '0')", "2024-01-01"),
    "metrics": ("metrics", "3", "lpad(cast(event_id as string), 12, '0')", "2024-01-01"),
    "flows": ("flows", "4", "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)", "2024-01-02"),
    "spans": ("spans", "5", "span_id", "2024-01-02"),
}
_UP = "SELECT tenant_id, id AS resource_id FROM resources WHERE status = 'up'"


def _tracks() -> str:
    return " UNION ALL ".join(
        f"""(SELECT tenant_id, resource_id, '{s}' AS signal, {rank} AS signal_rank, epoch_ms(observed_at) AS observed_at, {tie} AS tie
            FROM {view} AS x JOIN up USING (tenant_id, resource_id) WHERE observed_at >= TIMESTAMP '{begin}' AND observed_at < TIMESTAMP '2024-01-08')"""
        for s, (view, rank, tie, begin) in _SQL_TRACK.items()
    )


@query("timeline", f"WITH up AS ({_UP}) SELECT * FROM ({_tracks()})")
def _(t):
    signals = {s: getattr(t, v) for s, v in _SIGNALS.items()}
    return timeline.timeline(signals, t.sql(_UP), _START, _END, _NOW, _ties()).drop("text")


# An incident per tenant and site, over the devices that are up there.
_INCIDENTS = """SELECT DISTINCT tenant_id, site_id AS incident_id, TIMESTAMP '2024-01-01 00:00:00' AS starts_at,
    TIMESTAMP '2024-01-06 00:00:00' AS ends_at FROM resources"""
_MEMBERS = "SELECT tenant_id, site_id AS incident_id, id AS resource_id FROM resources WHERE status = 'up'"


def _incident_tracks() -> str:
    return " UNION ALL ".join(
        f"""SELECT x.tenant_id, incident_id, x.resource_id, '{s}' AS signal, {rank} AS signal_rank, epoch_ms(observed_at) AS observed_at, {tie} AS tie
            FROM {view} AS x JOIN wanted AS w ON w.tenant_id = x.tenant_id AND w.resource_id = x.resource_id
            WHERE observed_at >= TIMESTAMP '2024-01-01' AND observed_at < TIMESTAMP '2024-01-06'"""
        for s, (view, rank, tie, _) in _SQL_TRACK.items()
    )


@query(
    "incident_timeline",
    f"""WITH wanted AS ({_MEMBERS}), rows AS ({_incident_tracks()}) SELECT * FROM rows""",
)
def _(t):
    signals = {s: getattr(t, v) for s, v in _SIGNALS.items()}
    return timeline.incident_timeline(t.sql(_INCIDENTS), t.sql(_MEMBERS), signals, _ties()).drop("text")


# --- traces ---

# The same tree by recursion; the supplied spans have orphans but no cycles.
_TREE = """WITH RECURSIVE linked AS (SELECT s.tenant_id, s.trace_id, s.span_id, s.observed_at, s.duration_ns,
        p.span_id AS parent, p.span_id IS NULL AND s.parent_span_id <> '' AS orphaned
      FROM spans AS s LEFT JOIN spans AS p ON p.tenant_id = s.tenant_id AND p.trace_id = s.trace_id AND p.span_id = s.parent_span_id AND s.parent_span_id <> ''),
    marked AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, trace_id, coalesce(parent, '') ORDER BY duration_ns DESC, observed_at, span_id) = 1 AS slowest FROM linked),
    tree AS (SELECT tenant_id, trace_id, span_id, span_id AS root, 0 AS depth, slowest AS critical FROM marked WHERE parent IS NULL
      UNION ALL SELECT m.tenant_id, m.trace_id, m.span_id, t.root, t.depth + 1, t.critical AND m.slowest
      FROM tree AS t JOIN marked AS m ON m.tenant_id = t.tenant_id AND m.trace_id = t.trace_id AND m.parent = t.span_id)"""
query(
    "trace_tree",
    _TREE + """, extents AS (SELECT tenant_id, trace_id, min(epoch_us(observed_at) / 1000) AS lo,
          greatest(max(epoch_us(observed_at) / 1000 + duration_ns / 1e6) - min(epoch_us(observed_at) / 1000), 1) AS span FROM spans GROUP BY ALL)
       SELECT m.tenant_id, m.trace_id, m.span_id, m.parent, t.root, t.depth, m.orphaned,
         round((epoch_us(m.observed_at) / 1000 - e.lo) / e.span, 6) AS "offset", round(m.duration_ns / 1e6 / e.span, 6) AS width, t.critical
       FROM marked AS m JOIN tree AS t USING (tenant_id, trace_id, span_id) JOIN extents AS e USING (tenant_id, trace_id)""",
)(lambda t: traces.trace_tree(t.spans))
query("trace_tree_repeated", _TREE + " SELECT tenant_id, trace_id, span_id, root, depth, critical FROM tree")(
    # Spans that were delivered twice and three times.
    lambda t: traces.trace_tree(t.spans.union(t.spans.where("rn % 2 = 0")).union(t.spans.where("rn % 3 = 0"))).select(
        "tenant_id", "trace_id", "span_id", "root", "depth", "critical"
    )
)
query("trace_critical_path", _TREE + " SELECT tenant_id, trace_id, span_id, depth FROM tree WHERE critical")(
    lambda t: traces.trace_critical_path(t.spans)
)
query(
    "trace_summary",
    """WITH linked AS (SELECT s.*, p.span_id IS NULL AND s.parent_span_id <> '' AS orphaned FROM spans AS s
         LEFT JOIN spans AS p ON p.tenant_id = s.tenant_id AND p.trace_id = s.trace_id AND p.span_id = s.parent_span_id AND s.parent_span_id <> ''),
       firsts AS (SELECT tenant_id, trace_id, service_id, min(row(observed_at, span_id)) AS seen FROM spans GROUP BY ALL),
       services AS (SELECT tenant_id, trace_id, string_agg(service_id, ';' ORDER BY seen) AS services FROM firsts GROUP BY ALL)
       SELECT tenant_id, trace_id, count(*) AS spans, count(*) FILTER (status_code = 'error') AS errors,
         CASE WHEN bool_or(orphaned) THEN 'clipped' ELSE 'complete' END AS kind, any_value(services) AS services
       FROM linked JOIN services USING (tenant_id, trace_id) GROUP BY ALL""",
)(lambda t: traces.trace_summary(t.spans))
query(
    "trace_summary_empty",
    """SELECT tenant_id, trace_id, count(*) AS spans FROM spans GROUP BY ALL
       UNION ALL SELECT DISTINCT tenant_id, 'none' || trace_id, 0 FROM spans""",
)(
    lambda t: traces.trace_summary(
        t.spans, t.sql("SELECT tenant_id, trace_id FROM spans UNION SELECT tenant_id, 'none' || trace_id FROM spans")
    ).where("(kind = 'empty') = (spans = 0)").select("tenant_id", "trace_id", "spans")
)
