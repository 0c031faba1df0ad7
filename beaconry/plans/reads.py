"""Scans, predicates, aggregates, order and limits over the six signals."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from beaconry import schemas
from beaconry.functions import predicates as p
from beaconry.functions import scalars as sc
from beaconry.operators import insight
from beaconry.operators.query import (
    Agg,
    aggregate,
    default_order,
    field_counts,
    histogram,
    latest_stat,
    ordered,
    read,
    scan,
    series_lines,
    tail,
)
from beaconry.plans.registry import ms, pairs, query

JAN1 = dt.datetime(2024, 1, 1)
JAN2 = dt.datetime(2024, 1, 2)

# --- scans ---

_VIEW = {
    "logs": "logs", "metrics": "metrics", "events": "platform_events", "states": "states",
    "flows": "flows", "spans": "spans",
}


def _scan_sql(signal: str) -> str:
    parts = []
    for f in schemas.SIGNALS[signal].fields:
        kind = f.dataType.typeName()
        if kind == "timestamp":
            parts.append(ms(f.name))
        elif kind == "map":
            parts.append(pairs(f.name))
        else:
            parts.append(f.name)
    return f"SELECT {', '.join(parts)} FROM {_VIEW[signal]}"


def _register_scan(signal: str) -> None:
    @query(f"scan_{signal}", _scan_sql(signal))
    def _(t):
        return scan(getattr(t, _VIEW[signal]), signal, None)


for _signal in schemas.SIGNALS:
    _register_scan(_signal)

# --- filters ---

_LOG = "tenant_id, resource_id, doc_id"


def _logs(where):
    return lambda t: read(t.logs, None, where=where(t)).select("tenant_id", "resource_id", "doc_id")


def _register_log_filter(name: str, where, sql_where: str) -> None:
    query(name, f"SELECT {_LOG} FROM logs WHERE {sql_where}")(_logs(where))


@query(
    "filter_time",
    "SELECT event_id, resource_id, value FROM metrics WHERE observed_at >= TIMESTAMP '2024-01-01 00:00:00'"
    " AND observed_at < TIMESTAMP '2024-01-02 00:00:00'",
)
def _(t):
    return read(t.metrics, None, start=JAN1, end=JAN2).select("event_id", "resource_id", "value")


@query("filter_tenant", "SELECT event_id, tenant_id FROM metrics WHERE tenant_id = 't3'")
def _(t):
    return read(t.metrics, "t3").select("event_id", "tenant_id")


query("cmp_eq", "SELECT event_id, metric, value FROM metrics WHERE metric = 'error'")(
    lambda t: read(t.metrics, None, where=p.compare("metric", "eq", "error")).select("event_id", "metric", "value")
)
for _op, _sql in {"ne": "<>", "lt": "<", "lte": "<=", "gt": ">", "gte": ">="}.items():
    query(
        f"cmp_{_op}", f"SELECT event_id, metric, value FROM metrics WHERE value {_sql} 12.31"
    )(lambda t, op=_op: read(t.metrics, None, where=p.compare("value", op, 12.31)).select("event_id", "metric", "value"))


@query("cmp_in", "SELECT event_id, metric FROM metrics WHERE metric IN ('click', 'error')")
def _(t):
    return read(t.metrics, None, where=p.is_in("metric", ["click", "error"])).select("event_id", "metric")


@query("cmp_not_in", "SELECT event_id, metric FROM metrics WHERE metric NOT IN ('click', 'error')")
def _(t):
    return read(t.metrics, None, where=p.is_in("metric", ["click", "error"], negate=True)).select(
        "event_id", "metric"
    )


@query(
    "cmp_in_list_table",
    "SELECT event_id, resource_id FROM metrics WHERE resource_id IN (SELECT resource_id FROM group_members WHERE group_id = 'MACHINERY')",
)
def _(t):
    wanted = t.group_members.where("group_id = 'MACHINERY'").select("resource_id")
    return p.members(t.metrics, "resource_id", wanted).select("event_id", "resource_id")


_register_log_filter(
    "bool_and", lambda t: p.all_of(p.compare("severity", "eq", "error"), p.compare("service_name", "eq", "en")),
    "severity = 'error' AND service_name = 'en'",
)
_register_log_filter(
    "bool_or", lambda t: p.any_of(p.compare("severity", "eq", "error"), p.compare("service_name", "eq", "fr")),
    "severity = 'error' OR service_name = 'fr'",
)
_register_log_filter(
    "bool_not",
    lambda t: ~p.any_of(p.compare("severity", "eq", "error"), p.all_of(p.compare("service_name", "eq", "fr"), p.compare("facility", "gt", 5))),
    "NOT (severity = 'error' OR (service_name = 'fr' AND facility > 5))",
)

_TOKENS = r"list_filter(regexp_split_to_array(body, '[^\p{L}\p{N}]+'), lambda x: x <> '')"
_register_log_filter(
    "text_any_token", lambda t: p.text_search(["quick", "the", "der"], "any_token"),
    f"list_has_any({_TOKENS}, ['quick', 'the', 'der'])",
)
_register_log_filter(
    "text_all_token", lambda t: p.text_search(["the", "and"], "all_token"),
    f"list_has_all({_TOKENS}, ['the', 'and'])",
)
_register_log_filter(
    "text_substring", lambda t: p.text_search(["The", "an"], "substring"), "contains(lower(body), 'the an')"
)
_register_log_filter(
    "text_phrase", lambda t: p.text_search(["of", "and"], "phrase"),
    f"contains(lower(body), 'of and') AND list_has_all({_TOKENS}, ['of', 'and'])",
)


@query("tokenize", f"SELECT token, count(*) AS n FROM (SELECT unnest({_TOKENS}) AS token FROM logs) GROUP BY token")
def _(t):
    return t.logs.select(F.explode(sc.tokens("body")).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


_register_log_filter("exists_attr", lambda t: p.exists(t.logs, "attributes", "rack"), "map_contains(attributes, 'rack')")
_register_log_filter("exists_text", lambda t: p.exists(t.logs, "trace_id"), "trace_id <> ''")
_register_log_filter(
    "attr_not_equal", lambda t: p.compare(sc.attr("attributes", "rack"), "ne", "rack3"),
    "coalesce(attributes['rack'], '') <> 'rack3'",
)
_register_log_filter("severity_at_least", lambda t: p.severity_at_least("error"), "doc_id % 9 >= 5")


@query(
    "attr_lookup",
    "SELECT doc_id, coalesce(attributes['rack'], '') AS rack, host_name AS host, coalesce(attributes['none'], '') AS missing FROM logs",
)
def _(t):
    return t.logs.select(
        "doc_id", p.attr_of(t.logs, "rack").alias("rack"), p.attr_of(t.logs, "host.name").alias("host"),
        p.attr_of(t.logs, "none").alias("missing"),
    )


@query(
    "time_bucket",
    "SELECT event_id, (epoch_ms(observed_at) // 300000) * 300000 AS bucket FROM metrics",
)
def _(t):
    return t.metrics.select("event_id", sc.time_bucket("observed_at", 300).alias("bucket"))


@query("derived_errors", "SELECT span_id, CASE WHEN status_code = 'error' THEN 1 ELSE 0 END AS errors FROM spans")
def _(t):
    return t.spans.select("span_id", sc.errors().alias("errors"))


@query("limit_clamp", "SELECT event_id, value FROM metrics ORDER BY value DESC, event_id LIMIT 50000")
def _(t):
    return ordered(t.metrics.select("event_id", "value"), [("value", True), ("event_id", False)], limit=50_000)


# --- aggregates ---


@query("agg_count", "SELECT tenant_id AS g0, metric AS g1, count(*) AS n FROM metrics GROUP BY ALL")
def _(t):
    return aggregate(t.metrics, {"n": Agg("count")}, ["tenant_id", "metric"])


@query("agg_count_all", "SELECT count(*) AS n FROM logs")
def _(t):
    return aggregate(t.logs, {"n": Agg("count")})


@query(
    "agg_count_distinct",
    "SELECT metric AS g0, count(DISTINCT resource_id) AS devices FROM metrics GROUP BY ALL",
)
def _(t):
    return aggregate(t.metrics, {"devices": Agg("count_distinct", "resource_id")}, ["metric"])


for _f in ("sum", "min", "max", "avg"):
    query(f"agg_{_f}", f"SELECT tenant_id AS g0, metric AS g1, round({_f}(value), 6) AS v FROM metrics GROUP BY ALL")(
        lambda t, f=_f: aggregate(t.metrics, {"v": Agg(f, "value")}, ["tenant_id", "metric"])
    )
for _f, _q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
    query(
        f"agg_{_f}",
        f"SELECT tenant_id AS g0, metric AS g1, round(quantile_cont(value, {_q}), 6) AS v FROM metrics GROUP BY ALL",
    )(lambda t, f=_f: aggregate(t.metrics, {"v": Agg(f, "value")}, ["tenant_id", "metric"]))


@query(
    "agg_quantiles_all",
    "SELECT round(quantile_cont(duration_ns, 0.5), 0) AS p50, round(quantile_cont(duration_ns, 0.99), 0) AS p99, count(*) AS n FROM spans",
)
def _(t):
    rows = aggregate(
        t.spans, {"p50": Agg("p50", "duration_ns"), "p99": Agg("p99", "duration_ns"), "n": Agg("count")}
    )
    return rows.withColumns({q: F.round(q, 0) for q in ("p50", "p99")})


@query(
    "group_by",
    f"""SELECT (epoch_ms(observed_at) // 3600000) * 3600000 AS g0, service_name AS g1, coalesce(attributes['rack'], '') AS g2,
        count(*) AS n, sum(facility) AS facilities FROM logs GROUP BY ALL""",
)
def _(t):
    return aggregate(
        t.logs, {"n": Agg("count"), "facilities": Agg("sum", "facility")},
        [sc.time_bucket("observed_at", 3600), "service_name", p.attr_of(t.logs, "rack")],
    )


# --- order, limit ---


@query(
    "order_by_alias",
    "SELECT resource_id AS g0, count(*) AS n FROM metrics GROUP BY ALL ORDER BY n DESC, g0 LIMIT 100",
)
def _(t):
    return ordered(aggregate(t.metrics, {"n": Agg("count")}, ["resource_id"]), [("n", True), ("g0", False)], limit=100)


@query(
    "order_by_field",
    "SELECT resource_id, doc_id, facility FROM logs ORDER BY facility, doc_id DESC LIMIT 120",
)
def _(t):
    return ordered(t.logs.select("resource_id", "doc_id", "facility"), [("facility", False), ("doc_id", True)], limit=120)


@query(
    "default_order",
    "SELECT resource_id, epoch_ms(observed_at) AS observed_at, doc_id FROM logs ORDER BY resource_id, observed_at DESC",
)
def _(t):
    return default_order(t.logs.select("resource_id", "observed_at", "doc_id"))


@query(
    "limit_offset",
    "SELECT event_id, value FROM metrics ORDER BY value DESC, event_id LIMIT 50 OFFSET 20",
)
def _(t):
    return ordered(t.metrics.select("event_id", "value"), [("value", True), ("event_id", False)], limit=50, offset=20)


@query(
    "tail_latest",
    "SELECT doc_id, resource_id, epoch_ms(observed_at) AS observed_at FROM logs ORDER BY logs.observed_at DESC, doc_id LIMIT 5000",
)
def _(t):
    return tail(t.logs, None, 5000, tie=["doc_id"]).select("doc_id", "resource_id", "observed_at")


@query(
    "top_n",
    "SELECT resource_id AS g0, sum(bytes) AS bytes FROM flows GROUP BY ALL ORDER BY bytes DESC, g0 LIMIT 10",
)
def _(t):
    return ordered(aggregate(t.flows, {"bytes": Agg("sum", "bytes")}, ["resource_id"]), [("bytes", True), ("g0", False)], limit=10)


# --- shapes of a result ---


@query(
    "log_histogram",
    """WITH axis AS (SELECT 1704067200000 + i * 1800000 AS bucket FROM range(0, 49) AS r(i)),
       counted AS (SELECT (epoch_ms(observed_at) // 1800000) * 1800000 AS bucket, count(*) AS n FROM logs
                   WHERE observed_at >= TIMESTAMP '2024-01-01' AND observed_at < TIMESTAMP '2024-01-02' GROUP BY ALL)
       SELECT axis.bucket, coalesce(n, 0) AS n FROM axis LEFT JOIN counted USING (bucket)""",
)
def _(t):
    # A day in about 60 bars is 24 minutes a bar; the ladder's next step is 30 minutes.
    return histogram(t.logs, JAN1, JAN2)


@query("field_counts", "SELECT service_name AS value, count(*) AS n FROM logs WHERE doc_id % 9 >= 5 GROUP BY ALL ORDER BY n DESC, value LIMIT 8")
def _(t):
    return field_counts(t.logs.where(p.severity_at_least("error")), "service_name")


@query(
    "latest_stat",
    """WITH g AS (SELECT (epoch_ms(observed_at) // 300000) * 300000 AS b, avg(value) AS v FROM metrics GROUP BY ALL)
       SELECT round(v, 6) AS value FROM g WHERE v IS NOT NULL ORDER BY b DESC LIMIT 1""",
)
def _(t):
    grouped = aggregate(t.metrics, {"v": Agg("avg", "value")}, [sc.time_bucket("observed_at", 300)])
    return latest_stat(grouped, "g0", "v")


@query(
    "series_pivot",
    """SELECT tenant_id || ' · ' || metric AS series, (epoch_ms(observed_at) // 3600000) * 3600000 AS at,
       round(max(value), 6) AS value FROM metrics GROUP BY ALL""",
)
def _(t):
    grouped = aggregate(
        t.metrics, {"v": Agg("max", "value")}, [sc.time_bucket("observed_at", 3600), "tenant_id", "metric"]
    )
    return series_lines(grouped, "g0", ["g1", "g2"], "v")


# --- screens, one top list per tenant ---


def _top(sql: str, order: str, n: int) -> str:
    return (
        f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY {order}) AS rn"
        f" FROM ({sql})) WHERE rn <= {n}"
    )


@query(
    "top_talkers",
    _top(
        """SELECT tenant_id, src_address, dst_address, dst_port, protocol, sampling_rate, sum(bytes) AS bytes,
           sum(packets) AS packets FROM flows GROUP BY ALL""",
        "bytes DESC, src_address, dst_address, dst_port, protocol, sampling_rate", 25,
    ),
)
def _(t):
    return insight.top_talkers(t.flows, None)


@query(
    "flow_estimate",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, bytes * sampling_rate AS estimated_bytes,
       packets * sampling_rate AS estimated_packets, sampling_rate > 1 AS estimated FROM flows""",
)
def _(t):
    return insight.flow_estimate(t.flows).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "estimated_bytes", "estimated_packets", "estimated"
    )


@query(
    "service_latency",
    _top(
        """SELECT tenant_id, service_id, count(*) AS requests, sum(CASE WHEN status_code = 'error' THEN 1 ELSE 0 END) AS errors,
           round(quantile_cont(duration_ns, 0.5), 0) AS p50, round(quantile_cont(duration_ns, 0.95), 0) AS p95,
           round(quantile_cont(duration_ns, 0.99), 0) AS p99,
           round(sum(CASE WHEN status_code = 'error' THEN 1 ELSE 0 END) / count(*), 6) AS error_rate
           FROM spans GROUP BY ALL""",
        "p99 DESC, service_id", 25,
    ),
)
def _(t):
    rows = insight.service_latency(t.spans, None)
    return rows.withColumns({q: F.round(q, 0) for q in ("p50", "p95", "p99")})


_FAILED = "event_category = 'authentication' AND event_type = 'failure'"


@query(
    "auth_failures_by_source",
    _top(
        f"""SELECT tenant_id, attributes['source.ip'] AS source, count(*) AS failures,
            count(DISTINCT attributes['user.name']) AS users FROM platform_events WHERE {_FAILED} GROUP BY ALL""",
        "failures DESC, source", 50,
    ),
)
def _(t):
    return insight.auth_failures(t.platform_events, None, "source")


@query(
    "auth_failures_by_user",
    _top(
        f"""SELECT tenant_id, attributes['user.name'] AS "user", count(*) AS failures,
            count(DISTINCT attributes['source.ip']) AS sources FROM platform_events WHERE {_FAILED} GROUP BY ALL""",
        'failures DESC, "user"', 50,
    ),
)
def _(t):
    return insight.auth_failures(t.platform_events, None, "user")


@query(
    "nxdomain_names",
    _top(
        """SELECT tenant_id, attributes['dns.question.name'] AS name, count(*) AS queries FROM platform_events
           WHERE attributes['dns.response_code'] = 'NXDOMAIN' GROUP BY ALL""",
        "queries DESC, name", 50,
    ),
)
def _(t):
    return insight.nxdomain_names(t.platform_events, None)


@query(
    "recent_events",
    "SELECT tenant_id, event_id, event_type, summary FROM ("
    + _top(
        """SELECT tenant_id, event_id, event_type, summary, observed_at FROM platform_events
           WHERE event_category = 'network'""",
        "observed_at DESC, event_id", 100,
    )
    + ")",
)
def _(t):
    rows = insight.recent_events(t.platform_events, None, "network", tie="event_id")
    return rows.select("tenant_id", "event_id", "event_type", "summary")


@query(
    "denials_for",
    """WITH ranked AS (SELECT e.tenant_id, e.resource_id, event_id,
           row_number() OVER (PARTITION BY e.tenant_id, e.resource_id ORDER BY observed_at DESC, event_id) AS rn
         FROM platform_events AS e JOIN resources AS r ON r.tenant_id = e.tenant_id AND r.id = e.resource_id
         WHERE event_category = 'network' AND event_type = 'denied' AND r.status = 'up')
       SELECT tenant_id, resource_id, event_id FROM ranked WHERE rn <= 50""",
)
def _(t):
    up = t.resources.where("status = 'up'").select("tenant_id", F.col("id").alias("resource_id"))
    return insight.denials_for(t.platform_events, up, tie="event_id").select("tenant_id", "resource_id", "event_id")


_SIX = ("logs", "metrics", "events", "states", "flows", "spans")


@query(
    "signal_freshness",
    """WITH days AS (SELECT tenant_id, 'logs' AS s FROM logs WHERE observed_at >= TIMESTAMP '2024-01-01' AND observed_at < TIMESTAMP '2024-01-02'
         UNION ALL SELECT tenant_id, 'metrics' FROM metrics WHERE observed_at >= TIMESTAMP '2024-01-01' AND observed_at < TIMESTAMP '2024-01-02'
         UNION ALL SELECT tenant_id, 'events' FROM platform_events WHERE observed_at >= TIMESTAMP '2024-01-01' AND observed_at < TIMESTAMP '2024-01-02'
         UNION ALL SELECT tenant_id, 'states' FROM states WHERE observed_at >= TIMESTAMP '2024-01-01' AND observed_at < TIMESTAMP '2024-01-02'
         UNION ALL SELECT tenant_id, 'flows' FROM flows WHERE observed_at >= TIMESTAMP '2024-01-01' AND observed_at < TIMESTAMP '2024-01-02'
         UNION ALL SELECT tenant_id, 'spans' FROM spans WHERE observed_at >= TIMESTAMP '2024-01-01' AND observed_at < TIMESTAMP '2024-01-02'),
       tenants AS (SELECT DISTINCT tenant_id FROM resources),
       wide AS (SELECT tenants.tenant_id, count(*) FILTER (s = 'logs') AS logs, count(*) FILTER (s = 'metrics') AS metrics,
         count(*) FILTER (s = 'events') AS events, count(*) FILTER (s = 'states') AS states,
         count(*) FILTER (s = 'flows') AS flows, count(*) FILTER (s = 'spans') AS spans
         FROM tenants LEFT JOIN days USING (tenant_id) GROUP BY ALL)
       SELECT *, CASE WHEN logs + metrics + events + states + flows = 0 THEN 'silent'
                      WHEN logs > 0 AND metrics > 0 AND events > 0 AND states > 0 AND flows > 0 THEN 'quiet'
                      ELSE 'partial' END AS verdict FROM wide""",
)
def _(t):
    signals = {s: getattr(t, _VIEW[s]) for s in _SIX}
    return insight.signal_freshness(signals, t.resources, start=JAN1, end=JAN2)


_SLOS = """SELECT DISTINCT tenant_id, service_id, 'slo-' || service_id AS slo_id,
    CASE WHEN cast(substr(service_id, 4) as int) % 3 = 0 THEN cast(0.6 as double) WHEN cast(substr(service_id, 4) as int) % 3 = 1 THEN cast(0.65 as double) ELSE cast(0.9 as double) END AS target,
    1 + cast(substr(service_id, 4) as int) % 28 AS window_days FROM spans
    UNION ALL SELECT DISTINCT tenant_id, 'nothing', 'slo-nothing', cast(0.99 as double), 30 FROM spans"""


@query(
    "slo_report",
    f"""WITH slos AS ({_SLOS}),
        counted AS (SELECT o.tenant_id, o.slo_id, o.service_id, o.target, o.window_days, count(s.span_id) AS requests,
            count(*) FILTER (s.status_code = 'error') AS errors
            FROM slos AS o LEFT JOIN spans AS s ON s.tenant_id = o.tenant_id AND s.service_id = o.service_id
              AND s.observed_at >= TIMESTAMP '2024-01-26' - o.window_days * INTERVAL '1' DAY AND s.observed_at < TIMESTAMP '2024-01-26'
            GROUP BY ALL),
        rated AS (SELECT *, CASE WHEN requests > 0 THEN (requests - errors) / requests END AS sli FROM counted),
        used AS (SELECT *, (1 - sli) / (1 - target) AS budget FROM rated)
        SELECT tenant_id, slo_id, service_id, round(target, 6) AS target, window_days, requests, errors, round(sli, 6) AS sli,
          round(budget, 6) AS budget_used,
          CASE WHEN budget IS NULL THEN 'unknown' WHEN budget > 1 THEN 'missed' WHEN budget >= 0.75 THEN 'at-risk' ELSE 'met' END AS verdict
        FROM used""",
)
def _(t):
    return insight.slo_report(t.sql(_SLOS), t.spans, F.lit("2024-01-26").cast("timestamp"))
