"""Alert evaluation, maintenance windows and incidents."""

from __future__ import annotations

from pyspark.sql import functions as F

from beaconry.operators import alerts, correlate, incidents, maintenance
from beaconry.plans.registry import query

_NOW = "2024-01-20 12:00:00"


def now():
    return F.lit(_NOW).cast("timestamp")


# Rules with a window each: a day, a week or thirty seconds, which is read as a minute.
_SPANS = """SELECT *, cast(CASE WHEN tenant_id = 't1' THEN 86400 WHEN tenant_id = 't2' THEN 30 ELSE 604800 END as bigint) AS span_seconds,
    cast(CASE WHEN tenant_id = 't1' THEN 86400 WHEN tenant_id = 't2' THEN 30 ELSE 604800 END as bigint) AS after_seconds FROM rules"""

query(
    "alert_threshold_values",
    f"""WITH spans_ AS ({_SPANS})
        SELECT m.tenant_id, rule_id, resource_id, round(avg(value), 6) AS value, avg(value) > max(threshold) AS breaching
        FROM metrics AS m JOIN spans_ AS r ON r.tenant_id = m.tenant_id AND r.metric = m.metric
        WHERE observed_at < TIMESTAMP '{_NOW}' AND observed_at >= TIMESTAMP '{_NOW}' - greatest(span_seconds, 60) * INTERVAL '1' SECOND
        GROUP BY ALL""",
)(
    lambda t: alerts.threshold_values(
        t.metrics, t.sql(_SPANS), now(), match=["metric"], func="avg", field="value", longest_seconds=604800
    )
    .join(t.rules.select("tenant_id", "rule_id", "op", "threshold"), ["tenant_id", "rule_id"])
    .withColumn("breaching", alerts.holds("value", "op", "threshold"))
    .select("tenant_id", "rule_id", "resource_id", "value", "breaching")
)
query(
    "alert_count_values",
    f"""WITH spans_ AS ({_SPANS})
        SELECT m.tenant_id, rule_id, resource_id, 'kind=' || m.metric AS labels, count(*) AS value
        FROM metrics AS m JOIN spans_ AS r ON r.tenant_id = m.tenant_id
        WHERE observed_at < TIMESTAMP '{_NOW}' AND observed_at >= TIMESTAMP '{_NOW}' - greatest(span_seconds, 60) * INTERVAL '1' SECOND
        GROUP BY m.tenant_id, rule_id, resource_id, m.metric""",
)(lambda t: alerts.threshold_values(t.metrics, t.sql(_SPANS), now(), labels={"kind": F.col("metric")}, longest_seconds=604800))

# Every rule expects every host of its tenant that is in service.
_EXPECTED = """SELECT r.tenant_id, r.rule_id, d.id AS resource_id FROM rules AS r JOIN resources AS d ON d.tenant_id = r.tenant_id
    WHERE d.kind = 'host' AND d.status <> 'decommissioned'"""
query(
    "alert_absence_values",
    f"""WITH spans_ AS ({_SPANS}), expected AS ({_EXPECTED}),
        heard AS (SELECT e.tenant_id, e.rule_id, e.resource_id, any_value(s.after_seconds) AS after_seconds, max(m.observed_at) AS last
          FROM expected AS e JOIN spans_ AS s ON s.tenant_id = e.tenant_id AND s.rule_id = e.rule_id
          LEFT JOIN metrics AS m ON m.tenant_id = e.tenant_id AND m.resource_id = e.resource_id AND m.observed_at < TIMESTAMP '{_NOW}'
            AND m.observed_at >= TIMESTAMP '{_NOW}' - greatest(s.after_seconds, 60) * INTERVAL '1' SECOND GROUP BY ALL),
        aged AS (SELECT *, CASE WHEN last IS NULL THEN greatest(after_seconds, 60) + 1
          ELSE (epoch_ms(TIMESTAMP '{_NOW}') - epoch_ms(last)) / 1000 END AS value FROM heard)
        SELECT tenant_id, rule_id, resource_id, round(value, 6) AS value, value > after_seconds AS breaching FROM aged""",
)(lambda t: alerts.absence_values(t.metrics, t.sql(_SPANS), t.sql(_EXPECTED), now()))

_CASES = """SELECT event_id, value, op, 12.31 AS bound FROM metrics CROSS JOIN (SELECT 'gt' AS op UNION ALL SELECT 'gte'
    UNION ALL SELECT 'lt' UNION ALL SELECT 'lte' UNION ALL SELECT 'eq' UNION ALL SELECT 'ne') AS ops"""
query(
    "alert_compare",
    f"""SELECT event_id, op, CASE op WHEN 'gt' THEN value > 12.31 WHEN 'gte' THEN value >= 12.31 WHEN 'lt' THEN value < 12.31
        WHEN 'lte' THEN value <= 12.31 WHEN 'eq' THEN value = 12.31 ELSE value <> 12.31 END AS holds FROM ({_CASES})""",
)(
    lambda t: t.sql(_CASES).select(
        "event_id", "op", alerts.holds("value", "op", F.col("bound").cast("double")).alias("holds")
    )
)
query(
    "alert_dedup_key",
    r"""SELECT doc_id, 'r1/' || resource_id || '/' || CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'rack=rack' || (doc_id % 13) || ',' END
        || 'region=' || replace(replace(replace(service_name || '=a,b\c', '\', '\\'), '=', '\='), ',', '\,') AS key FROM logs""",
)(
    lambda t: t.logs.select(
        "doc_id",
        alerts.dedup_key(
            F.lit("r1"), "resource_id",
            F.transform_values("attributes", lambda k, v: F.when(k == "region", F.concat(v, F.lit("=a,b\\c"))).otherwise(v)),
        ).alias("key"),
    )
)

# The machine by recursion over each series' evaluations, one step a row.
_FSM = """WITH RECURSIVE numbered AS (SELECT tenant_id, dedup_key, evaluation_id, happened_at, breaching, hold_seconds,
        row_number() OVER (PARTITION BY tenant_id, dedup_key ORDER BY happened_at, evaluation_id) AS rn FROM evaluations),
    walk AS (SELECT tenant_id, dedup_key, evaluation_id, rn, happened_at,
        CASE WHEN NOT breaching THEN 'ok' WHEN hold_seconds <= 0 THEN 'firing' ELSE 'pending' END AS phase, happened_at AS since,
        breaching AND hold_seconds <= 0 AS notify FROM numbered WHERE rn = 1
      UNION ALL
      SELECT n.tenant_id, n.dedup_key, n.evaluation_id, n.rn, n.happened_at,
        CASE WHEN n.breaching THEN CASE WHEN w.phase = 'firing' THEN 'firing'
               WHEN w.phase = 'pending' THEN CASE WHEN n.happened_at - w.since >= n.hold_seconds * INTERVAL '1' SECOND THEN 'firing' ELSE 'pending' END
               WHEN n.hold_seconds <= 0 THEN 'firing' ELSE 'pending' END
             WHEN w.phase = 'firing' THEN 'resolved' ELSE 'ok' END,
        CASE WHEN n.breaching AND w.phase = 'firing' THEN w.since
             WHEN n.breaching AND w.phase = 'pending' AND NOT n.happened_at - w.since >= n.hold_seconds * INTERVAL '1' SECOND THEN w.since ELSE n.happened_at END,
        CASE WHEN n.breaching THEN CASE WHEN w.phase = 'firing' THEN false
               WHEN w.phase = 'pending' THEN n.happened_at - w.since >= n.hold_seconds * INTERVAL '1' SECOND ELSE n.hold_seconds <= 0 END
             ELSE w.phase = 'firing' END
      FROM walk AS w JOIN numbered AS n ON n.tenant_id = w.tenant_id AND n.dedup_key = w.dedup_key AND n.rn = w.rn + 1)"""
query(
    "alert_fsm",
    f"{_FSM} SELECT tenant_id, dedup_key, evaluation_id, phase, epoch_ms(since) AS since, notify FROM walk",
)(
    lambda t: alerts.alert_phases(t.evaluations, order=["happened_at", "evaluation_id"]).select(
        "tenant_id", "dedup_key", "evaluation_id", "phase", "since", "notify"
    )
)
query(
    "alert_state_upsert",
    """WITH joined AS (SELECT coalesce(o.tenant_id, n.tenant_id) AS tenant_id, coalesce(o.dedup_key, n.dedup_key) AS dedup_key,
         o.state AS was, n.state AS became, o.since AS os, n.since AS ns, o.last_value AS ov, n.last_value AS nv, o.acked_by AS ack,
         o.dedup_key IS NOT NULL AS stored, n.dedup_key IS NOT NULL AND (n.state IN ('pending', 'firing') OR coalesce(o.state, '') IN ('pending', 'firing')) AS written
       FROM alert_states AS o FULL JOIN alert_cycle AS n ON n.tenant_id = o.tenant_id AND n.dedup_key = o.dedup_key)
       SELECT tenant_id, dedup_key, CASE WHEN written THEN became ELSE was END AS state, epoch_ms(CASE WHEN written THEN ns ELSE os END) AS since,
         round(CASE WHEN written THEN nv ELSE ov END, 6) AS last_value, CASE WHEN NOT written OR was = became THEN ack END AS acked_by
       FROM joined WHERE stored OR written""",
)(
    lambda t: alerts.state_upsert(t.alert_states, t.alert_cycle).select(
        "tenant_id", "dedup_key", "state", "since", "last_value", "acked_by"
    )
)
query(
    "active_alerts",
    """SELECT s.tenant_id, s.dedup_key, s.state, r.name AS rule, r.severity, coalesce(d.name, s.resource_id) AS resource FROM alert_states AS s
       JOIN rules AS r ON r.tenant_id = s.tenant_id AND r.rule_id = s.rule_id
       LEFT JOIN resources AS d ON d.tenant_id = s.tenant_id AND d.id = s.resource_id WHERE s.state IN ('pending', 'firing')""",
)(
    lambda t: correlate.active_alerts(t.alert_states, t.rules, t.resources).select(
        "tenant_id", "dedup_key", "state", "rule", "severity", "resource"
    )
)
query(
    "alert_order",
    """SELECT tenant_id, dedup_key, state, epoch_ms(since) AS since FROM alert_states WHERE state IN ('pending', 'firing')
       ORDER BY state <> 'firing', alert_states.since, dedup_key""",
)(
    lambda t: alerts.alert_order(
        t.alert_states.where("state IN ('pending', 'firing')").select("tenant_id", "dedup_key", "state", "since")
    )
)

# --- maintenance ---

# Occurrences enumerated by hand: Dhaka is six hours ahead all year.
_OPEN = """WITH placed AS (SELECT *, CASE WHEN timezone = 'Asia/Dhaka' THEN INTERVAL '6' HOUR ELSE INTERVAL '0' HOUR END AS shift FROM windows),
    days AS (SELECT p.*, cast(p.starts_at + p.shift as date) + cast(g.i as int) AS d FROM placed AS p, range(0, 120) AS g(i)),
    occur AS (SELECT tenant_id, window_id, target_kind, target_id, until, suppress_alerts, suppress_notifications,
        cast(d as timestamp) + ((starts_at + shift) - date_trunc('day', starts_at + shift)) - shift AS opens, duration_minutes FROM days
      WHERE CASE recurrence WHEN 'once' THEN d = cast(starts_at + shift as date) WHEN 'daily' THEN true
        WHEN 'weekly' THEN isodow(d) - 1 = weekday ELSE day(d) = day END)"""
# Every metric sample taken while a window covered its device.
query(
    "maintenance_open",
    f"""{_OPEN}, reach AS (SELECT window_id, tenant_id, target_id AS resource_id FROM windows WHERE target_kind = 'resource'
        UNION ALL SELECT w.window_id, w.tenant_id, g.resource_id FROM windows AS w JOIN group_members AS g ON g.tenant_id = w.tenant_id AND g.group_id = w.target_id WHERE w.target_kind = 'group'
        UNION ALL SELECT w.window_id, w.tenant_id, r.id FROM windows AS w JOIN resources AS r ON r.tenant_id = w.tenant_id AND r.site_id = w.target_id WHERE w.target_kind = 'site')
        SELECT DISTINCT o.window_id, m.event_id FROM reach AS x JOIN occur AS o ON o.tenant_id = x.tenant_id AND o.window_id = x.window_id
        JOIN metrics AS m ON m.tenant_id = x.tenant_id AND m.resource_id = x.resource_id
        WHERE m.observed_at >= opens AND m.observed_at < opens + duration_minutes * INTERVAL '1' MINUTE AND (until IS NULL OR m.observed_at <= until)""",
)(
    lambda t: maintenance.covered(t.windows, t.resources, t.group_members)
    .join(t.metrics.select("tenant_id", "resource_id", "observed_at", "event_id"), ["tenant_id", "resource_id"])
    .where(maintenance.is_open(F.col("observed_at")))
    .select("window_id", "event_id")
)
_AT = "2024-01-06 15:00:00"
_FLAGS = f"""{_OPEN}, open_now AS (SELECT DISTINCT tenant_id, target_kind, target_id, suppress_alerts, suppress_notifications FROM occur
      WHERE TIMESTAMP '{_AT}' >= opens AND TIMESTAMP '{_AT}' < opens + duration_minutes * INTERVAL '1' MINUTE
        AND (until IS NULL OR TIMESTAMP '{_AT}' <= until)),
    hit AS (SELECT tenant_id, target_id AS resource_id, suppress_alerts AS a, suppress_notifications AS n FROM open_now WHERE target_kind = 'resource'
      UNION ALL SELECT o.tenant_id, g.resource_id, suppress_alerts, suppress_notifications FROM open_now AS o
        JOIN group_members AS g ON g.tenant_id = o.tenant_id AND g.group_id = o.target_id WHERE target_kind = 'group'
      UNION ALL SELECT o.tenant_id, r.id, suppress_alerts, suppress_notifications FROM open_now AS o
        JOIN resources AS r ON r.tenant_id = o.tenant_id AND r.site_id = o.target_id WHERE target_kind = 'site'
      UNION ALL SELECT tenant_id, id, true, true FROM resources WHERE status IN ('maintenance', 'decommissioned')),
    flags AS (SELECT tenant_id, resource_id, bool_or(a) AS alerts, bool_or(n) AS notifications FROM hit GROUP BY ALL)"""


def _flags(t):
    return maintenance.suppression(t.windows, t.resources, t.group_members, F.lit(_AT).cast("timestamp"))


query("alert_suppression", f"{_FLAGS} SELECT * FROM flags")(_flags)
query(
    "alert_unsuppressed",
    f"""{_FLAGS} SELECT e.tenant_id, e.dedup_key, e.evaluation_id, coalesce(f.notifications, false) AS silent FROM evaluations AS e
        LEFT JOIN flags AS f ON f.tenant_id = e.tenant_id AND f.resource_id = e.resource_id WHERE NOT coalesce(f.alerts, false)""",
)(
    lambda t: alerts.apply_suppression(t.evaluations, _flags(t)).select(
        "tenant_id", "dedup_key", "evaluation_id", "silent"
    )
)

# --- notifications: outcomes depend on earlier outcomes, so the checking SQL walks a tenant's attempts by recursion ---

_BUDGETS = "SELECT DISTINCT tenant_id, 40 AS budget_per_day FROM attempts"
_CHANNELS = "SELECT DISTINCT tenant_id, channel_id, 2 AS max_per_minute FROM attempts"
_THROTTLED = """WITH RECURSIVE ranked AS MATERIALIZED (SELECT tenant_id, channel_id, attempt_id, epoch_us(happened_at) AS us,
      row_number() OVER (PARTITION BY tenant_id ORDER BY happened_at, attempt_id) AS n FROM attempts),
    walked AS (
      SELECT DISTINCT tenant_id, NULL::VARCHAR AS channel_id, NULL::BIGINT AS attempt_id, 0::BIGINT AS n, 0::BIGINT AS day, 0::BIGINT AS sent,
        []::STRUCT(channel VARCHAR, us BIGINT)[] AS held, NULL::VARCHAR AS outcome FROM ranked
      UNION ALL
      SELECT tenant_id, channel_id, attempt_id, n, day, before + CASE outcome WHEN 'sent' THEN 1 ELSE 0 END,
        CASE outcome WHEN 'sent' THEN list_append(live, {'channel': channel_id, 'us': us}) ELSE live END, outcome
      FROM (SELECT *, CASE WHEN before >= 40 THEN 'over_budget' WHEN len(list_filter(live, lambda h: h.channel = channel_id)) >= 2
            THEN 'rate_limited' ELSE 'sent' END AS outcome
        FROM (SELECT r.*, r.us // 86400000000 AS day, CASE WHEN r.us // 86400000000 = w.day THEN w.sent ELSE 0 END AS before,
              list_filter(w.held, lambda h: h.us > r.us - 60000000) AS live
            FROM walked AS w JOIN ranked AS r ON r.tenant_id = w.tenant_id AND r.n = w.n + 1)))
    SELECT tenant_id, channel_id, attempt_id, outcome FROM walked WHERE n > 0"""
query("notify_throttle", _THROTTLED)(
    lambda t: alerts.notify_throttle(t.attempts.withColumnRenamed("happened_at", "at"), t.sql(_BUDGETS), t.sql(_CHANNELS)).select(
        "tenant_id", "channel_id", "attempt_id", "outcome"
    )
)

# --- incidents ---


def _events(t):
    """Phase changes of every series, as grouping consumes them."""
    phases = alerts.alert_phases(t.evaluations, order=["happened_at", "evaluation_id"])
    kind = (
        F.when((F.col("phase") == "firing") & F.col("notify"), "fire")
        .when(F.col("phase") == "pending", "pending")
        .when(F.col("phase").isin("resolved", "ok"), "clear")
    )
    return (
        phases.withColumn("kind", kind)
        .where(F.col("kind").isNotNull())
        .select(
            "tenant_id", F.col("happened_at").alias("at"), F.col("evaluation_id").cast("string").alias("event_id"), "kind", "rule_id",
            "resource_id", "dedup_key",
        )
    )


query(
    "incident_time_islands",
    """WITH gaps AS (SELECT *, CASE WHEN happened_at - lag(happened_at) OVER w <= INTERVAL '5' MINUTE THEN 0 ELSE 1 END AS cut FROM firings
         WINDOW w AS (PARTITION BY tenant_id ORDER BY happened_at, evaluation_id))
       SELECT tenant_id, evaluation_id, sum(cut) OVER (PARTITION BY tenant_id ORDER BY happened_at, evaluation_id ROWS UNBOUNDED PRECEDING) AS island FROM gaps""",
)(
    lambda t: incidents.time_islands(t.firings, ("happened_at", "evaluation_id")).select("tenant_id", "evaluation_id", "island")
)
query("incident_group")(
    lambda t: incidents.incident_group(_events(t), t.edges).select(
        "tenant_id", "event_id", "incident_id", "joined", "notify", "reason"
    )
)
query(
    "incident_candidate",
    """WITH members AS (SELECT tenant_id, incident_id, resource_id, min(first_alert_at) AS first_alert_at FROM member_rows GROUP BY ALL),
       up AS (SELECT DISTINCT tenant_id, source_id AS lower, target_id AS upper FROM edges
         WHERE kind IN ('depends_on', 'member_of', 'hosts', 'runs') AND source_id <> target_id),
       up2 AS (SELECT * FROM up UNION SELECT a.tenant_id, a.lower, b.upper FROM up AS a JOIN up AS b ON b.tenant_id = a.tenant_id AND b.lower = a.upper WHERE a.lower <> b.upper),
       roots AS (SELECT m.* FROM members AS m WHERE NOT EXISTS (SELECT 1 FROM members AS o JOIN up2 AS u
         ON u.tenant_id = o.tenant_id AND u.upper = o.resource_id
         WHERE o.tenant_id = m.tenant_id AND o.incident_id = m.incident_id AND u.lower = m.resource_id)),
       sizes AS (SELECT tenant_id, incident_id, count(*) AS n, min(resource_id) AS only_one FROM members GROUP BY ALL),
       best AS (SELECT tenant_id, incident_id, min(first_alert_at) AS earliest FROM roots GROUP BY ALL),
       tie AS (SELECT r.tenant_id, r.incident_id, count(*) AS n, min(r.resource_id) AS who FROM roots AS r
         JOIN best AS b ON b.tenant_id = r.tenant_id AND b.incident_id = r.incident_id AND b.earliest = r.first_alert_at GROUP BY ALL)
       SELECT s.tenant_id, s.incident_id, CASE WHEN s.n = 1 THEN s.only_one WHEN t.n = 1 THEN t.who END AS candidate_id,
         CASE WHEN s.n = 1 OR t.n = 1 THEN NULL ELSE 'disconnected' END AS absent_because
       FROM sizes AS s LEFT JOIN tie AS t ON t.tenant_id = s.tenant_id AND t.incident_id = s.incident_id""",
)(
    lambda t: incidents.incident_candidate(
        t.member_rows.groupBy("tenant_id", "incident_id", "resource_id").agg(F.min("first_alert_at").alias("first_alert_at")),
        t.edges,
    )
)
query(
    "incident_rollup",
    """SELECT i.tenant_id, i.incident_id, i.state, count(a.dedup_key) AS alerts, count(*) FILTER (NOT a.notified) AS suppressed
       FROM incidents AS i LEFT JOIN incident_alerts AS a ON a.tenant_id = i.tenant_id AND a.incident_id = i.incident_id GROUP BY ALL""",
)(
    lambda t: incidents.incident_rollup(t.incidents, t.incident_alerts).select(
        "tenant_id", "incident_id", "state", "alerts", "suppressed"
    )
)
query(
    "incident_quiet",
    f"""WITH live AS (SELECT DISTINCT a.tenant_id, a.incident_id FROM incident_alerts AS a JOIN alert_states AS s
          ON s.tenant_id = a.tenant_id AND s.dedup_key = a.dedup_key WHERE s.state IN ('pending', 'firing'))
        SELECT i.tenant_id, i.incident_id, CASE WHEN i.state = 'open' AND l.incident_id IS NULL THEN 'quiet' ELSE i.state END AS state,
          CASE WHEN i.state = 'open' AND l.incident_id IS NULL THEN epoch_ms(TIMESTAMP '{_NOW}') END AS quiet_at
        FROM incidents AS i LEFT JOIN live AS l ON l.tenant_id = i.tenant_id AND l.incident_id = i.incident_id""",
)(
    lambda t: incidents.incident_quiet(t.incidents, t.incident_alerts, t.alert_states, now()).select(
        "tenant_id", "incident_id", "state", "quiet_at"
    )
)
