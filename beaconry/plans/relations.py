"""Selectors, joins and graph walks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from beaconry.operators import correlate, graph, selectors
from beaconry.operators.query import read
from beaconry.plans.registry import query

WIDE = "event_id, resource_id"


def _selected(resources):
    """Metric rows of a selection."""
    return lambda t: read(t.metrics, None, resources=resources(t)).select("event_id", "resource_id")


query("select_all", f"SELECT {WIDE} FROM metrics")(_selected(lambda t: selectors.select_all(t.resources)))

# Every second customer by its present id, every aliased one by its old id, and ids nobody has.
_NAMED = """SELECT tenant_id, id AS resource_id FROM resources WHERE kind = 'host' AND status = 'up'
    UNION ALL SELECT tenant_id, alias_id FROM aliases UNION ALL SELECT tenant_id, 'ghost' FROM resources"""

query(
    "select_ids",
    f"""WITH named AS ({_NAMED}),
        now AS (SELECT DISTINCT n.tenant_id, coalesce(a.resource_id, n.resource_id) AS resource_id
                FROM named AS n LEFT JOIN aliases AS a ON a.tenant_id = n.tenant_id AND a.alias_id = n.resource_id),
        known AS (SELECT n.* FROM now AS n JOIN resources AS r ON r.tenant_id = n.tenant_id AND r.id = n.resource_id)
        SELECT event_id, m.resource_id FROM metrics AS m JOIN known AS k ON k.tenant_id = m.tenant_id AND k.resource_id = m.resource_id""",
)(_selected(lambda t: selectors.select_ids(t.sql(_NAMED), t.aliases, t.resources)))


def _in(where: str) -> str:
    return (
        f"SELECT event_id, m.resource_id FROM metrics AS m JOIN resources AS r ON r.tenant_id = m.tenant_id "
        f"AND r.id = m.resource_id WHERE {where}"
    )


query("select_kind", _in("r.kind = 'host'"))(_selected(lambda t: selectors.select_kind(t.resources, "host")))
query("select_site", _in("r.site_id = 'site3'"))(_selected(lambda t: selectors.select_site(t.resources, "site3")))
query("select_tagged", _in("r.tags['segment'] = 'MACHINERY'"))(
    _selected(lambda t: selectors.select_tagged(t.resources, "segment", "MACHINERY"))
)
query(
    "select_group",
    """SELECT event_id, m.resource_id FROM metrics AS m JOIN group_members AS g ON g.tenant_id = m.tenant_id
       AND g.resource_id = m.resource_id WHERE g.group_id = 'BUILDING'""",
)(_selected(lambda t: selectors.select_group(t.group_members, "BUILDING")))


def _walk_sql(step: str, roots: str, depth: int, kinds: str) -> str:
    """Path enumeration with a cycle guard, as a recursive statement."""
    return f"""WITH RECURSIVE hops AS ({step.format(kinds=kinds)}),
      walk AS (SELECT r.tenant_id, r.id AS root_id, r.id AS resource_id, 0 AS depth, [r.id] AS path FROM resources AS r WHERE {roots}
        UNION ALL
        SELECT w.tenant_id, w.root_id, h.b, w.depth + 1, list_append(w.path, h.b) FROM walk AS w
        JOIN hops AS h ON h.tenant_id = w.tenant_id AND h.a = w.resource_id
        WHERE w.depth < {depth} AND NOT list_contains(w.path, h.b)),
      reached AS (SELECT tenant_id, root_id, resource_id, min(depth) AS depth FROM walk GROUP BY ALL)"""


_DEP = "kind IN ('depends_on', 'member_of', 'hosts', 'runs')"
_NEAR = "kind IN ('connected_to', 'depends_on', 'member_of', 'hosts', 'runs')"
_DOWN = "SELECT DISTINCT tenant_id, target_id AS a, source_id AS b FROM edges WHERE {kinds}"
_UP = "SELECT DISTINCT tenant_id, source_id AS a, target_id AS b FROM edges WHERE {kinds}"
_BOTH = """SELECT DISTINCT tenant_id, source_id AS a, target_id AS b FROM edges WHERE {kinds}
           UNION SELECT DISTINCT tenant_id, target_id, source_id FROM edges WHERE {kinds}"""

query(
    "select_descendants",
    _walk_sql(_DOWN, "r.kind = 'device' AND r.status = 'up'", 3, _DEP)
    + """, chosen AS (SELECT DISTINCT tenant_id, resource_id FROM reached)
       SELECT event_id, m.resource_id FROM metrics AS m JOIN chosen AS c ON c.tenant_id = m.tenant_id AND c.resource_id = m.resource_id""",
)(
    _selected(
        lambda t: selectors.select_descendants(
            t.edges, t.resources,
            t.resources.where("kind = 'device' AND status = 'up'").select("tenant_id", F.col("id").alias("resource_id")), 3,
        )
    )
)


def _roots(t, where: str):
    return t.resources.where(where).select("tenant_id", F.col("id").alias("resource_id"))


query(
    "walk_dependents",
    _walk_sql(_DOWN, "r.kind = 'site'", 4, _DEP) + " SELECT * FROM reached",
)(lambda t: graph.walk_dependents(t.edges, t.resources, _roots(t, "kind = 'site'"), 4))
query(
    "walk_dependencies",
    _walk_sql(_UP, "r.kind = 'host'", 5, _DEP) + " SELECT * FROM reached",
)(lambda t: graph.walk_dependencies(t.edges, t.resources, _roots(t, "kind = 'host'"), 5))
query(
    "walk_neighbourhood",
    _walk_sql(_BOTH, "r.kind = 'device'", 2, _NEAR) + " SELECT * FROM reached",
)(lambda t: graph.walk_neighbourhood(t.edges, t.resources, _roots(t, "kind = 'device'"), 2))


@query(
    "direct_members",
    "SELECT DISTINCT tenant_id, target_id AS parent_id, source_id AS resource_id FROM edges WHERE kind = 'member_of'",
)
def _(t):
    everything = t.resources.select("tenant_id", F.col("id").alias("resource_id"))
    return graph.direct_members(t.edges, everything)


@query(
    "direct_children",
    """SELECT r.tenant_id, r.parent_id, r.id AS resource_id, r.name FROM resources AS r JOIN resources AS p
       ON p.tenant_id = r.tenant_id AND p.id = r.parent_id WHERE p.kind = 'device'""",
)
def _(t):
    return graph.direct_children(t.resources, _roots(t, "kind = 'device'"))


# Cables join rings of six suppliers; the least id of a ring is found by walking it.
query(
    "components",
    """WITH RECURSIVE cables AS (SELECT tenant_id, source_id AS a, target_id AS b FROM edges WHERE kind = 'connected_to'
         UNION SELECT tenant_id, target_id, source_id FROM edges WHERE kind = 'connected_to'),
       reach AS (SELECT tenant_id, id, id AS other FROM resources
         UNION SELECT r.tenant_id, r.id, c.b FROM reach AS r JOIN cables AS c ON c.tenant_id = r.tenant_id AND c.a = r.other)
       SELECT tenant_id, id, min(other) AS component_id, count(*) AS size FROM reach GROUP BY tenant_id, id""",
)(lambda t: graph.components(t.resources, t.edges.where("kind = 'connected_to'")))


@query(
    "inventory_page",
    """WITH wanted AS (SELECT r.id, r.name, r.kind, r.status FROM resources AS r WHERE r.tenant_id = 't2' AND r.kind = 'host'
         AND contains(lower(r.name), 'customer') AND r.id > 'c12'),
       page AS (SELECT *, (SELECT count(*) FROM wanted) > 40 AS has_more FROM wanted ORDER BY id LIMIT 40)
       SELECT * FROM page""",
)
def _(t):
    page = selectors.inventory_page(
        t.resources, "t2", kind="host", name_contains="CUSTOMER", after="c12", limit=40
    )
    return page.select("id", "name", "kind", "status", "has_more")


@query(
    "inventory_page_group",
    """WITH wanted AS (SELECT r.id, r.name FROM resources AS r JOIN group_members AS g ON g.tenant_id = r.tenant_id AND g.resource_id = r.id
         WHERE r.tenant_id = 't1' AND g.group_id = 'BUILDING')
       SELECT *, (SELECT count(*) FROM wanted) > 5000 AS has_more FROM wanted ORDER BY id LIMIT 5000""",
)
def _(t):
    members = selectors.select_group(t.group_members, "BUILDING")
    return selectors.inventory_page(t.resources, "t1", group=members, limit=5000).select("id", "name", "has_more")


@query(
    "group_summary",
    """SELECT g.tenant_id, g.group_id, g.name, count(m.resource_id) AS members FROM groups AS g
       LEFT JOIN group_members AS m ON m.tenant_id = g.tenant_id AND m.group_id = g.group_id GROUP BY ALL""",
)
def _(t):
    return selectors.group_summary(t.groups, t.group_members)


# --- joins ---


@query(
    "service_map",
    """WITH calls AS (SELECT c.tenant_id, p.service_id AS from_service, c.service_id AS to_service, c.duration_ns, c.status_code
         FROM spans AS c JOIN spans AS p ON p.tenant_id = c.tenant_id AND p.span_id = c.parent_span_id
         WHERE c.parent_span_id <> '' AND c.service_id <> p.service_id
           AND c.observed_at >= TIMESTAMP '2024-01-01' AND c.observed_at < TIMESTAMP '2024-02-01'
           AND p.observed_at >= TIMESTAMP '2024-01-01' AND p.observed_at < TIMESTAMP '2024-02-01'),
       grouped AS (SELECT tenant_id, from_service, to_service, count(*) AS calls, count(*) FILTER (status_code = 'error') AS errors,
         round(quantile_cont(duration_ns, 0.95), 0) AS p95 FROM calls GROUP BY ALL)
       SELECT * FROM grouped""",
)
def _(t):
    edges = correlate.service_map(t.spans, None, start=dt.datetime(2024, 1, 1), end=dt.datetime(2024, 2, 1))
    return edges.withColumn("p95", F.round("p95", 0))


# The traces with a failed span.
_FAILED = "SELECT DISTINCT tenant_id, upper(trace_id) AS trace_id FROM spans WHERE status_code = 'error'"
_ROWS = "SELECT {out} FROM {table} WHERE {where}"

query(
    "trace_spans",
    _ROWS.format(
        out="tenant_id, trace_id, span_id, epoch_ms(observed_at) AS observed_at", table="spans",
        where="trace_id IN (SELECT trace_id FROM spans WHERE status_code = 'error')",
    ),
)(lambda t: correlate.trace_spans(t.spans, t.sql(_FAILED)).select("tenant_id", "trace_id", "span_id", "observed_at"))
query(
    "trace_logs",
    _ROWS.format(
        out="tenant_id, trace_id, doc_id", table="logs",
        where="trace_id <> '' AND (tenant_id, trace_id) IN (SELECT tenant_id, trace_id FROM spans WHERE status_code = 'error')",
    ),
)(lambda t: correlate.trace_logs(t.logs, t.sql(_FAILED), tie="doc_id").select("tenant_id", "trace_id", "doc_id"))
query(
    "span_children",
    _ROWS.format(
        out="tenant_id, parent_span_id, span_id", table="spans",
        where="parent_span_id <> '' AND (tenant_id, parent_span_id) IN (SELECT tenant_id, span_id FROM spans WHERE status_code = 'error')",
    ),
)(
    lambda t: correlate.span_children(
        t.spans, t.sql("SELECT tenant_id, span_id AS parent_span_id FROM spans WHERE status_code = 'error'")
    ).select("tenant_id", "parent_span_id", "span_id")
)
query("trace_lookup", "SELECT span_id, service_id FROM spans WHERE tenant_id = 't2' AND trace_id = lpad('7', 32, '0')")(
    lambda t: correlate.row_lookup(t.spans, "t2", "trace_id", "0" * 31 + "7", "span_id").select("span_id", "service_id")
)


@query(
    "alias_resolve",
    f"""WITH named AS ({_NAMED}) SELECT n.tenant_id, coalesce(a.resource_id, n.resource_id) AS resource_id, count(*) AS n
        FROM named AS n LEFT JOIN aliases AS a ON a.tenant_id = n.tenant_id AND a.alias_id = n.resource_id GROUP BY ALL""",
)
def _(t):
    return selectors.resolve_alias(t.sql(_NAMED), t.aliases).groupBy("tenant_id", "resource_id").agg(F.count("*").alias("n"))


@query(
    "topology_nodes",
    """SELECT tenant_id, id, name, kind, status FROM resources AS r WHERE status <> 'decommissioned' AND EXISTS (
       SELECT 1 FROM edges AS e WHERE e.tenant_id = r.tenant_id AND e.kind = 'connected_to' AND (e.source_id = r.id OR e.target_id = r.id))""",
)
def _(t):
    return correlate.topology_nodes(t.resources, t.edges)


_LIVE = """SELECT e.tenant_id, e.source_id, e.target_id, e.discovered_by FROM edges AS e
    JOIN resources AS a ON a.tenant_id = e.tenant_id AND a.id = e.source_id JOIN resources AS b ON b.tenant_id = e.tenant_id AND b.id = e.target_id
    WHERE e.kind = 'connected_to' AND a.status <> 'decommissioned' AND b.status <> 'decommissioned'"""


@query("topology_view", _LIVE)
def _(t):
    return correlate.topology_edges(t.resources, t.edges)


@query(
    "neighbour_evidence",
    f"""WITH live AS ({_LIVE}), ends AS (SELECT tenant_id, source_id AS id, target_id AS neighbour_id, discovered_by FROM live
          UNION ALL SELECT tenant_id, target_id, source_id, discovered_by FROM live)
        SELECT e.tenant_id, e.id, e.neighbour_id, r.name, coalesce(min(discovered_by) FILTER (discovered_by <> 'arp'), 'arp') AS discovered_by
        FROM ends AS e JOIN resources AS r ON r.tenant_id = e.tenant_id AND r.id = e.neighbour_id GROUP BY ALL""",
)
def _(t):
    return correlate.neighbour_evidence(t.resources, t.edges)
