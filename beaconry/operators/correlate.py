"""Joins between signals and inventory: service map, trace lookups, alerts, topology."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconry.functions.quantiles import exact_quantiles
from beaconry.functions.scalars import errors
from beaconry.functions.series import first_per_group
from beaconry.operators.graph import CABLE
from beaconry.operators.query import limited, read
from beaconry.schemas import NIL_ID

HEX_ID = re.compile(r"^[0-9a-fA-F]+$")


def service_map(spans: DataFrame, tenant: str | None, limit: int | None = None, **window) -> DataFrame:
    """Calls, errors and 95th percentile between services: all pairs, or each tenant's busiest `limit`.

    Both ends carry the tenant and the window: a span id is chosen by its sender, so it may not
    be trusted to stay within a tenant.
    """
    rows = read(spans, tenant, **window)
    parents = rows.where((F.col("service_id") != NIL_ID) & (F.col("span_id") != "")).select(
        "tenant_id", F.col("span_id").alias("parent_span_id"), F.col("service_id").alias("from_service")
    )
    children = rows.where((F.col("parent_span_id") != "") & (F.col("service_id") != NIL_ID)).select(
        "tenant_id", "parent_span_id", F.col("service_id").alias("to_service"), "duration_ns", "status_code"
    )
    calls = children.join(parents, ["tenant_id", "parent_span_id"]).where(
        F.col("from_service") != F.col("to_service")
    )
    edges = exact_quantiles(
        calls, ["tenant_id", "from_service", "to_service"], "duration_ns", {"p95": 0.95},
        count="calls", flags={"errors": errors()},
    )
    if limit is None:
        return edges
    return first_per_group(edges, ["tenant_id"], [F.col("calls").desc(), F.col("from_service"), F.col("to_service")], limit)


def hex_id(value: str) -> str:
    """A trace or span id in its stored spelling."""
    value = value.strip()
    if not HEX_ID.match(value):
        raise ValueError(f"{value!r} is not a hexadecimal id")
    return value.lower()


def rows_of(df: DataFrame, column: str, ids: DataFrame, tie: str, limit: int | None = None) -> DataFrame:
    """The rows for each id in a set of (tenant_id, `column`): all, or the oldest `limit`."""
    wanted = ids.select("tenant_id", F.lower(F.trim(F.col(column))).alias(column)).where(
        F.col(column).rlike("^[0-9a-f]+$")
    )
    rows = df.join(wanted.distinct(), ["tenant_id", column], "left_semi")
    if limit is None:
        return rows
    return first_per_group(rows, ["tenant_id", column], [F.col("observed_at"), F.col(tie)], limit)


def row_lookup(df: DataFrame, tenant: str, column: str, value: str, tie: str, limit: int | None = None, **window) -> DataFrame:
    """The rows for one id, oldest first."""
    rows = read(df, tenant, where=F.col(column) == hex_id(value), **window)
    return limited(rows.orderBy("observed_at", tie), limit)


def trace_spans(spans: DataFrame, traces: DataFrame, limit: int | None = None) -> DataFrame:
    return rows_of(spans, "trace_id", traces, "span_id", limit)


def trace_logs(logs: DataFrame, traces: DataFrame, tie: str = "span_id", limit: int | None = None) -> DataFrame:
    return rows_of(logs, "trace_id", traces, tie, limit)


def span_children(spans: DataFrame, parents: DataFrame, limit: int | None = None) -> DataFrame:
    return rows_of(spans, "parent_span_id", parents, "span_id", limit)


def active_alerts(states: DataFrame, rules: DataFrame, resources: DataFrame) -> DataFrame:
    """Pending and firing alerts with their rule and the resource's name, or its id."""
    named = rules.select("tenant_id", "rule_id", F.col("name").alias("rule"), "severity")
    inventory = resources.select("tenant_id", F.col("id").alias("resource_id"), F.col("name").alias("_name"))
    return (
        states.where(F.col("state").isin("pending", "firing"))
        .join(named, ["tenant_id", "rule_id"])
        .join(inventory, ["tenant_id", "resource_id"], "left")
        .withColumn("resource", F.coalesce("_name", "resource_id"))
        .drop("_name")
    )


def _cables(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("kind") == CABLE)


def topology_nodes(resources: DataFrame, edges: DataFrame) -> DataFrame:
    """Resources with a cable to something, decommissioned ones left out."""
    cabled = (
        _cables(edges)
        .select("tenant_id", F.explode(F.array("source_id", "target_id")).alias("id"))
        .distinct()
    )
    return (
        resources.where(F.col("status") != "decommissioned")
        .join(cabled, ["tenant_id", "id"], "left_semi")
        .select("tenant_id", "id", "name", "kind", "status")
    )


def topology_edges(resources: DataFrame, edges: DataFrame) -> DataFrame:
    """Cables whose both ends are still in service."""
    live = resources.where(F.col("status") != "decommissioned").select("tenant_id", "id")
    end = lambda name: live.withColumnRenamed("id", name)
    return (
        _cables(edges)
        .join(end("source_id"), ["tenant_id", "source_id"], "left_semi")
        .join(end("target_id"), ["tenant_id", "target_id"], "left_semi")
        .select("tenant_id", "source_id", "target_id", "discovered_by")
    )


def neighbour_evidence(resources: DataFrame, edges: DataFrame) -> DataFrame:
    """Neighbours of every node with the protocol that saw them; any protocol beats ARP."""
    cables = topology_edges(resources, edges)
    ends = cables.select("tenant_id", F.col("source_id").alias("id"), F.col("target_id").alias("neighbour_id"), "discovered_by")
    ends = ends.unionByName(
        cables.select("tenant_id", F.col("target_id").alias("id"), F.col("source_id").alias("neighbour_id"), "discovered_by")
    ).where(F.col("id") != F.col("neighbour_id"))
    strength = F.struct((F.col("discovered_by") == "arp").alias("weak"), F.col("discovered_by"))
    best = ends.groupBy("tenant_id", "id", "neighbour_id").agg(
        F.min_by("discovered_by", strength).alias("discovered_by")
    )
    names = resources.select("tenant_id", F.col("id").alias("neighbour_id"), "name")
    return best.join(names, ["tenant_id", "neighbour_id"]).select(
        "tenant_id", "id", "neighbour_id", "name", "discovered_by"
    )
