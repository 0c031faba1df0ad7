"""Resource selectors: each yields a DataFrame of (tenant_id, resource_id).

Reads semi-join telemetry to the result, so a selector that finds nothing selects no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconry.operators.graph import walk_dependents

KEYS = ["tenant_id", "resource_id"]

def _ids(resources: DataFrame) -> DataFrame:
    return resources.select("tenant_id", F.col("id").alias("resource_id"))


def select_all(resources: DataFrame) -> None:
    """No predicate: a read given no selector covers every resource of the tenant."""
    return None


def resolve_alias(ids: DataFrame, aliases: DataFrame) -> DataFrame:
    """Historical ids replaced by the surviving ones."""
    return ids.join(
        aliases.select("tenant_id", F.col("alias_id").alias("resource_id"), F.col("resource_id").alias("_now")),
        KEYS,
        "left",
    ).withColumn("resource_id", F.coalesce("_now", "resource_id")).drop("_now")


def select_ids(ids: DataFrame, aliases: DataFrame, resources: DataFrame) -> DataFrame:
    """Named ids through their aliases; unknown and foreign ids are dropped."""
    return resolve_alias(ids.select(*KEYS), aliases).join(_ids(resources), KEYS).distinct()


def select_kind(resources: DataFrame, kind: str) -> DataFrame:
    return _ids(resources.where(F.col("kind") == kind))


def select_site(resources: DataFrame, site_id: str) -> DataFrame:
    return _ids(resources.where(F.col("site_id") == site_id))


def select_group(group_members: DataFrame, group_id: str) -> DataFrame:
    return group_members.where(F.col("group_id") == group_id).select(*KEYS).distinct()


def select_tagged(resources: DataFrame, key: str, value: str) -> DataFrame:
    if not key:
        raise ValueError("a tag selector needs a key")
    return _ids(resources.where(F.try_element_at("tags", F.lit(key)) == value))


def select_descendants(edges: DataFrame, resources: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """Roots and everything that depends on them, to a depth of at least one."""
    if depth < 1:
        raise ValueError("a descendant selector walks at least one step")
    return walk_dependents(edges, resources, roots, depth).select(*KEYS).distinct()


def inventory_page(
    resources: DataFrame,
    tenant: str,
    *,
    after: str | None = None,
    kind: str | None = None,
    site_id: str | None = None,
    status: str | None = None,
    name_contains: str | None = None,
    group: DataFrame | None = None,
    limit: int | None = None,
) -> DataFrame:
    """One keyset page by id, with `has_more` telling whether another follows; all rows without a limit."""
    rows = resources.where(F.col("tenant_id") == tenant)
    for column, wanted in (("kind", kind), ("site_id", site_id), ("status", status)):
        if wanted is not None:
            rows = rows.where(F.col(column) == wanted)
    if after is not None:
        rows = rows.where(F.col("id") > after)
    if name_contains is not None:
        rows = rows.where(F.lower("name").contains(name_contains.lower()))
    if group is not None:
        members = group.select("tenant_id", F.col("resource_id").alias("id"))
        rows = rows.join(members, ["tenant_id", "id"], "left_semi")
    if limit is None:
        return rows.orderBy("id").withColumn("has_more", F.lit(False))
    if limit < 1:
        raise ValueError("a page holds at least one row")
    # One row more than the page says whether there is another.
    over = rows.orderBy("id").limit(limit + 1)
    count = over.agg((F.count(F.lit(1)) > limit).alias("has_more"))
    return over.orderBy("id").limit(limit).crossJoin(F.broadcast(count))


def group_summary(groups: DataFrame, group_members: DataFrame) -> DataFrame:
    """Every group with how many members it has, empty ones included."""
    counted = group_members.groupBy("tenant_id", "group_id").agg(F.count("resource_id").alias("_n"))
    return groups.join(counted, ["tenant_id", "group_id"], "left").select(
        "tenant_id", "group_id", "name", F.coalesce("_n", F.lit(0)).alias("members")
    )
