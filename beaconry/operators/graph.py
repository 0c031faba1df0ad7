"""Walks over the resource graph, many roots at once, and connected components.

A walk is breadth-first: each round joins the frontier to the edges and drops what was seen, so it
ends on a cycle and finds the least depth of every node. Rounds are materialised in the checkpoint
folder, which keeps each round's plan small and lets lost executors be replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconry.session import cut_lineage

# Edge kinds that mean one resource needs another (fixed values).
DEPENDENCY = ("depends_on", "member_of", "hosts", "runs")
CABLE = "connected_to"


def _walk(hops: DataFrame, resources: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    """`hops` is (tenant_id, at, to); `roots` is (tenant_id, resource_id)."""
    known = resources.select("tenant_id", F.col("id").alias("resource_id"))
    seen = (
        roots.select("tenant_id", "resource_id")
        .distinct()
        .join(known, ["tenant_id", "resource_id"], "left_semi")
        .select("tenant_id", F.col("resource_id").alias("root_id"), "resource_id", F.lit(0).alias("depth"))
    )
    seen = frontier = cut_lineage(seen)
    hops = cut_lineage(hops.where(F.col("at") != F.col("to")).distinct())
    for depth in range(1, max_depth + 1):
        reached = (
            frontier.join(hops.withColumnRenamed("at", "resource_id"), ["tenant_id", "resource_id"])
            .select("tenant_id", "root_id", F.col("to").alias("resource_id"))
            .distinct()
            .join(seen, ["tenant_id", "root_id", "resource_id"], "left_anti")
            .withColumn("depth", F.lit(depth))
        )
        frontier = cut_lineage(reached)
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def walk_dependents(edges: DataFrame, resources: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    """What needs each root: (tenant_id, root_id, resource_id, depth), the root at depth 0."""
    down = edges.where(F.col("kind").isin(*DEPENDENCY)).select(
        "tenant_id", F.col("target_id").alias("at"), F.col("source_id").alias("to")
    )
    return _walk(down, resources, roots, max_depth)


def walk_dependencies(edges: DataFrame, resources: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    """What each root needs."""
    up = edges.where(F.col("kind").isin(*DEPENDENCY)).select(
        "tenant_id", F.col("source_id").alias("at"), F.col("target_id").alias("to")
    )
    return _walk(up, resources, roots, max_depth)


def both_ways(edges: DataFrame) -> DataFrame:
    near = edges.where(F.col("kind").isin(CABLE, *DEPENDENCY))
    return near.select("tenant_id", F.col("source_id").alias("at"), F.col("target_id").alias("to")).unionByName(
        near.select("tenant_id", F.col("target_id").alias("at"), F.col("source_id").alias("to"))
    )


def walk_neighbourhood(edges: DataFrame, resources: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    """Everything within `max_depth` hops of each root in any direction, cables included."""
    return _walk(both_ways(edges), resources, roots, max_depth)


def direct_children(resources: DataFrame, parents: DataFrame) -> DataFrame:
    """Resources whose parent is in a set, by name."""
    wanted = parents.select("tenant_id", F.col("resource_id").alias("parent_id"))
    return (
        resources.join(wanted.distinct(), ["tenant_id", "parent_id"], "left_semi")
        .select("tenant_id", "parent_id", F.col("id").alias("resource_id"), "name")
        .orderBy("tenant_id", "parent_id", "name", "resource_id")
    )


def direct_members(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Sources of `member_of` edges into a set."""
    wanted = targets.select("tenant_id", F.col("resource_id").alias("target_id"))
    return (
        edges.where(F.col("kind") == "member_of")
        .join(wanted.distinct(), ["tenant_id", "target_id"], "left_semi")
        .select("tenant_id", F.col("target_id").alias("parent_id"), F.col("source_id").alias("resource_id"))
        .distinct()
    )


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Connected components as (tenant_id, id, component_id, size); a component is its least id.

    Alternates two contractions that each link nodes to the least neighbour they know: larger
    neighbours first, then smaller ones. Only minima are aggregated, so a hub with very many edges
    is combined before it is shuffled, and the rounds grow with the logarithm of the path length.
    """
    links = (
        edges.select("tenant_id", F.greatest("source_id", "target_id").alias("u"), F.least("source_id", "target_id").alias("v"))
        .where(F.col("u") != F.col("v"))
        .distinct()
    )
    links = cut_lineage(links)
    before = _fingerprint(links)
    while True:
        flipped = links.select("tenant_id", F.col("v").alias("u"), F.col("u").alias("v"))
        around = links.unionByName(flipped)
        least = around.groupBy("tenant_id", "u").agg(F.min("v").alias("_m")).withColumn("m", F.least("u", "_m"))
        large = (
            around.where(F.col("v") > F.col("u"))
            .join(least.select("tenant_id", "u", "m"), ["tenant_id", "u"])
            .select("tenant_id", F.col("v").alias("u"), F.col("m").alias("v"))
            .where(F.col("u") != F.col("v"))
            .distinct()
        )
        large = cut_lineage(large)
        root = large.groupBy("tenant_id", "u").agg(F.min("v").alias("m"))
        small = (
            large.join(root, ["tenant_id", "u"])
            .where(F.col("v") != F.col("m"))
            .select("tenant_id", F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(root.select("tenant_id", "u", F.col("m").alias("v")))
            .distinct()
        )
        links = cut_lineage(small)
        after = _fingerprint(links)
        if after == before:
            break
        before = after
    label = nodes.select("tenant_id", "id").distinct().join(
        links.select("tenant_id", F.col("u").alias("id"), F.col("v").alias("_root")), ["tenant_id", "id"], "left"
    ).select("tenant_id", "id", F.coalesce("_root", "id").alias("component_id"))
    sizes = label.groupBy("tenant_id", "component_id").agg(F.count(F.lit(1)).alias("size"))
    return label.join(sizes, ["tenant_id", "component_id"]).select("tenant_id", "id", "component_id", "size")


def _fingerprint(links: DataFrame) -> tuple:
    """Row count and order-free checksum; two numbers, whatever the size."""
    digest = F.sum(F.xxhash64("tenant_id", "u", "v").cast("decimal(38,0)"))
    row = links.agg(F.count(F.lit(1)), digest).first()
    return row[0], row[1]
