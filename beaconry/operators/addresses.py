"""Declared address ranges: what they hold, what answers in them, and which to probe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beaconry.functions.scalars import ipv4_number, ipv4_text
from beaconry.operators.devices import device_guess


def cidr_bits(cidr: Column) -> Column:
    return F.regexp_extract(cidr, r"/(3[0-2]|[12]?[0-9])$", 1).try_cast("int")


def network(number: Column, bits: Column) -> Column:
    """The first address of the network of a size that holds an address."""
    size = F.pow(F.lit(2), 32 - bits).cast("long")
    return number - F.pmod(number, size)


def ranges(df: DataFrame, cidr: str = "cidr") -> DataFrame:
    """Add `network` and `bits` to declared ranges."""
    bits = cidr_bits(F.col(cidr))
    base = ipv4_number(F.regexp_extract(cidr, r"^([^/]*)/", 1))
    return df.withColumn("bits", bits).withColumn("network", network(base, F.col("bits")))


def capacity(bits: Column) -> Column:
    """Usable addresses: all of a /31 or /32, otherwise without the first and the last."""
    size = F.pow(F.lit(2), 32 - bits).cast("long")
    return F.when(bits >= 31, size).otherwise(size - 2)


def _in_ranges(addresses: DataFrame, subnets: DataFrame) -> DataFrame:
    """Addresses (tenant_id, number, …) with every declared range that holds them.

    Each address is looked up by its network at each size that is declared anywhere: an equality
    join, with at most 33 sizes.
    """
    sizes = subnets.agg(F.collect_set("bits").alias("_sizes"))
    return (
        addresses.crossJoin(F.broadcast(sizes))
        .withColumn("bits", F.explode("_sizes"))
        .withColumn("network", network(F.col("number"), F.col("bits")))
        .drop("_sizes")
        .join(subnets.select("tenant_id", "network", "bits", "id"), ["tenant_id", "network", "bits"])
        .drop("network", "bits")
    )


def subnet_utilisation(subnets: DataFrame, identifiers: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per range: capacity, and addresses assigned, responding, and responding without an owner."""
    claimed = (
        identifiers.where(F.col("kind") == "mgmt_ip")
        .select("tenant_id", ipv4_number("value").alias("number"), F.lit(1).alias("a"), F.lit(0).alias("r"))
    )
    answered = candidates.select(
        "tenant_id", ipv4_number("address").alias("number"), F.lit(0).alias("a"), F.lit(1).alias("r")
    )
    facts = (
        claimed.unionByName(answered)
        .where(F.col("number").isNotNull())
        .groupBy("tenant_id", "number")
        .agg(F.max("a").alias("a"), F.max("r").alias("r"))
    )
    declared = ranges(subnets)
    counted = _in_ranges(facts, declared).groupBy("tenant_id", "id").agg(
        F.sum("a").alias("_a"), F.sum("r").alias("_r"), F.sum(F.col("r") * (1 - F.col("a"))).alias("_u")
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return declared.join(counted, ["tenant_id", "id"], "left").select(
        *subnets.columns, capacity(F.col("bits")).alias("capacity"), zero("_a").alias("assigned"),
        zero("_r").alias("responding"), zero("_u").alias("unaccounted"),
    )


def subnet_addresses(
    subnets: DataFrame, identifiers: DataFrame, candidates: DataFrame, resources: DataFrame,
    registry: DataFrame | None = None,
) -> DataFrame:
    """Every address something is known about in each range, with its owner or a guess.

    An address that answers and that nobody claims is flagged, and only such a one is guessed at.
    """
    claimed = (
        identifiers.where(F.col("kind") == "mgmt_ip")
        .select("tenant_id", ipv4_number("value").alias("number"), "resource_id", "last_seen")
        .where(F.col("number").isNotNull())
        .groupBy("tenant_id", "number")
        # The latest claim; of equal ones the least id.
        .agg(F.min(F.struct((-F.unix_micros("last_seen")).alias("age"), "resource_id", "last_seen")).alias("_c"))
    )
    answered = (
        candidates.select("tenant_id", ipv4_number("address").alias("number"), "last_seen", "mac", "sys_name", "sys_descr")
        .where(F.col("number").isNotNull())
        .groupBy("tenant_id", "number")
        .agg(F.max(F.struct("last_seen", "mac", "sys_name", "sys_descr")).alias("_a"))
    )
    names = resources.select("tenant_id", F.col("id").alias("resource_id"), F.col("name").alias("resource_name"))
    both = (
        claimed.join(answered, ["tenant_id", "number"], "full")
        .select(
            "tenant_id", "number", "_c.resource_id", F.col("_a").isNotNull().alias("responding"),
            "_a.mac", "_a.sys_name", "_a.sys_descr",
            F.greatest("_c.last_seen", "_a.last_seen").alias("last_seen"),
        )
        .withColumn("unclaimed", F.col("responding") & F.col("resource_id").isNull())
    )
    placed = _in_ranges(both, ranges(subnets)).withColumnRenamed("id", "subnet_id")
    named = placed.join(names, ["tenant_id", "resource_id"], "left")
    guessed = device_guess(
        named.withColumn("hostname", F.col("sys_name")).withColumn("ttl", F.lit(None).cast("int")), registry
    )
    return guessed.select(
        "tenant_id", "subnet_id", ipv4_text("number").alias("address"), "resource_id", "resource_name", "responding",
        "unclaimed", "mac", "sys_name", "last_seen", F.when(F.col("unclaimed"), F.col("role")).alias("guess"),
        F.when(F.col("unclaimed"), F.col("confidence")).alias("confidence"),
    )


def range_problems(wanted: DataFrame) -> DataFrame:
    """Ranges that cannot be expanded, and why: (tenant_id, job_id, cidr, problem)."""
    return ranges(wanted).where(F.col("network").isNull()).select("tenant_id", "job_id", "cidr", F.lit("not a range").alias("problem"))


def range_expand(wanted: DataFrame, widest: int = 0, block: int = 1 << 12) -> DataFrame:
    """The distinct host addresses of each job's ranges (tenant_id, job_id, cidr), with `problem` null.

    A range that cannot be read, or that is wider than the prefix `widest`, is a row without an address
    and with its problem; the job's other ranges are expanded. A range is cut into blocks
    before it is expanded, so a wide one is not one task's work.
    """
    sized = ranges(wanted).withColumn(
        "problem", F.when(F.col("network").isNull(), "not a range").when(F.col("bits") < widest, "range too wide")
    )
    refused = sized.where("problem IS NOT NULL").select("tenant_id", "job_id", "cidr", F.lit(None).cast("string").alias("address"), "problem")
    last = F.col("network") + F.pow(F.lit(2), 32 - F.col("bits")).cast("long") - 1
    edge = F.when(F.col("bits") < 31, 1).otherwise(0)
    before = Window.partitionBy("tenant_id", "job_id").orderBy("_low", "_high").rowsBetween(Window.unboundedPreceding, -1)
    # What a job's earlier ranges hold is cut off a range, so that no address comes twice and none is compared with another.
    apart = (
        sized.where("problem IS NULL")
        .select("tenant_id", "job_id", (F.col("network") + edge).alias("_low"), (last - edge).alias("_high"))
        .distinct()
        .withColumn("_low", F.greatest("_low", F.max("_high").over(before) + 1))
        .where(F.col("_low") <= F.col("_high"))
    )
    # A number of partitions, as Spark would join blocks into few by the bytes they have before they are expanded.
    parts = int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = lambda low, high: F.explode(F.sequence(low, high))
    blocks = (
        apart.select("tenant_id", "job_id", "_low", "_high", each(F.floor(F.col("_low") / block), F.floor(F.col("_high") / block)).alias("_block"))
        .select(
            "tenant_id", "job_id", F.greatest("_low", F.col("_block") * block).alias("_low"),
            F.least("_high", F.col("_block") * block + block - 1).alias("_high"),
        )
        .repartition(parts, "tenant_id", "job_id", "_low")
    )
    # The text of the first three bytes is made once for the addresses that share it.
    nets = blocks.select("tenant_id", "job_id", "_low", "_high", each(F.shiftright("_low", 8), F.shiftright("_high", 8)).alias("_net")).select(
        "tenant_id", "job_id", F.greatest(F.col("_low") - F.col("_net") * 256, F.lit(0)).alias("_low"),
        F.least(F.col("_high") - F.col("_net") * 256, F.lit(255)).alias("_high"),
        F.concat(F.substring_index(ipv4_text(F.col("_net") * 256), ".", 3), F.lit(".")).alias("_start"),
    )
    hosts = nets.select("tenant_id", "job_id", "_start", each(F.col("_low"), F.col("_high")).alias("_n"))
    return hosts.select(
        "tenant_id", "job_id", F.lit(None).cast("string").alias("cidr"), F.concat("_start", F.col("_n").cast("string")).alias("address"),
        F.lit(None).cast("string").alias("problem"),
    ).unionByName(refused)
