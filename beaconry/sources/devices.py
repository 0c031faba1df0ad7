"""Rows from decoded flow records and device readings, and inventory facts added to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconry.functions.scalars import address_key
from beaconry.schemas import NIL_ID


# --- flows ---

# Uptimes are milliseconds in 32 bits and wrap (fixed values).
UPTIME_WRAP = 4_294_967_296


def absolute(exported_at: Column, header_uptime: Column, uptime: Column) -> Column:
    """The instant of an uptime, given the uptime at export; the counter may have wrapped."""
    ago = F.pmod(header_uptime.cast("long") - uptime.cast("long"), F.lit(UPTIME_WRAP))
    return F.timestamp_millis(F.unix_millis(exported_at) - ago)


def v5_sampling(field: Column) -> Column:
    """The rate in a 16-bit sampling field: two bits of mode, fourteen of interval."""
    mode = F.shiftright(field, 14).bitwiseAND(F.lit(3))
    return F.when(mode == 0, F.lit(1)).otherwise(F.greatest(field.bitwiseAND(F.lit(0x3FFF)), F.lit(1)))


def flow_normalise(decoded: DataFrame) -> DataFrame:
    """Flow rows from decoded records (exported_at, header_uptime, first_uptime, last_uptime, …).

    A sampling rate is at least one, since everything multiplies by it. Nullable interface and AS
    numbers stay null.
    """
    return (
        decoded.withColumn("started_at", absolute(F.col("exported_at"), F.col("header_uptime"), F.col("first_uptime")))
        .withColumn("observed_at", absolute(F.col("exported_at"), F.col("header_uptime"), F.col("last_uptime")))
        .withColumn("sampling_rate", F.greatest(F.coalesce("sampling_rate", F.lit(1)), F.lit(1)).cast("long"))
        .withColumn("src_address", address_key("src_address"))
        .withColumn("dst_address", address_key("dst_address"))
        .drop("exported_at", "header_uptime", "first_uptime", "last_uptime")
    )


# --- readings ---


def snmp_scalars(readings: DataFrame, requests: DataFrame) -> DataFrame:
    """Metric rows for requested metrics a device answered.

    `readings` is (tenant_id, resource_id, oid, value, observed_at) and `requests` (metric, oid,
    unit). An agent may answer `x.0` for `x`; the exact one is preferred when both came.
    """
    asked = requests.select(
        "metric", "unit", F.explode(F.array("oid", F.concat("oid", F.lit(".0")))).alias("oid"), F.col("oid").alias("_asked")
    )
    matched = readings.join(asked, "oid")
    # The shorter of the two spellings is the exact one.
    best = F.min_by(F.struct("value"), F.length("oid")).alias("_best")
    return (
        matched.groupBy("tenant_id", "resource_id", "observed_at", "metric", "unit")
        .agg(best)
        .select(
            "tenant_id", "resource_id", "observed_at", "metric", F.col("_best.value").try_cast("double").alias("value"),
            "unit", F.create_map().cast("map<string,string>").alias("labels"),
        )
    )


def snmp_scalars_missing(readings: DataFrame, requests: DataFrame) -> DataFrame:
    """How many requested metrics each poll of a device did not answer."""
    poll = ["tenant_id", "resource_id", "observed_at"]
    found = (
        snmp_scalars(readings, requests)
        .groupBy(*poll)
        .agg(F.count_distinct("metric").alias("_found"))
    )
    wanted = requests.agg(F.count_distinct("metric").alias("_wanted"))
    polled = readings.select(*poll).distinct()
    return (
        polled.join(found, poll, "left")
        .crossJoin(F.broadcast(wanted))
        .select(*poll, (F.col("_wanted") - F.coalesce("_found", F.lit(0))).alias("skipped"))
    )


def snmp_interface_columns(readings: DataFrame, requests: DataFrame, names: DataFrame) -> DataFrame:
    """Metric rows for readings beneath a requested column, one per interface.

    What follows the column is the interface index. `names` is (tenant_id, resource_id, index,
    name); an interface without one is labelled by its index alone. A reading is matched by its own
    prefixes, so this is an equality join.
    """
    arcs = F.split("oid", r"\.")
    lengths = F.sequence(F.lit(1), F.greatest(F.size(arcs) - 1, F.lit(1)))
    prefixes = F.transform(lengths, lambda n: F.array_join(F.slice(arcs, 1, n), "."))
    asked = requests.select("metric", "unit", F.col("oid").alias("_column"))
    found = (
        readings.withColumn("_column", F.explode(prefixes))
        .join(asked, "_column")
        .where(F.length("oid") > F.length("_column"))
        .withColumn("index", F.substr("oid", F.length("_column") + 2))
        .join(names, ["tenant_id", "resource_id", "index"], "left")
    )
    index = F.create_map(F.lit("network.interface.index"), F.col("index"))
    named = F.create_map(
        F.lit("network.interface.index"), F.col("index"), F.lit("network.interface.name"), F.col("name")
    )
    return found.select(
        "tenant_id", "resource_id", "observed_at", "metric", F.col("value").try_cast("double").alias("value"), "unit",
        F.when(F.col("name").isNull(), index).otherwise(named).alias("labels"),
    )


# --- inventory ---


def enrich_site_vendor(rows: DataFrame, resources: DataFrame) -> DataFrame:
    """Set site and vendor from the inventory; an unknown resource has neither."""
    facts = resources.select(
        "tenant_id", F.col("id").alias("resource_id"), F.col("site_id").alias("_site"), F.col("vendor").alias("_vendor")
    )
    kept = [c for c in rows.columns if c not in ("site_id", "source_vendor")]
    return rows.select(*kept).join(facts, ["tenant_id", "resource_id"], "left").select(
        *kept, F.coalesce("_site", F.lit(NIL_ID)).alias("site_id"), F.coalesce("_vendor", F.lit("")).alias("source_vendor")
    )


def mac_hex(mac: Column) -> Column:
    """Twelve lower-case digits of a MAC address in any usual spelling; null for anything else."""
    bare = F.lower(F.regexp_replace(mac, r"[:\-. ]", ""))
    return F.when(bare.rlike("^[0-9a-f]{12}$"), bare)


def mac_vendor(df: DataFrame, registry: DataFrame, mac: str = "mac", out: str = "vendor") -> DataFrame:
    """Add the organisation holding the smallest registered block an address falls in.

    `registry` is (prefix, organisation) with 6, 7 or 9 lower-case hex digits. Group addresses and
    locally administered ones belong to nobody.
    """
    digits = mac_hex(F.col(mac))
    assigned = F.when(F.conv(F.substr(digits, F.lit(2), F.lit(1)), 16, 10).cast("int").bitwiseAND(F.lit(3)) == 0, digits)
    rows = df.withColumn("_mac", assigned)
    for width in (9, 7, 6):
        block = registry.where(F.length("prefix") == width).select(
            F.col("prefix").alias(f"_p{width}"), F.col("organisation").alias(f"_o{width}")
        )
        rows = rows.withColumn(f"_p{width}", F.substring("_mac", 1, width)).join(block, f"_p{width}", "left")
    return rows.select(*df.columns, F.coalesce("_o9", "_o7", "_o6").alias(out))
