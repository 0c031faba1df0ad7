"""Recurring maintenance windows and what they suppress."""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconry.functions.binding import let

# Longest window, in days (fixed values).
MAX_DAYS = 7


def validate(windows: DataFrame) -> DataFrame:
    """Windows with a `problem` column, null when there is none."""
    return windows.withColumn(
        "problem",
        F.when(~known_zone(F.col("timezone")), "unknown timezone")
        .when(F.col("duration_minutes") < 1, "too short")
        .when(F.col("duration_minutes") > MAX_DAYS * 24 * 60, "too long")
        .when((F.col("recurrence") == "monthly") & ~F.col("day").between(1, 31), "bad day of month")
        .when(F.col("until") < F.col("starts_at"), "ends before it starts"),
    )


def known_zone(zone: Column) -> Column:
    return zone.isin(*sorted(zoneinfo.available_timezones()))


def is_open(at: Column) -> Column:
    """Whether the window in this row is open at an instant.

    A window keeps its local hour across daylight-saving changes. A local time that a change skips
    does not occur; one that happens twice is taken the first time. An unknown zone is never open,
    so that alerts keep working. Occurrences that began up to a full duration ago are considered.
    """
    known = known_zone(F.col("timezone"))
    zone = F.when(known, F.col("timezone")).otherwise("UTC")
    first = F.from_utc_timestamp("starts_at", zone)
    local = F.struct(
        zone.alias("zone"), F.to_date(first).alias("first"),
        F.pmod(F.unix_seconds(first), F.lit(86_400)).alias("second"),
        F.to_date(F.from_utc_timestamp(at, zone)).alias("today"),
    )

    def covers(day: Column, here: Column) -> Column:
        recurs = (
            F.when(F.col("recurrence") == "once", day == here.first)
            .when(F.col("recurrence") == "daily", F.lit(True))
            # Monday is 0.
            .when(F.col("recurrence") == "weekly", F.weekday(day) == F.col("weekday"))
            .when(F.col("recurrence") == "monthly", F.dayofmonth(day) == F.col("day"))
            .otherwise(False)
        )
        wanted = F.timestamp_seconds(F.unix_date(day) * 86_400 + here.second)
        start = F.to_utc_timestamp(wanted, here.zone)
        happens = F.from_utc_timestamp(start, here.zone) == wanted
        end = start + F.make_dt_interval(mins=F.col("duration_minutes"))
        return (day >= here.first) & recurs & happens & (at >= start) & (at < end)

    back = F.ceil(F.col("duration_minutes") / 1440).cast("int") + 1

    def occurs(here: Column) -> Column:
        return F.exists(F.sequence(F.date_sub(here.today, back), here.today), lambda day: covers(day, here))

    return (
        known
        & (at >= F.col("starts_at"))
        & F.coalesce(at <= F.col("until"), F.lit(True))
        & let(local, occurs)
    )


def covered(windows: DataFrame, resources: DataFrame, group_members: DataFrame) -> DataFrame:
    """Each window's resources: itself, a group's members, or everything on a site."""
    kind = lambda k: windows.where(F.col("target_kind") == k)
    one = kind("resource").withColumn("resource_id", F.col("target_id"))
    members = group_members.select("tenant_id", F.col("group_id").alias("target_id"), "resource_id")
    placed = resources.select("tenant_id", F.col("site_id").alias("target_id"), F.col("id").alias("resource_id"))
    return (
        one.unionByName(kind("group").join(members.distinct(), ["tenant_id", "target_id"]))
        .unionByName(kind("site").join(placed, ["tenant_id", "target_id"]))
    )


def suppression(windows: DataFrame, resources: DataFrame, group_members: DataFrame, at: Column) -> DataFrame:
    """Resources that should not alert: (tenant_id, resource_id, alerts, notifications).

    `alerts` means a series is not evaluated; `notifications` that it is, silently. Several causes
    combine to the stronger of each.
    """
    open_now = covered(windows.where(is_open(at)), resources, group_members).select(
        "tenant_id", "resource_id", F.col("suppress_alerts").alias("alerts"),
        F.col("suppress_notifications").alias("notifications"),
    )
    held = resources.where(F.col("status").isin("maintenance", "decommissioned")).select(
        "tenant_id", F.col("id").alias("resource_id"), F.lit(True).alias("alerts"), F.lit(True).alias("notifications")
    )
    return held.unionByName(open_now).groupBy("tenant_id", "resource_id").agg(
        F.max("alerts").alias("alerts"), F.max("notifications").alias("notifications")
    )
