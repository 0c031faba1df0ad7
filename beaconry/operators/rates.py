"""Sequence logic over series: counter rates, step classes, transitions and latest rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconry.functions.scalars import label_key, time_bucket
from beaconry.functions.series import SLICE_SECONDS, with_previous

SERIES = ["tenant_id", "resource_id", "metric", "_series"]


def _with_last_sample(metrics: DataFrame, tie: Sequence[str], slice_seconds: int) -> DataFrame:
    rows = metrics.withColumn("_series", label_key("labels"))
    return with_previous(
        rows, SERIES, ["observed_at", *tie], ["value", "observed_at"], "_last", slice_seconds
    ).drop("_series")


def counter_rate(
    metrics: DataFrame, tie: Sequence[str] = ("ingested_at",), slice_seconds: int = SLICE_SECONDS
) -> DataFrame:
    """Add `rate`, per second, of each counter sample since the one before it in its series.

    There is none for a first sample, for time that did not advance, or for a value that went
    backwards. Filters belong before this: the first sample in a window has no rate.
    """
    elapsed = (F.unix_millis("observed_at") - F.unix_millis("_last.observed_at")) / 1000
    forward = (F.col("observed_at") > F.col("_last.observed_at")) & (F.col("value") >= F.col("_last.value"))
    return (
        _with_last_sample(metrics, tie, slice_seconds)
        .withColumn("rate", F.when(forward, (F.col("value") - F.col("_last.value")) / elapsed))
        .drop("_last")
    )


def rate_agg(
    metrics: DataFrame, seconds: int = 300, by: Sequence[Column | str] = ("tenant_id", "resource_id"), **rate
) -> DataFrame:
    """Average and peak rate per bucket, busiest first."""
    if "value" not in metrics.columns:
        raise ValueError("a rate is computed from raw samples; a rollup does not keep them")
    if any(b == "rate" for b in by if isinstance(b, str)):
        raise ValueError("a rate cannot be grouped on")
    return (
        counter_rate(metrics, **rate)
        .groupBy(time_bucket("observed_at", seconds).alias("bucket"), *by)
        .agg(F.avg("rate").alias("per_second"), F.max("rate").alias("peak"))
        .orderBy(F.col("peak").desc_nulls_last(), "bucket", *by)
    )


def counter_step_class(
    metrics: DataFrame, width_bits: int, interval_seconds: float, tie: Sequence[str] = ("ingested_at",),
    slice_seconds: int = SLICE_SECONDS,
) -> DataFrame:
    """Add `step`: rate, wrapped, reset or no_time. The first sample of a series has none.

    A value that went backwards wrapped only when the counter is narrow and the samples are close
    enough together for it to have gone round once.
    """
    elapsed = F.unix_millis("observed_at") - F.unix_millis("_last.observed_at")
    close = elapsed < interval_seconds * 2000
    step = (
        F.when(F.col("_last").isNull(), F.lit(None).cast("string"))
        .when(elapsed <= 0, "no_time")
        .when(F.col("value") >= F.col("_last.value"), "rate")
        .when(close & F.lit(width_bits == 32), "wrapped")
        .otherwise("reset")
    )
    return _with_last_sample(metrics, tie, slice_seconds).withColumn("step", step).drop("_last")


# Statuses an operator sets, which a check may not announce a change out of (fixed values).
HELD = ("maintenance", "decommissioned")


def state_transitions(
    readings: DataFrame, resources: DataFrame, tie: Sequence[str] = ("ingested_at",),
    slice_seconds: int = SLICE_SECONDS,
) -> DataFrame:
    """Readings that changed a device's status, with the status they changed it from.

    The first reading is compared with the inventory. A reading is remembered even when its change
    is not announced, so after one swallowed change the next one is.
    """
    stored = resources.select("tenant_id", F.col("id").alias("resource_id"), F.col("status").alias("_stored"))
    rows = with_previous(
        readings, ["tenant_id", "resource_id"], ["observed_at", *tie], ["current_status"], "_last", slice_seconds
    ).join(stored, ["tenant_id", "resource_id"], "left")
    before = F.coalesce("_last.current_status", "_stored", F.lit("unknown"))
    return (
        rows.withColumn("previous_status", before)
        .where((F.col("previous_status") != F.col("current_status")) & ~F.col("previous_status").isin(*HELD))
        .withColumn("severity", F.when(F.col("current_status") == "up", "info").otherwise("error"))
        .select(*readings.columns)
    )


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest row of each key, combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(newest).select(*keys, "_row.*").select(*df.columns)


def lease_changes(observed: DataFrame, tie: Sequence[str] = (), slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """One row when a job's live holder differs from the one last seen.

    Expired observations are not handovers and are skipped; neither is the first sighting.
    """
    live = observed.where(F.col("live"))
    return (
        with_previous(live, ["job"], ["observed_at", *tie], ["holder"], "_last", slice_seconds)
        .where(F.col("_last.holder") != F.col("holder"))
        .select("job", "observed_at", F.col("_last.holder").alias("previous_holder"), "holder", *tie)
    )
