"""Rollup tables of mergeable states, and readers that answer from them.

A reader refuses what its rollup cannot answer: nothing is derived from a state that lost it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconry.functions.scalars import errors, time_bucket

FIVE_MINUTES, HOUR = 300, 3600
SERVICE_QUANTILES = (0.5, 0.95, 0.99)


def rollup_logs_5m(logs: DataFrame) -> DataFrame:
    return logs.groupBy("tenant_id", "resource_id", "severity", time_bucket("observed_at", FIVE_MINUTES).alias("bucket")).agg(
        F.count(F.lit(1)).alias("cnt")
    )


def rollup_metrics_5m(metrics: DataFrame) -> DataFrame:
    """Labels are dropped; the average is kept as a sum and a count so that it merges."""
    return metrics.groupBy("tenant_id", "resource_id", "metric", time_bucket("observed_at", FIVE_MINUTES).alias("bucket")).agg(
        F.min("value").alias("min_v"), F.max("value").alias("max_v"),
        F.sum("value").alias("sum_v"), F.count("value").alias("cnt"),
    )


def rollup_metrics_1h(metrics_5m: DataFrame) -> DataFrame:
    """Built from the five-minute states, never from raw rows."""
    return metrics_5m.groupBy("tenant_id", "resource_id", "metric", time_bucket("bucket", HOUR).alias("bucket")).agg(
        F.min("min_v").alias("min_v"), F.max("max_v").alias("max_v"),
        F.sum("sum_v").alias("sum_v"), F.sum("cnt").alias("cnt"),
    )


def rollup_flows_5m(flows: DataFrame) -> DataFrame:
    """The source port is dropped; the sampling rate stays in the key."""
    return flows.groupBy(
        "tenant_id", "resource_id", time_bucket("observed_at", FIVE_MINUTES).alias("bucket"),
        "src_address", "dst_address", "dst_port", "protocol", "sampling_rate",
    ).agg(F.sum("bytes").alias("bytes"), F.sum("packets").alias("packets"), F.count(F.lit(1)).alias("records"))


def rollup_service_5m(spans: DataFrame) -> DataFrame:
    """The host is dropped, so a service on many hosts is one service. Latency is a sketch."""
    return spans.groupBy(
        "tenant_id", "service_id", "name", "kind", time_bucket("observed_at", FIVE_MINUTES).alias("bucket")
    ).agg(
        F.count(F.lit(1)).alias("requests"), F.sum(errors()).alias("errors"),
        F.kll_sketch_agg_bigint("duration_ns").alias("latency"),
    )


def rollup_distinct_5m(rows: DataFrame, keys: Sequence[str], value: str, precision: int = 12) -> DataFrame:
    """How many values are distinct, as sketches: a sum of distinct counts would count a value once a bucket.

    The standard error of an estimate is about 1.04 / 2^(precision / 2) of it (1.6 % by default), and far less for up
    to a few hundred values. A sketch takes up to 2^precision bytes.
    """
    return rows.groupBy(*keys, time_bucket("observed_at", FIVE_MINUTES).alias("bucket")).agg(
        F.hll_sketch_agg(value, precision).alias("distinct")
    )


# What merges the states of each rollup.
_MERGE = {
    "logs": {"cnt": F.sum},
    "metrics": {"min_v": F.min, "max_v": F.max, "sum_v": F.sum, "cnt": F.sum},
    "flows": {"bytes": F.sum, "packets": F.sum, "records": F.sum},
    "service": {"requests": F.sum, "errors": F.sum, "latency": F.kll_merge_agg_bigint},
    "distinct": {"distinct": F.hll_union_agg},
}


def merge_states(kind: str, parts: DataFrame) -> DataFrame:
    """Combine partial states of the same key, as a late row or a micro-batch leaves them."""
    states = _MERGE[kind]
    keys = [c for c in parts.columns if c not in states]
    return parts.groupBy(*keys).agg(*(f(c).alias(c) for c, f in states.items()))


def _check(kind: str, by: Sequence, offered: Sequence[str], wanted: Sequence[str], answers: dict) -> None:
    unknown = [k for k in by if isinstance(k, str) and k not in offered]
    if unknown:
        raise ValueError(f"the {kind} rollup does not keep {', '.join(unknown)}")
    missing = [f for f in wanted if f not in answers]
    if missing:
        raise ValueError(f"the {kind} rollup cannot answer {', '.join(missing)}")


def read_rollup_logs(rollup: DataFrame, by: Sequence[str | Column], wanted: Sequence[str] = ("count",)) -> DataFrame:
    answers = {"count": F.sum("cnt")}
    _check("log", by, rollup.columns, wanted, answers)
    return rollup.groupBy(*by).agg(*(answers[f].alias(f) for f in wanted))


def read_rollup_metrics(
    rollup: DataFrame, by: Sequence[str | Column], wanted: Sequence[str] = ("min", "max", "avg", "count")
) -> DataFrame:
    answers = {
        "min": F.min("min_v"), "max": F.max("max_v"), "sum": F.sum("sum_v"), "count": F.sum("cnt"),
        "avg": F.try_divide(F.sum("sum_v"), F.sum("cnt")),
    }
    _check("metric", by, rollup.columns, wanted, answers)
    return rollup.groupBy(*by).agg(*(answers[f].alias(f) for f in wanted))


def read_rollup_flows(
    rollup: DataFrame, by: Sequence[str | Column], wanted: Sequence[str] = ("bytes", "packets", "count")
) -> DataFrame:
    """A count is of records, not of rollup rows. Sums never cross sampling rates."""
    answers = {"bytes": F.sum("bytes"), "packets": F.sum("packets"), "count": F.sum("records")}
    _check("flow", by, rollup.columns, wanted, answers)
    if {"bytes", "packets"} & set(wanted) and "sampling_rate" not in by:
        raise ValueError("bytes and packets are only summed within one sampling rate")
    return rollup.groupBy(*by).agg(*(answers[f].alias(f) for f in wanted))


def read_rollup_service(
    rollup: DataFrame, by: Sequence[str | Column], quantiles: Sequence[float] = SERVICE_QUANTILES
) -> DataFrame:
    """Quantiles of merged sketches, never a quantile of quantiles."""
    if any(q not in SERVICE_QUANTILES for q in quantiles):
        raise ValueError(f"the service rollup offers the quantiles {SERVICE_QUANTILES}")
    _check("service", by, [c for c in rollup.columns if c != "latency"], (), {})
    merged = rollup.groupBy(*by).agg(
        F.sum("requests").alias("requests"), F.sum("errors").alias("errors"),
        F.kll_merge_agg_bigint("latency").alias("_latency"),
    )
    for q in quantiles:
        merged = merged.withColumn(f"p{round(q * 100)}", F.kll_sketch_get_quantile_bigint("_latency", F.lit(q)))
    return merged.drop("_latency")


def read_rollup_distinct(rollup: DataFrame, by: Sequence[str | Column]) -> DataFrame:
    """An estimate of the distinct values over all buckets and keys that are not in `by`, as `distinct`."""
    _check("distinct", by, [c for c in rollup.columns if c != "distinct"], (), {})
    return rollup.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("distinct"))
