"""Screen-level questions, answered for every tenant in one job.

Each takes `tenant`; `None` answers for the whole estate, one top list per tenant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconry.functions.quantiles import exact_quantiles
from beaconry.functions.scalars import attr, errors
from beaconry.functions.series import first_per_group
from beaconry.operators.query import read

# Rows of a top list (fixed values).
TOP_TALKERS, TOP_SERVICES, TOP_ROWS = 25, 25, 50


def _is(category: str, kind: str) -> Column:
    return (F.col("event_category") == category) & (F.col("event_type") == kind)


def top_per_tenant(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return first_per_group(df, ["tenant_id"], order, n)


def top_talkers(flows: DataFrame, tenant: str | None, limit: int = TOP_TALKERS, **window) -> DataFrame:
    """Heaviest conversations. Differently sampled traffic is never added together."""
    keys = ["src_address", "dst_address", "dst_port", "protocol", "sampling_rate"]
    totals = (
        read(flows, tenant, **window)
        .groupBy("tenant_id", *keys)
        .agg(F.sum("bytes").alias("bytes"), F.sum("packets").alias("packets"))
    )
    return top_per_tenant(totals, [F.col("bytes").desc(), *map(F.col, keys)], limit)


def flow_estimate(flows: DataFrame) -> DataFrame:
    """Observed traffic scaled by its sampling rate, flagged when that is an estimate."""
    rate = F.greatest(F.col("sampling_rate"), F.lit(1))
    return (
        flows.withColumn("estimated_bytes", F.col("bytes") * rate)
        .withColumn("estimated_packets", F.col("packets") * rate)
        .withColumn("estimated", rate > 1)
    )


def service_latency(
    spans: DataFrame, tenant: str | None, limit: int = TOP_SERVICES, **window
) -> DataFrame:
    """Requests, errors and latency quantiles per service, slowest first."""
    full = exact_quantiles(
        read(spans, tenant, **window),
        ["tenant_id", "service_id"],
        "duration_ns",
        {"p50": 0.5, "p95": 0.95, "p99": 0.99},
        count="requests",
        flags={"errors": errors()},
    ).withColumn("error_rate", F.try_divide(F.col("errors"), F.col("requests")))
    return top_per_tenant(full, [F.col("p99").desc(), F.col("service_id")], limit)


def auth_failures(events: DataFrame, tenant: str | None, by: str, limit: int = TOP_ROWS, **window) -> DataFrame:
    """Failed sign-ins per source address or per user, with how many of the other each met."""
    fields = {"source": "source.ip", "user": "user.name"}
    other = "user" if by == "source" else "source"
    totals = (
        read(events, tenant, where=_is("authentication", "failure"), **window)
        .groupBy("tenant_id", attr("attributes", fields[by]).alias(by))
        .agg(
            F.count(F.lit(1)).alias("failures"),
            F.count_distinct(attr("attributes", fields[other])).alias(f"{other}s"),
        )
    )
    return top_per_tenant(totals, [F.col("failures").desc(), F.col(by)], limit)


def nxdomain_names(events: DataFrame, tenant: str | None, limit: int = TOP_ROWS, **window) -> DataFrame:
    """Names that did not resolve, most asked for first."""
    totals = (
        read(events, tenant, where=attr("attributes", "dns.response_code") == "NXDOMAIN", **window)
        .groupBy("tenant_id", attr("attributes", "dns.question.name").alias("name"))
        .agg(F.count(F.lit(1)).alias("queries"))
    )
    return top_per_tenant(totals, [F.col("queries").desc(), F.col("name")], limit)


def recent_events(events: DataFrame, tenant: str | None, category: str | None = None, limit: int = 100, tie: str = "resource_id", **window) -> DataFrame:
    """The newest events, of one category if it is named."""
    where = None if category is None else F.col("event_category") == category
    rows = read(events, tenant, where=where, **window)
    return top_per_tenant(rows, [F.col("observed_at").desc(), F.col(tie)], limit)


def denials_for(events: DataFrame, resources: DataFrame, limit: int = TOP_ROWS, tie: str = "summary", **window) -> DataFrame:
    """The newest network denials of each resource in a set."""
    rows = read(events, None, where=_is("network", "denied"), resources=resources, **window)
    return first_per_group(
        rows, ["tenant_id", "resource_id"], [F.col("observed_at").desc(), F.col(tie)], limit
    )


def signal_freshness(signals: dict[str, DataFrame], tenants: DataFrame, **window) -> DataFrame:
    """Rows per signal and tenant, and what they say together.

    `silent`: nothing arrived. `partial`: some signals arrived and some did not. `quiet`: all did.
    `unknown`: there was nothing to ask. Traces are counted but do not decide.
    """
    from functools import reduce

    counted = reduce(
        DataFrame.unionByName,
        (
            read(df, None, **window)
            .groupBy("tenant_id")
            .agg(F.count(F.lit(1)).alias("n"))
            .withColumn("signal", F.lit(name))
            for name, df in signals.items()
        ),
    )
    columns = {
        name: F.coalesce(F.sum(F.when(F.col("signal") == name, F.col("n"))), F.lit(0)).alias(name)
        for name in signals
    }
    wide = tenants.select("tenant_id").distinct().join(counted, "tenant_id", "left").groupBy("tenant_id").agg(*columns.values())
    deciding = [n for n in signals if n != "spans"]
    if not deciding:
        return wide.withColumn("verdict", F.lit("unknown"))
    arriving = sum(((F.col(n) > 0).cast("int") for n in deciding), F.lit(0))
    return wide.withColumn(
        "verdict",
        F.when(arriving == 0, "silent").when(arriving == len(deciding), "quiet").otherwise("partial"),
    )


def slo_report(slos: DataFrame, spans: DataFrame, now: Column) -> DataFrame:
    """Attainment of each objective over its own window ending at `now`.

    Spans are counted once per service and day before any objective looks at them, except the
    partial first day, which is counted row by row against each objective's exact start.
    """
    objectives = slos.withColumn("ends_at", now).withColumn(
        "starts_at", F.col("ends_at") - F.make_dt_interval(F.col("window_days"))
    )
    wanted = objectives.select("tenant_id", "service_id").distinct()
    starts = objectives.groupBy("tenant_id", "service_id").agg(
        F.array_sort(F.collect_set("starts_at")).alias("_starts"), F.max("ends_at").alias("_until")
    )
    # A service's starts cut its history into segments; counts per segment add up to any window.
    # The array is as long as a service has distinct windows, at most ninety.
    counted = (
        spans.join(wanted, ["tenant_id", "service_id"], "left_semi")
        .join(starts, ["tenant_id", "service_id"])
        .where((F.col("observed_at") >= F.element_at("_starts", 1)) & (F.col("observed_at") < F.col("_until")))
        .withColumn(
            "_segment",
            F.array_max(F.filter("_starts", lambda s: s <= F.col("observed_at"))),
        )
        .groupBy("tenant_id", "service_id", "_segment")
        .agg(F.count(F.lit(1)).alias("_n"), F.sum(errors()).alias("_e"))
    )
    windows = objectives.join(counted, ["tenant_id", "service_id"], "left").groupBy(
        "tenant_id", "slo_id", "service_id", "target", "window_days"
    )
    inside = F.col("_segment") >= F.col("starts_at")
    report = windows.agg(
        F.coalesce(F.sum(F.when(inside, F.col("_n"))), F.lit(0)).alias("requests"),
        F.coalesce(F.sum(F.when(inside, F.col("_e"))), F.lit(0)).alias("errors"),
    )
    good = (F.col("requests") - F.col("errors")) / F.nullif(F.col("requests"), F.lit(0))
    used = F.col("budget_used")
    return (
        report.withColumn("sli", F.least(F.greatest(good, F.lit(0.0)), F.lit(1.0)))
        .withColumn("sli", F.when(F.col("requests") > 0, F.col("sli")))
        .withColumn("budget_used", (1 - F.col("sli")) / (1 - F.col("target")))
        .withColumn(
            "verdict",
            F.when(used.isNull(), "unknown").when(used > 1, "missed").when(used >= 0.75, "at-risk").otherwise("met"),
        )
    )
