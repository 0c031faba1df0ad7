"""All six signals of a set of resources on one axis."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconry.functions.series import first_per_group
from beaconry.operators.query import limited, read
from beaconry.schemas import RETENTION_DAYS
from beaconry.session import cut_lineage

# The order signals are drawn in (fixed values).
SIGNALS = ("states", "events", "logs", "metrics", "flows", "spans")


def _text(signal: str) -> Column:
    c = {
        "states": F.concat_ws(" → ", "previous_status", "current_status"),
        "events": F.col("summary"),
        "logs": F.col("body"),
        "metrics": F.concat_ws(" ", "metric", F.col("value").cast("string")),
        "flows": F.concat_ws(" → ", "src_address", "dst_address"),
        "spans": F.concat_ws(" ", "name", "status_code"),
    }
    return c[signal] if signal in c else F.lit("")


def coverage(signal: str, start: dt.datetime, end: dt.datetime, now: dt.datetime) -> tuple[str, dt.datetime]:
    """What retention leaves of a window: `whole`, `partial` or `expired`, and where it starts."""
    if start >= end:
        raise ValueError("the window ends before it starts")
    horizon = now - dt.timedelta(days=RETENTION_DAYS[signal])
    if end <= horizon:
        return "expired", end
    return ("partial", horizon) if start < horizon else ("whole", start)


def _moments(df: DataFrame, signal: str, tie: Column, extra: tuple[str, ...] = ()) -> DataFrame:
    return df.select(
        *extra, "tenant_id", "resource_id", F.lit(signal).alias("signal"),
        F.lit(SIGNALS.index(signal)).alias("signal_rank"), "observed_at", _text(signal).alias("text"), tie.alias("tie"),
    )


def timeline(
    signals: dict[str, DataFrame], resources: DataFrame, start: dt.datetime, end: dt.datetime,
    now: dt.datetime, ties: dict[str, Column] | None = None, limit: int | None = None,
) -> DataFrame:
    """The rows of every signal still kept, merged by time and then by signal: all, or the oldest `limit` of each.

    An expired signal is not read, and a partial one is read from where retention begins.
    """
    tracks = []
    for signal in (s for s in SIGNALS if s in signals):
        left, begins = coverage(signal, start, end, now)
        if left == "expired":
            continue
        tie = (ties or {}).get(signal, F.col("resource_id"))
        rows = _moments(read(signals[signal], None, start=begins, end=end, resources=resources), signal, tie)
        tracks.append(rows if limit is None else limited(rows.orderBy("observed_at", "tie"), limit))
    if not tracks:
        raise ValueError("nothing is left of this window in any signal")
    return reduce(DataFrame.unionByName, tracks).orderBy("observed_at", "signal_rank", "tie")


def coverage_table(signals, start: dt.datetime, end: dt.datetime, now: dt.datetime, spark) -> DataFrame:
    """What each signal can still answer for a window; a handful of rows."""
    rows = [(s, *coverage(s, start, end, now)) for s in SIGNALS if s in signals]
    return spark.createDataFrame(rows, "signal string, coverage string, starts_at timestamp")


def incident_timeline(
    incidents: DataFrame, members: DataFrame, signals: dict[str, DataFrame],
    ties: dict[str, Column] | None = None, limit: int | None = None, now: dt.datetime | None = None,
) -> DataFrame:
    """The timeline of every incident over its members: all rows, or the oldest `limit` of each signal.

    `incidents` has starts_at and ends_at; `members` is (tenant_id, incident_id, resource_id). Every signal
    is read from the first start to the last end only, and, given `now`, from where its retention begins.
    """
    bounds = incidents.select("tenant_id", "incident_id", "starts_at", "ends_at")
    wanted = cut_lineage(
        members.select("tenant_id", "incident_id", "resource_id").distinct().join(bounds, ["tenant_id", "incident_id"])
    )
    first, last = wanted.agg(F.min("starts_at"), F.max("ends_at")).first()
    tracks = []
    for signal in (s for s in SIGNALS if s in signals):
        tie = (ties or {}).get(signal, F.col("resource_id"))
        begins = first
        if first is not None and first < last and now is not None:
            _, begins = coverage(signal, first, last, now)
        empty = first is None or begins >= last
        rows = signals[signal].where("false") if empty else read(signals[signal], None, start=begins, end=last)
        rows = rows.join(wanted, ["tenant_id", "resource_id"]).where(
            (F.col("observed_at") >= F.col("starts_at")) & (F.col("observed_at") < F.col("ends_at"))
        )
        track = _moments(rows, signal, tie, ("incident_id",))
        if limit is not None:
            track = first_per_group(track, ["tenant_id", "incident_id"], [F.col("observed_at"), F.col("tie")], limit)
        tracks.append(track)
    return reduce(DataFrame.unionByName, tracks).orderBy(
        "tenant_id", "incident_id", "observed_at", "signal_rank", "tie"
    )


def around(at: Column, minutes: int = 5) -> tuple[Column, Column]:
    """The window a link out of an incident opens: some minutes either side of a moment."""
    span = F.make_dt_interval(mins=F.lit(minutes))
    return at - span, at + span
