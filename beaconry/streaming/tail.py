"""Following a search as rows arrive."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconry.functions.predicates import moment, time_window

# How far a row's own time may be behind and ahead of a poll (fixed values).
LOOKBACK, SKEW = dt.timedelta(hours=1), dt.timedelta(minutes=5)


def poll(
    rows: DataFrame, since: dt.datetime, now: dt.datetime, where: Column | None = None
) -> tuple[DataFrame, dt.datetime, bool]:
    """Rows that arrived in [since, now), where to poll from next, and whether some were skipped.

    Windows are on arrival, so polls that follow each other deliver every row once. A row's own
    time is bracketed, which is what lets the scan prune. A watermark older than the lookback is
    moved up to it.
    """
    floor = now - LOOKBACK
    begins = max(since, floor)
    arrived = time_window("ingested_at", begins, now)
    bracket = (F.col("observed_at") >= moment(begins - LOOKBACK)) & (F.col("observed_at") < moment(now + SKEW))
    page = rows.where(arrived & bracket)
    if "event_date" in rows.columns:
        page = page.where(F.col("event_date").between((begins - LOOKBACK).date(), (now + SKEW).date()))
    return (page if where is None else page.where(where)), now, begins > since


def follow(stream: DataFrame, where: Column | None = None) -> DataFrame:
    """The same search over a stream: no page, and each row once.

    The bracket on a row's own time is around its arrival.
    """
    late = F.col("observed_at") < F.col("ingested_at") - F.make_dt_interval(hours=F.lit(1))
    early = F.col("observed_at") >= F.col("ingested_at") + F.make_dt_interval(mins=F.lit(5))
    kept = stream.where(~late & ~early)
    return kept if where is None else kept.where(where)
