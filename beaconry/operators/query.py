"""Reads of one signal: scoped rows, groups, order and limits."""

from __future__ import annotations

import datetime as dt
import math
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconry import schemas
from beaconry.functions.predicates import bucketed_window, time_window
from beaconry.functions.quantiles import exact_quantiles, join_on_keys
from beaconry.functions.scalars import col

QUANTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
SIMPLE = {
    "sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg, "count_distinct": F.count_distinct,
}
ALIAS = re.compile(r"^[A-Za-z_][A-Za-z0-9_]{0,63}$")


@dataclass(frozen=True)
class Agg:
    """One aggregate: a function, the field it reads, and for quantiles whether it is exact."""

    func: str
    field: Column | str | None = None
    exact: bool = True


def read(
    df: DataFrame,
    tenant: str | None,
    *,
    start: dt.datetime | None = None,
    end: dt.datetime | None = None,
    resources: DataFrame | None = None,
    where: Column | None = None,
    time_column: str = "observed_at",
    grain_seconds: int | None = None,
) -> DataFrame:
    """Rows of one tenant in a window, for a set of resources, matching a predicate.

    `tenant=None` is for jobs over the whole estate, whose operators carry `tenant_id` as a key.
    `resources` is a DataFrame of ids from a selector; an empty one yields no rows. A stored
    signal is partitioned by `event_date`, which the window prunes.
    """
    rows = df
    if tenant is not None:
        rows = rows.where(F.col("tenant_id") == tenant)
    if grain_seconds:
        rows = rows.where(bucketed_window(time_column, start, end, grain_seconds))
    else:
        rows = rows.where(time_window(time_column, start, end))
    if "event_date" in df.columns and time_column == "observed_at":
        if start is not None:
            rows = rows.where(F.col("event_date") >= F.lit(start.date()))
        if end is not None:
            rows = rows.where(F.col("event_date") <= F.lit(end.date()))
    if where is not None:
        rows = rows.where(where)
    if resources is not None:
        keys = [k for k in ("tenant_id", "resource_id") if k in resources.columns]
        rows = rows.join(resources.select(*keys).distinct(), keys, "left_semi")
    return rows


def scan(df: DataFrame, signal: str, tenant: str | None, **window) -> DataFrame:
    """Raw rows with the signal's explicit column list."""
    return read(df, tenant, **window).select(*schemas.columns(signal))


def limited(rows: DataFrame, n: int | None) -> DataFrame:
    """The first `n` rows, as many as the caller says; all without a limit."""
    if n is None:
        return rows
    if n < 1:
        raise ValueError("a limit is at least one row")
    return rows.limit(n)


def check_alias(alias: str) -> str:
    if not ALIAS.match(alias):
        raise ValueError(f"{alias!r} cannot be a column name")
    return alias


def aggregate(
    df: DataFrame,
    aggs: Mapping[str, Agg],
    by: Sequence[Column | str] = (),
    names: Sequence[str] | None = None,
) -> DataFrame:
    """Group by any number of keys, named `g0`, `g1`, … unless `names` says otherwise."""
    if not aggs:
        raise ValueError("a group needs at least one aggregate")
    names = list(names) if names else [f"g{i}" for i in range(len(by))]
    for alias in [*aggs, *names]:
        check_alias(alias)
    fields = {a: f"_f_{a}" for a, agg in aggs.items() if agg.field is not None}
    rows = df.select(
        *(col(k).alias(n) for k, n in zip(by, names, strict=True)),
        *(col(aggs[a].field).alias(f) for a, f in fields.items()),
    )
    plain, exact = [], {}
    for alias, agg in aggs.items():
        if agg.func == "count":
            if agg.field is not None:
                raise ValueError("count takes no field")
            plain.append(F.count(F.lit(1)).alias(alias))
        elif agg.field is None:
            raise ValueError(f"{agg.func} needs a field")
        elif agg.func in SIMPLE:
            plain.append(SIMPLE[agg.func](F.col(fields[alias])).alias(alias))
        elif agg.func == "approx_count_distinct":
            plain.append(F.approx_count_distinct(fields[alias]).alias(alias))
        elif agg.func in QUANTILES and not agg.exact:
            plain.append(F.approx_percentile(fields[alias], QUANTILES[agg.func]).alias(alias))
        elif agg.func in QUANTILES:
            # Expressions that read alike are one source; sources of one pass are few, so their text decides.
            source = str(agg.field)
            exact.setdefault(source, {})[alias] = QUANTILES[agg.func]
        else:
            raise ValueError(f"unknown aggregate {agg.func!r}")
    frames = []
    if plain:
        frames.append(rows.groupBy(*names).agg(*plain))
    elif exact:
        frames.append(rows.groupBy(*names).agg(F.count(F.lit(1)).alias("_rows")))
    for wanted in exact.values():
        value = fields[next(iter(wanted))]
        frames.append(exact_quantiles(rows, names, value, wanted))
    return join_on_keys(frames, names).select(*names, *aggs)


def ordered(
    df: DataFrame, by: Sequence[tuple[str, bool]], limit: int | None = None, offset: int = 0,
) -> DataFrame:
    """Sort by (column, descending) pairs, then page."""
    for key, _ in by:
        if key not in df.columns:
            raise ValueError(f"cannot sort by {key}, which is neither grouped nor aggregated")
    keys = [F.col(k).desc() if desc else F.col(k).asc() for k, desc in by]
    rows = df.orderBy(*keys) if keys else df
    if offset:
        rows = rows.offset(offset)
    return limited(rows, limit)


def default_order(df: DataFrame, bucket: str | None = None) -> DataFrame:
    """Raw rows by resource then newest first; groups by their time bucket if they have one."""
    if bucket is not None:
        return df.orderBy(F.col(bucket).asc())
    if "observed_at" in df.columns:
        return df.orderBy(F.col("resource_id").asc(), F.col("observed_at").desc())
    return df


def tail(
    df: DataFrame, tenant: str | None, limit: int | None = None, tie: Sequence[str] = ("resource_id",),
    **window,
) -> DataFrame:
    """The newest rows first. Neither a group nor an offset is offered here."""
    rows = read(df, tenant, **window)
    return limited(rows.orderBy(F.col("observed_at").desc(), *tie), limit)


def field_counts(df: DataFrame, field: Column | str, top: int = 8) -> DataFrame:
    """How often each value of one field occurs, most frequent first."""
    return (
        df.groupBy(col(field).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), "value")
        .limit(top)
    )


def histogram(
    df: DataFrame, start: dt.datetime, end: dt.datetime, seconds: int | None = None,
    time_column: str = "observed_at",
) -> DataFrame:
    """Rows per bucket across a window, with empty buckets counted as zero."""
    from beaconry.functions.predicates import floor_time
    from beaconry.functions.scalars import bucket_step, time_bucket

    seconds = seconds or bucket_step((end - start).total_seconds())
    counted = (
        df.where(time_window(time_column, start, end))
        .groupBy(time_bucket(time_column, seconds).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    first = floor_time(start, seconds)
    buckets = math.floor((end - first).total_seconds() / seconds) + 1
    axis = df.sparkSession.range(buckets).select(
        F.timestamp_seconds(F.lit(int(first.replace(tzinfo=dt.timezone.utc).timestamp())) + F.col("id") * seconds)
        .alias("bucket")
    )
    return (
        axis.join(counted, "bucket", "left")
        .select("bucket", F.coalesce("n", F.lit(0)).alias("n"))
        .orderBy("bucket")
    )


def latest_stat(df: DataFrame, bucket: str, value: str, tie: str | None = None) -> DataFrame:
    """The last value that is not null."""
    order = F.struct(bucket, tie) if tie else F.col(bucket)
    return df.where(F.col(value).isNotNull()).agg(F.max_by(F.col(value), order).alias("value"))


def series_lines(df: DataFrame, bucket: str, names: Sequence[str], value: str) -> DataFrame:
    """Chart lines: one point per row, the keys between time and value joined as a name."""
    return df.where(F.col(value).isNotNull()).select(
        F.concat_ws(" · ", *(F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names)).alias("series"),
        F.col(bucket).alias("at"),
        F.col(value).cast("double").alias("value"),
    )
