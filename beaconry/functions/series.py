"""Ordered-series functions that keep working when one series holds a large share of the rows.

A plain window puts a whole series into one task. Here each series is cut into time slices; rows
are ordered within a slice, and what a slice needs from the ones before it comes from a summary
with one row per slice. A series of any length is therefore spread over as many tasks as it has
slices, and the only per-series window runs over the summary.

Series keys must not be null, and `order` must be unique within a series, time first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE_SECONDS = 3600
_SLICE = "_slice"


def _sliced(df: DataFrame, at: str, slice_seconds: int) -> DataFrame:
    return df.withColumn(_SLICE, F.floor(F.unix_seconds(F.col(at)) / slice_seconds))


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    carry: Sequence[str],
    out: str = "previous",
    slice_seconds: int = SLICE_SECONDS,
) -> DataFrame:
    """Add a struct of the `carry` columns of the row before, null on the first row."""
    part = [*keys, _SLICE]
    payload = F.struct(*carry)
    rows = _sliced(df, order[0], slice_seconds)
    carried = (
        rows.groupBy(*part)
        .agg(F.max_by(payload, F.struct(*order)).alias("_tail"))
        .withColumn("_carried", F.lag("_tail").over(Window.partitionBy(*keys).orderBy(_SLICE)))
        .where(F.col("_carried").isNotNull())
        .select(*part, "_carried")
    )
    within = Window.partitionBy(*part).orderBy(*order)
    return (
        rows.withColumn(out, F.lag(payload).over(within))
        .withColumn("_first", F.row_number().over(within) == 1)
        .join(carried, part, "left")
        .withColumn(out, F.when(F.col("_first"), F.col("_carried")).otherwise(F.col(out)))
        .select(*df.columns, out)
    )


def _running(df, keys, order, value, out, slice_seconds, total, combine) -> DataFrame:
    part = [*keys, _SLICE]
    rows = _sliced(df.withColumn("_value", value), order[0], slice_seconds)
    before = Window.partitionBy(*keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        rows.groupBy(*part)
        .agg(total("_value").alias("_total"))
        .withColumn("_carried", total("_total").over(before))
        .where(F.col("_carried").isNotNull())
        .select(*part, "_carried")
    )
    within = (
        Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        rows.withColumn("_within", total("_value").over(within))
        .join(carried, part, "left")
        .withColumn(out, combine(F.col("_within"), F.col("_carried")))
        .select(*df.columns, out)
    )


def with_running_max(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    out: str,
    slice_seconds: int = SLICE_SECONDS,
) -> DataFrame:
    """Add the largest non-null `value` from the start of the series up to this row."""
    return _running(df, keys, order, value, out, slice_seconds, F.max, F.greatest)


def with_running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    out: str,
    slice_seconds: int = SLICE_SECONDS,
) -> DataFrame:
    """Add the sum of `value` from the start of the series up to this row."""
    add = lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    return _running(df, keys, order, value, out, slice_seconds, F.sum, add)


def first_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, salts: int = 32
) -> DataFrame:
    """The first `n` rows of each group, exactly, with a hot group spread over `salts` tasks.

    Each salted part keeps its own first `n`; the final pass sees at most `n * salts` rows a group.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*_hashable(df)), F.lit(salts)))
    by_salt = Window.partitionBy(*keys, "_salt").orderBy(*order)
    by_key = Window.partitionBy(*keys).orderBy(*order)
    return (
        salted.withColumn("_rn", F.row_number().over(by_salt))
        .where(F.col("_rn") <= n)
        .withColumn("_rn", F.row_number().over(by_key))
        .where(F.col("_rn") <= n)
        .drop("_salt", "_rn")
    )


def _hashable(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")]
