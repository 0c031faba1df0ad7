"""Exact interpolated quantiles that do not hold a group in one task.

The built-in exact percentile keeps every distinct value of a group in one buffer. Here values are
first counted, then put in bands by a pure function of the value (logarithmic, so about
`BANDS_PER_OCTAVE` bands for each doubling). Band totals say which band holds a wanted rank, and
only rows of those bands are ordered.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from beaconry.functions.scalars import col

BANDS_PER_OCTAVE = 1024


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value,
    quantiles: Mapping[str, float],
    count: str | None = None,
    flags: Mapping[str, Column] | None = None,
) -> DataFrame:
    """One row per group with a column for each named quantile, a double. Null values are ignored.

    Integers are ordered and counted as they are, and interpolated exactly before the result is rounded to a double, so
    that those beyond 2^53 that share a double stay apart.

    `count` names a column for the number of values, and `flags` adds sums of 0/1 columns, both
    from the same pass.
    """
    for p in quantiles.values():
        if not 0.0 <= p <= 1.0:
            raise ValueError("a quantile is between 0 and 1")
    names, flags = list(quantiles), dict(flags or {})
    by = list(keys) or ["_all"]
    rows = df if keys else df.withColumn("_all", F.lit(1))
    # Flags are part of the counting key, so both readers of `counts` share one shuffle.
    flag_keys = [f"_flag_{f}" for f in flags]
    # Rounding to a double keeps the order, so it serves for bands of integers too.
    rough = F.col("_v").cast("double")
    magnitude = F.floor(F.log2(F.lit(1.0) + F.abs(rough)) * BANDS_PER_OCTAVE)
    number = rows.select(col(value).alias("_v")).schema["_v"].dataType
    whole = isinstance(number, IntegralType)
    counts = (
        rows.select(
            *by,
            col(value).cast("bigint" if whole else "double").alias("_v"),
            *(F.coalesce(c, F.lit(0)).alias(k) for k, c in zip(flag_keys, flags.values(), strict=True)),
        )
        .where(F.col("_v").isNotNull())
        .groupBy(*by, "_v", *flag_keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_band", (F.signum(rough) * magnitude).cast("long"))
    )
    group = Window.partitionBy(*by)
    upto = group.orderBy("_band").rowsBetween(Window.unboundedPreceding, 0)
    totals = {"_total": F.sum("_n"), **{f"_sum{k}": F.sum(F.col(k) * F.col("_n")) for k in flag_keys}}
    # Two ranks per quantile: the row below the wanted position and the one above it.
    position = lambda p: F.lit(p) * (F.col("_total") - 1)
    ranks = F.array(
        *(
            F.struct(
                F.lit(2 * i + side).alias("slot"),
                (F.floor if side == 0 else F.ceil)(position(quantiles[n])).cast("long").alias("rank"),
            )
            for i, n in enumerate(names)
            for side in (0, 1)
        )
    )
    in_group = counts.groupBy(*by, "_band").agg(*(c.alias(t) for t, c in totals.items()))
    bands = (
        in_group.withColumn("_upto", F.sum("_total").over(upto))
        .withColumn("_before", F.col("_upto") - F.col("_total"))
        .withColumns({t: F.sum(t).over(group) for t in totals})
        .withColumn(
            "_wanted",
            F.filter(ranks, lambda r: (r.rank >= F.col("_before")) & (r.rank < F.col("_upto"))),
        )
        .where(F.size("_wanted") > 0)
        .select(*(F.col(k).alias(f"_r_{k}") for k in [*by, "_band"]), "_before", *totals, "_wanted")
    )
    # Null-safe, so that a null key is a group; it also leaves `counts` the same in both its uses,
    # which lets Spark compute it once.
    same_band = reduce(
        lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in [*by, "_band"])
    )
    in_band = (
        Window.partitionBy(*by, "_band")
        .orderBy("_v", *flag_keys)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    hits = (
        counts.join(bands, same_band)
        .withColumn("_end", F.col("_before") + F.sum("_n").over(in_band))
        .withColumn("_start", F.col("_end") - F.col("_n"))
        .withColumn(
            "_hit",
            F.explode(
                F.filter(
                    F.col("_wanted"),
                    lambda r: (r.rank >= F.col("_start")) & (r.rank < F.col("_end")),
                )
            ),
        )
    )
    slot = lambda s: F.max(F.when(F.col("_hit.slot") == s, F.col("_v")))
    picked = hits.groupBy(*by).agg(
        *(F.max(t).alias(t) for t in totals),
        *(slot(s).alias(f"_s{s}") for s in range(2 * len(names))),
    )
    for i, n in enumerate(names):
        low, high = F.col(f"_s{2 * i}"), F.col(f"_s{2 * i + 1}")
        weight = position(quantiles[n]) - F.floor(position(quantiles[n]))
        if whole:
            step = high.cast("decimal(20,0)") - low.cast("decimal(20,0)")
            between = (low.cast("decimal(38,9)") + step * weight.cast("decimal(10,9)")).cast("double")
        else:
            between = low * (1 - weight) + high * weight
        picked = picked.withColumn(n, F.when(low == high, low.cast("double")).otherwise(between))
    counted = [F.col("_total").alias(count)] if count else []
    flagged = [F.col(f"_sum{k}").alias(f) for k, f in zip(flag_keys, flags, strict=True)]
    return picked.select(*keys, *counted, *flagged, *names)


def join_on_keys(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Put the columns of several per-group results side by side, matching null keys too."""
    if not keys:
        return reduce(lambda a, b: a.crossJoin(b), frames)

    def side_by_side(a: DataFrame, b: DataFrame) -> DataFrame:
        other = b.select(*(F.col(k).alias(f"_r_{k}") for k in keys), *(c for c in b.columns if c not in keys))
        on = reduce(
            lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys)
        )
        return a.join(other, on, "left").drop(*(f"_r_{k}" for k in keys))

    return reduce(side_by_side, frames)
