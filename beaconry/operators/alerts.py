"""Alert evaluation: values per rule, the phase machine, stored state and notification budgets."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from beaconry.functions.scalars import col
from beaconry.functions.series import SLICE_SECONDS, with_previous, with_running_max, with_running_sum
from beaconry.session import cut_lineage

# The shortest evaluation window in seconds, and the slack of an equality (fixed values).
MIN_WINDOW, EPSILON = 60, 2.220446049250313e-16

#: Seconds of a day, microseconds of a minute, and rounds of slices before a changing channel's slices become days.
DAY, MINUTE, ROUNDS = 86_400, 60_000_000, 3

#: By aggregate: the states that a pane keeps of a field, and the value of the panes of a window.
_PANES = {
    "count": ({"n": lambda v: F.count(F.lit(1))}, lambda s: F.sum(s["n"])),
    "sum": ({"sum": F.sum}, lambda s: F.sum(s["sum"])),
    "min": ({"min": F.min}, lambda s: F.min(s["min"])),
    "max": ({"max": F.max}, lambda s: F.max(s["max"])),
    "avg": ({"sum": F.sum, "n": F.count}, lambda s: F.try_divide(F.sum(s["sum"]), F.sum(s["n"]))),
}


def _since(rows: DataFrame, now: Column, seconds: int) -> DataFrame:
    """Rows of the window that ends now; days of a stored signal are pruned."""
    begins = now - F.make_dt_interval(secs=F.lit(max(seconds, MIN_WINDOW)))
    kept = rows.where((F.col("observed_at") >= begins) & (F.col("observed_at") < now))
    if "event_date" in rows.columns:
        kept = kept.where((F.col("event_date") >= F.to_date(begins)) & (F.col("event_date") <= F.to_date(now)))
    return kept


def threshold_values(
    rows: DataFrame,
    rules: DataFrame,
    now: Column,
    *,
    match: Sequence[str] = (),
    func: str = "count",
    field: Column | str | None = None,
    labels: Mapping[str, Column] | None = None,
    longest_seconds: int | None = None,
) -> DataFrame:
    """The value of every rule of one shape for each resource, and label set, it matches.

    All rules that share an aggregate are evaluated in one pass; they differ in the `match`
    columns, in `span_seconds` and in what they are compared with. The window ends now. Grouping
    by time is not offered: a bucket in the key would make every evaluation a new alert.
    `longest_seconds` bounds the rules' windows so that the scan can be pruned.

    Rows are aggregated once, before any rule is looked at, in panes: as all windows end now, a pane is what lies in
    the window of one span and in no shorter one, so a rule's window is whole panes, to the microsecond. The
    distinct spans of all rules are one row. Rules then meet panes, and however many there are, rows are shuffled once.
    """
    labels = dict(labels or {})
    if longest_seconds is not None:
        rows = _since(rows, now, longest_seconds)
    span = F.greatest(F.col("span_seconds"), F.lit(MIN_WINDOW)).cast("bigint")
    keyed = rules.select("tenant_id", "rule_id", span.alias("_span"), *match)
    spans = keyed.agg(F.sort_array(F.collect_set("_span")).alias("_spans"))
    age = F.unix_micros(now) - F.unix_micros("observed_at")
    key = ["tenant_id", *match, "resource_id", *(f"_l_{k}" for k in labels)]
    paned = (
        rows.where(F.col("observed_at") < now)
        .withColumns({f"_l_{k}": c for k, c in labels.items()})
        .withColumns({"_v": F.lit(1) if func == "count" else col(field)})
        .crossJoin(F.broadcast(spans))  # one row
        .withColumn("_pane", F.get(F.filter("_spans", lambda s: s * 1_000_000 >= age), F.lit(0)))
        .where(F.col("_pane").isNotNull())
    )
    if func == "count_distinct":
        # A value counts from the first pane that has it.
        panes = paned.where(F.col("_v").isNotNull()).groupBy(*key, "_v").agg(F.min("_pane").alias("_pane"))
        value = F.count(F.lit(1))
    else:
        states, whole = _PANES[func]
        panes = paned.groupBy(*key, "_pane").agg(*(make("_v").alias(f"_s_{s}") for s, make in states.items()))
        value = whole({s: F.col(f"_s_{s}") for s in states})
    values = (
        panes.join(keyed, ["tenant_id", *match])
        .where(F.col("_pane") <= F.col("_span"))
        .groupBy("tenant_id", "rule_id", "resource_id", *(f"_l_{k}" for k in labels))
        .agg(value.alias("value"))
        # No samples means no data, which is not zero.
        .where(F.col("value").isNotNull())
    )
    packed = (
        F.map_from_arrays(
            F.array(*map(F.lit, labels)), F.array(*(F.coalesce(F.col(f"_l_{k}"), F.lit("")) for k in labels))
        )
        if labels
        else F.lit(None).cast("map<string,string>")
    )
    return values.select("tenant_id", "rule_id", "resource_id", packed.alias("labels"), F.col("value").cast("double").alias("value"))


def absence_values(rows: DataFrame, rules: DataFrame, expected: DataFrame | None, now: Column) -> DataFrame:
    """Seconds since each expected resource was last heard from.

    `expected` is (tenant_id, rule_id, resource_id). Without it there is no way to notice a
    resource that was never heard, so it is required. A resource not heard in its whole window
    reports one second more than the window. Nothing older than the longest window is read.
    """
    if expected is None:
        raise ValueError("an absence rule needs the set of resources it expects to hear from")
    longest = rules.agg(F.max("after_seconds")).first()[0] or 0
    last = _since(rows, now, longest).groupBy("tenant_id", "resource_id").agg(F.max("observed_at").alias("_last"))
    window = F.greatest(F.col("after_seconds"), F.lit(MIN_WINDOW)).cast("double")
    age = (F.unix_millis(now) - F.unix_millis("_last")) / 1000
    return (
        expected.join(rules.select("tenant_id", "rule_id", "after_seconds"), ["tenant_id", "rule_id"])
        .join(last, ["tenant_id", "resource_id"], "left")
        .withColumn("value", F.when(age <= window, age).otherwise(window + 1))
        .withColumn("breaching", F.col("value") > F.col("after_seconds"))
        .select("tenant_id", "rule_id", "resource_id", "value", "breaching")
    )


def holds(value: Column | str, op: Column | str, bound: Column | str) -> Column:
    """Whether a value satisfies a comparison named by `op`."""
    v, o, b = col(value), col(op), col(bound)
    near = F.abs(v - b) < EPSILON
    return (
        F.when(o == "gt", v > b).when(o == "gte", v >= b).when(o == "lt", v < b)
        .when(o == "lte", v <= b).when(o == "eq", near).when(o == "ne", ~near)
    )


def dedup_key(rule: Column | str, resource: Column | str, labels: Column | str) -> Column:
    """`rule/resource/k=v,…` with labels escaped and sorted."""

    def escaped(c: Column) -> Column:
        for ch in ("\\", "=", ","):
            c = F.replace(c, F.lit(ch), F.lit("\\" + ch))
        return c

    parts = F.transform(
        F.map_entries(col(labels)), lambda e: F.concat(escaped(e.key), F.lit("="), escaped(e.value))
    )
    tail = F.nullif(F.array_join(F.array_sort(parts), ","), F.lit(""))
    return F.concat_ws("/", col(rule), col(resource), tail)


def alert_phases(
    evaluations: DataFrame,
    key: Sequence[str] = ("tenant_id", "dedup_key"),
    order: Sequence[str] = ("at",),
    slice_seconds: int = SLICE_SECONDS,
) -> DataFrame:
    """Add `phase`, `since` and `notify` to evaluations (`breaching`, `hold_seconds`).

    A breach must last its hold before it fires, and a clear evaluation ends it. Only entering
    firing and leaving it are announced. Silence is not recovery: a gap ends nothing.

    A run is a stretch of breaching evaluations. Its start and the first evaluation at which it
    had lasted its hold are carried along the series as running maxima of marked times, so no run
    and no series has to fit in one task. Each pass reads its input twice, so the passes are
    materialised between.
    """
    keys, at = list(key), order[0]
    rows = cut_lineage(with_previous(evaluations, keys, order, ["breaching", at], "_last", slice_seconds))
    was_breaching = F.coalesce(F.col("_last.breaching"), F.lit(False))
    opens = F.col("breaching") & ~was_breaching
    rows = cut_lineage(
        with_running_max(rows, keys, order, F.when(opens, F.col(at)), "_start", slice_seconds)
    )

    def lasted(moment: Column) -> Column:
        held = F.unix_millis(moment) - F.unix_millis("_start")
        return held >= F.col("hold_seconds") * 1000

    fired = F.col("breaching") & lasted(F.col(at))
    had_fired = was_breaching & lasted(F.col(f"_last.{at}"))
    fires_now = fired & ~had_fired
    rows = with_running_max(rows, keys, order, F.when(fires_now, F.col(at)), "_fired_at", slice_seconds)
    phase = (
        F.when(fired, "firing").when(F.col("breaching"), "pending").when(had_fired, "resolved").otherwise("ok")
    )
    since = F.when(fired, F.col("_fired_at")).when(F.col("breaching"), F.col("_start")).otherwise(F.col(at))
    return (
        rows.withColumn("phase", phase)
        .withColumn("since", since)
        .withColumn("notify", fires_now | (F.col("phase") == "resolved"))
        .select(*evaluations.columns, "phase", "since", "notify")
    )


def apply_suppression(evaluations: DataFrame, flags: DataFrame) -> DataFrame:
    """Drop evaluations of suppressed resources; mark those whose notifications are silenced."""
    return (
        evaluations.join(flags, ["tenant_id", "resource_id"], "left")
        .where(~F.coalesce("alerts", F.lit(False)))
        .withColumn("silent", F.coalesce("notifications", F.lit(False)))
        .drop("alerts", "notifications")
    )


def state_upsert(stored: DataFrame, evaluated: DataFrame) -> DataFrame:
    """Stored alert state after a cycle, one row per dedup key.

    A healthy series is written only when it is recovering. An acknowledgement belongs to the
    episode it was made in, so it survives only while the phase does.
    """
    keys = ["tenant_id", "dedup_key"]
    old = stored.select(*keys, F.struct(*[c for c in stored.columns if c not in keys]).alias("_old"))
    fresh = evaluated.select(*keys, F.struct(*[c for c in evaluated.columns if c not in keys]).alias("_new"))
    active = lambda c: F.coalesce(c.isin("pending", "firing"), F.lit(False))
    written = F.col("_new").isNotNull() & (active(F.col("_new.state")) | active(F.col("_old.state")))
    same = F.col("_old.state") == F.col("_new.state")

    def pick(column: str) -> Column:
        return F.when(written, F.col(f"_new.{column}")).otherwise(F.col(f"_old.{column}")).alias(column)

    def kept(column: str) -> Column:
        return F.when(~written | same, F.col(f"_old.{column}")).alias(column)

    return (
        old.join(fresh, keys, "full")
        .where(F.col("_old").isNotNull() | written)
        .select(
            *keys,
            *(pick(c) for c in ("rule_id", "resource_id", "state", "since", "last_eval", "last_value")),
            *(kept(c) for c in ("acked_by", "acked_at")),
        )
    )


def alert_order(alerts: DataFrame, tie: str = "dedup_key") -> DataFrame:
    """Firing before pending, longest-standing first."""
    return alerts.orderBy(F.col("state") != "firing", "since", tie)


def notify_throttle(
    attempts: DataFrame, budgets: DataFrame, channels: DataFrame, slice_seconds: int = SLICE_SECONDS
) -> DataFrame:
    """Add `outcome` to attempts (tenant_id, channel_id, attempt_id, at): sent or why not.

    `budgets` has budget_per_day and `channels` max_per_minute; days are those of UTC. An outcome depends on earlier
    ones, yet not on all: a channel's minute depends on that channel alone until the tenant's day is used up, and
    nothing is sent from there to midnight. So slices of a channel's time are walked at once, each from the sends of
    the minute before it (none, at first), and a running sum over the tenant's day says where the budget ends. What was
    sent in the last minute of a slice is handed on, and slices that began with something else are walked again, until
    every one began with what was left to it. Slices of a channel that still change after `ROUNDS` rounds, as where it
    is held at its limit for hours, are taken together by days, so the rounds are bounded by the days of such a stretch.
    """
    if DAY % slice_seconds:
        raise ValueError("slices divide a day")
    place, order = ["tenant_id", "channel_id", "_begin"], ["at", "attempt_id"]
    second, micros = F.unix_seconds("at"), F.unix_micros("at")
    none = F.array().cast("array<bigint>")
    rows = (
        attempts.join(budgets.select("tenant_id", F.col("budget_per_day").alias("_budget")), "tenant_id")
        .join(channels.select("tenant_id", "channel_id", F.col("max_per_minute").alias("_cap")), ["tenant_id", "channel_id"])
        .withColumn("_day", F.floor(second / DAY))
        .withColumn("_begin", F.floor(second / slice_seconds) * slice_seconds)
        .withColumns({"_until": F.col("_begin") + slice_seconds, "_at": micros, "_start": none})
    )
    used = F.col("_nth") - F.col("_free")
    outcome = F.when(used >= F.col("_budget"), "over_budget").when(F.col("_free") == 0, "rate_limited").otherwise("sent")
    # A send counts in the minute after it, and so in the next slice if that has an attempt so soon.
    late = (F.col("outcome") == "sent") & (F.col("_at") > F.col("_until") * 1_000_000 - MINUTE)
    walked, todo, rounds = None, None, 0
    while True:
        again = rows if walked is None else walked.drop("_free", "_start", "outcome").join(todo, place)
        now = (
            again.select(*rows.columns).repartition(*place).sortWithinPartitions(*place, *order)
            .mapInArrow(_free_slots, StructType([*rows.schema.fields, StructField("_free", IntegerType())]))
        )
        if walked is not None:
            now = now.unionByName(walked.drop("outcome").join(todo.select(*place), place, "left_anti"))
        summed = with_running_sum(now, ["tenant_id", "_day"], order, F.col("_free"), "_nth", slice_seconds)
        walked = cut_lineage(summed.withColumn("outcome", outcome).drop("_nth"))
        rounds += 1
        todo = _begun_otherwise(walked, place, late)
        if todo.isEmpty():
            break
        if rounds >= ROUNDS:
            days = todo.select("tenant_id", "channel_id", F.floor(F.col("_begin") / DAY).alias("_day"), F.lit(True).alias("_whole")).distinct()
            whole = lambda instant, kept: F.when(F.col("_whole"), instant).otherwise(F.col(kept))
            walked = cut_lineage(
                walked.join(days, ["tenant_id", "channel_id", "_day"], "left")
                .withColumns({
                    "_begin": whole(F.col("_day") * DAY, "_begin"), "_until": whole((F.col("_day") + 1) * DAY, "_until"),
                    "_start": whole(F.lit(None), "_start"),
                })
                .drop("_whole")
            )
            todo = _begun_otherwise(walked, place, late)
        todo = cut_lineage(todo)
    return walked.select(*attempts.columns, "outcome")


def _begun_otherwise(walked: DataFrame, place: list[str], late: Column) -> DataFrame:
    """Slices that were not walked from what the one before them left, and what that is (`_start`)."""
    left = walked.where(late).groupBy(*place[:2], F.col("_until").alias("_begin")).agg(F.sort_array(F.collect_list("_at")).alias("_left"))
    slices = walked.groupBy(*place).agg(F.min("_at").alias("_first"), F.first("_start").alias("_was"))
    felt = F.filter(F.coalesce("_left", F.array().cast("array<bigint>")), lambda s: s > F.col("_first") - MINUTE)
    return (
        slices.join(left, place, "left").withColumn("_start", felt)
        .where(~F.col("_start").eqNullSafe(F.col("_was"))).select(*place, "_start")
    )


def _free_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to sorted attempts 1 where fewer than `_cap` were sent in the minute before, else 0: budgets aside.

    What is held is a minute of sends, at most `_cap`.
    """
    place, recent = None, deque()
    for batch in batches:
        free = []
        fields = (batch.column(n).to_pylist() for n in ("tenant_id", "channel_id", "_begin", "_at", "_cap", "_start"))
        for tenant, channel, begin, at, cap, start in zip(*fields, strict=True):
            if (tenant, channel, begin) != place:
                place, recent = (tenant, channel, begin), deque(start)
            while recent and recent[0] <= at - MINUTE:
                recent.popleft()
            free.append(int(len(recent) < cap))
            if free[-1]:
                recent.append(at)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(free, pa.int32())], names=[*batch.schema.names, "_free"])
