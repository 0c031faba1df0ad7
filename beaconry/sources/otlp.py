"""OTLP/JSON requests to rows. A request is one JSON text per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconry.functions import maps
from beaconry.functions.binding import let
from beaconry.functions.staging import stage

# How deep a nested attribute value is read with its request; deeper ones are read from their text, a level a round.
NESTING = 3


def _value(depth: int) -> str:
    """The type of an attribute value that may hold others."""
    scalars = "stringValue: STRING, boolValue: STRING, intValue: STRING, doubleValue: STRING, bytesValue: STRING"
    inner = _value(depth - 1) if depth else "STRING"
    return (
        f"STRUCT<{scalars}, arrayValue: STRUCT<values: ARRAY<{inner}>>, "
        f"kvlistValue: STRUCT<values: ARRAY<STRUCT<key: STRING, value: {inner}>>>>"
    )


_ANY = _value(NESTING)
_ATTRS = f"ARRAY<STRUCT<key: STRING, value: {_ANY}>>"
_RESOURCE = f"resource: STRUCT<attributes: {_ATTRS}>"
_SCOPE = "scope: STRUCT<name: STRING>"
_POINT = f"STRUCT<timeUnixNano: STRING, asDouble: DOUBLE, asInt: STRING, attributes: {_ATTRS}>"
LOGS = f"""resourceLogs ARRAY<STRUCT<{_RESOURCE}, scopeLogs: ARRAY<STRUCT<{_SCOPE}, logRecords: ARRAY<STRUCT<
    timeUnixNano: STRING, observedTimeUnixNano: STRING, severityNumber: INT, severityText: STRING, body: {_ANY},
    attributes: {_ATTRS}, traceId: STRING, spanId: STRING>>>>>>"""
METRICS = f"""resourceMetrics ARRAY<STRUCT<{_RESOURCE}, scopeMetrics: ARRAY<STRUCT<{_SCOPE}, metrics: ARRAY<STRUCT<
    name: STRING, unit: STRING, gauge: STRUCT<dataPoints: ARRAY<{_POINT}>>,
    sum: STRUCT<dataPoints: ARRAY<{_POINT}>, isMonotonic: BOOLEAN>>>>>>>"""
TRACES = f"""resourceSpans ARRAY<STRUCT<{_RESOURCE}, scopeSpans: ARRAY<STRUCT<{_SCOPE}, spans: ARRAY<STRUCT<
    traceId: STRING, spanId: STRING, parentSpanId: STRING, traceState: STRING, name: STRING, kind: INT,
    startTimeUnixNano: STRING, endTimeUnixNano: STRING, attributes: {_ATTRS},
    status: STRUCT<code: INT, message: STRING>>>>>>>"""

# By kind: the schema, and its names of groups, scopes and records.
_PARTS = {
    "logs": (LOGS, "resourceLogs", "scopeLogs", "logRecords"),
    "metrics": (METRICS, "resourceMetrics", "scopeMetrics", "metrics"),
    "spans": (TRACES, "resourceSpans", "scopeSpans", "spans"),
}

# Severity names by the last number of each band, span kinds and status codes (fixed values).
SEVERITY_BANDS = (
    (1, 4, "trace"), (5, 8, "debug"), (13, 16, "warn"), (17, 20, "error"), (21, 21, "critical"),
    (22, 22, "alert"), (23, 24, "emergency"),
)
KINDS = {2: "server", 3: "client", 4: "producer", 5: "consumer"}
STATUSES = {1: "ok", 2: "error"}


def _scalar(value: Column) -> Column:
    return F.coalesce(
        value.stringValue,
        value.boolValue,
        value.intValue,
        F.regexp_replace(value.doubleValue, r"\.0$", ""),
        F.lower(F.hex(F.unbase64(value.bytesValue))),
    )


def _named(**fields: Column) -> Column:
    return F.named_struct(*(c for name, value in fields.items() for c in (F.lit(name), value)))


def _held(value: Column) -> Column:
    """The values a value holds, each with what is written before it."""
    items = F.transform(value.arrayValue.values, lambda v: _named(before=F.lit(""), value=v))
    pairs = F.transform(
        value.kvlistValue.values,
        lambda e: _named(before=F.concat(F.coalesce(e.key, F.lit("")), F.lit("=")), value=e.value),
    )
    return F.coalesce(F.when(value.arrayValue.isNotNull(), items).otherwise(pairs), F.array())


def flatten(value: Column, depth: int = NESTING) -> Column:
    """An attribute value as one string; lists in brackets, nested attributes in braces."""
    inner = (lambda v: flatten(v, depth - 1)) if depth else _flatten_text
    parts = F.array_join(F.transform(_held(value), lambda h: F.concat(h.before, inner(h.value))), ",")
    return F.coalesce(
        _scalar(value),
        F.when(value.arrayValue.isNotNull(), F.concat(F.lit("["), parts, F.lit("]")))
        .when(value.kvlistValue.isNotNull(), F.concat(F.lit("{"), parts, F.lit("}"))),
        F.lit(""),
    )


def _flatten_text(text: Column) -> Column:
    """An attribute value's JSON text as `flatten` gives it, at any depth.

    The text is a list of pieces. A round replaces each piece that is still JSON by what stands around
    its values, and the values' texts; there are as many rounds as braces are nested.
    """
    piece = lambda c, raw: _named(text=c, raw=F.lit(raw))

    def pieces(value: Column) -> Column:
        listed = value.arrayValue.isNotNull()
        held = F.transform(
            _held(value),
            lambda h, i: F.array(piece(F.concat(F.when(i > 0, ",").otherwise(""), h.before), False), piece(h.value, True)),
        )
        left, right = F.when(listed, "[").otherwise("{"), F.when(listed, "]").otherwise("}")
        around = F.concat(F.array(piece(left, False)), F.flatten(held), F.array(piece(right, False)))
        holds = _scalar(value).isNull() & (listed | value.kvlistValue.isNotNull())
        return F.when(holds, around).otherwise(F.array(piece(F.coalesce(_scalar(value), F.lit("")), False)))

    def opened(found: Column) -> Column:
        read = lambda p: F.when(p.raw, let(F.from_json(p.text, _value(0)), pieces)).otherwise(F.array(p))
        return F.when(F.exists(found, lambda p: p.raw), F.flatten(F.transform(found, read))).otherwise(found)

    braces = F.split(F.regexp_replace(text, r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^{}"]', ""), "")
    level = lambda s, b: s.now + F.when(b == "{", 1).when(b == "}", -1).otherwise(0)
    depth = F.aggregate(
        braces, _named(now=F.lit(0), most=F.lit(1)),
        lambda s, b: _named(now=level(s, b), most=F.greatest(s.most, level(s, b))),
        lambda s: s.most,
    )
    rounds = F.sequence(F.lit(1), F.coalesce(depth, F.lit(1)))
    found = F.aggregate(rounds, F.array(piece(text, True)), lambda found, _: opened(found))
    return F.array_join(F.transform(found, lambda p: p.text), "")


def attributes(pairs: Column) -> Column:
    """A list of attributes as a string map."""
    flat = F.transform(pairs, lambda e: F.struct(e.key.alias("key"), flatten(e.value).alias("value")))
    return F.coalesce(maps.last_wins(flat), maps.empty())


def instant(nanos: Column) -> Column:
    """A time from epoch nanoseconds; zero, or what is no number, means it was not given."""
    n = nanos.try_cast("decimal(20,0)")
    return F.when(n > 0, F.timestamp_millis(F.floor(n / 1_000_000).cast("long")))


def severity(number: Column) -> Column:
    named = F.lit("info")
    for low, high, name in SEVERITY_BANDS:
        named = F.when(number.between(low, high), name).otherwise(named)
    return F.coalesce(named, F.lit("info"))


def _records(requests: DataFrame, payload: str, schema: str, groups: str, scopes: str, items: str) -> DataFrame:
    """One row per record, with its resource's attributes and its scope's name."""
    kept = [c for c in requests.columns if c != payload]
    group = f"_request.{groups}"
    return (
        requests.withColumn("_request", F.from_json(payload, schema))
        .select(*kept, F.explode(group).alias("_group"))
        .select(*kept, attributes(F.col("_group.resource.attributes")).alias("resource_attributes"), F.explode(f"_group.{scopes}").alias("_scope"))
        .select(
            *kept, "resource_attributes", F.coalesce("_scope.scope.name", F.lit("")).alias("scope_name"),
            F.explode(f"_scope.{items}").alias("r"),
        )
    )


def unreadable(requests: DataFrame, kind: str, payload: str = "payload") -> DataFrame:
    """The requests of a kind (logs, metrics, spans) of which something cannot be read, with a reason.

    What is left out of the rows of that kind is here, payload and all, so nothing is lost; what can be
    read of such a request is among the rows too. A list with one element of another type reads as none,
    and so does a list that is not there. A time or an integer that is no number reads as not given: a log or span
    keeps its row, marked as without a time, and a point has none. Metrics of other kinds, and points without a
    time or a value, are counted by `otlp_metrics_unsupported`.
    """
    schema, *names = _PARTS[kind]
    # An error in a request is told with the whole type it was found in, which costs far more than reading it, so faults are
    # looked for without the types of attributes. Only a request without one is read as its rows are.
    told = _told(requests, kind, F.col(payload), schema.replace(_ATTRS, "STRING"), names, "_fault")
    told = _told(told, kind, F.when(F.col("_fault").isNull(), F.col(payload)), schema, names, "reason", F.col("_fault"))
    return told.where(F.col("reason").isNotNull()).select(*requests.columns, "reason")


def _told(requests: DataFrame, kind: str, text: Column, schema: str, names: list[str], out: str, known: Column | None = None) -> DataFrame:
    """Add `out`: what cannot be read of a request's text by a schema, where nothing is `known`, and null without a fault.

    Steps are staged, as a filter on the reason would be moved below the reading and take a copy of it for each use.
    """
    groups, scopes, items = names
    read = stage(requests, {"_groups": F.from_json(text, schema)[groups]})
    read = stage(read, {"_within": F.flatten(F.transform(F.filter("_groups", lambda g: g[scopes].isNotNull()), lambda g: g[scopes]))})
    read = stage(read, {"_listed": F.flatten(F.transform(F.filter("_within", lambda s: s[items].isNotNull()), lambda s: s[items]))})
    within, listed = F.col("_within"), F.col("_listed")
    partly = F.when(F.exists("_groups", lambda g: g[scopes].isNull()), "a group without scopes").when(
        F.exists(within, lambda s: s[items].isNull()), "a scope without records"
    )
    if kind == "metrics":
        unread = lambda m, data: m[data].isNotNull() & m[data].dataPoints.isNull()
        blank = lambda s: F.exists(s[items], lambda m: unread(m, "gauge") | unread(m, "sum"))
        partly = partly.when(F.exists(within, blank), "a metric without points")
    wrong = lambda n, type="decimal(20,0)": n.isNotNull() & n.try_cast(type).isNull()
    if kind == "metrics":
        held = F.transform(listed, lambda m: F.coalesce(m.gauge.dataPoints, m["sum"].dataPoints))
        read = stage(read, {"_points": F.flatten(F.filter(held, lambda p: p.isNotNull()))})
        points = F.col("_points")
        partly = partly.when(F.exists(points, lambda p: wrong(p.timeUnixNano)), "a time that is no number").when(
            F.exists(points, lambda p: p.asDouble.isNull() & wrong(p.asInt, "double")), "a value that is no number"
        )
    else:
        times = ("timeUnixNano", "observedTimeUnixNano") if kind == "logs" else ("startTimeUnixNano", "endTimeUnixNano")
        partly = partly.when(F.exists(listed, lambda r: wrong(r[times[0]]) | wrong(r[times[1]])), "a time that is no number")
    reason = (
        F.when(F.col("_groups").isNotNull(), partly)
        .when(text.isNull(), "no payload")
        .when(F.get_json_object(text, "$").isNull(), "not JSON")
        .otherwise("no records")
    )
    if known is not None:
        reason = F.when(known.isNotNull(), known).otherwise(reason)
    return stage(read, {out: reason}).select(*requests.columns, out)


def otlp_logs(requests: DataFrame, payload: str = "payload", received: str = "received_at") -> DataFrame:
    """Log rows. A record's own attributes override its resource's."""
    rows = _records(requests, payload, *_PARTS["logs"])
    at = F.coalesce(instant(F.col("r.timeUnixNano")), instant(F.col("r.observedTimeUnixNano")))
    marks = maps.of(
        {
            "otlp.severity_text": F.nullif(F.col("r.severityText"), F.lit("")),
            "otlp.timestamp.missing": F.when(at.isNull(), "true"),
        }
    )
    merged = maps.merge(maps.merge(F.col("resource_attributes"), attributes(F.col("r.attributes"))), marks)
    return (
        rows.withColumn("attributes", merged)
        .withColumn("observed_at", F.coalesce(at, F.col(received)))
        .withColumn("ingested_at", F.col(received))
        .withColumn("source_kind", F.lit("otlp"))
        .withColumn("severity", severity(F.col("r.severityNumber")))
        .withColumn("facility", F.lit(1))
        .withColumn("body", F.when(F.col("r.body").isNull(), "").otherwise(flatten(F.col("r.body"))))
        .withColumn("host_name", F.coalesce(F.try_element_at("attributes", F.lit("host.name")), F.lit("")))
        .withColumn("service_name", F.coalesce(F.try_element_at("attributes", F.lit("service.name")), F.lit("")))
        .withColumn("trace_id", F.lower(F.coalesce("r.traceId", F.lit(""))))
        .withColumn("span_id", F.lower(F.coalesce("r.spanId", F.lit(""))))
        .drop("r", received)
    )


def _points(requests: DataFrame, payload: str) -> DataFrame:
    rows = _records(requests, payload, *_PARTS["metrics"])
    return rows.withColumn("_points", F.coalesce("r.gauge.dataPoints", "r.sum.dataPoints"))


def _point_value(point: Column) -> Column:
    return F.coalesce(point.asDouble, point.asInt.try_cast("double"))


def otlp_metrics(requests: DataFrame, payload: str = "payload", received: str = "received_at") -> DataFrame:
    """Metric rows from gauges and sums. Labels are the point's own attributes."""
    rows = _points(requests, payload).withColumn("p", F.explode("_points"))
    summed = F.coalesce(F.col("r.sum.isMonotonic"), F.when(F.col("r.sum").isNotNull(), F.lit(False)))
    monotonic = maps.of({"otlp.monotonic": summed.cast("string")})
    return (
        rows.withColumn("observed_at", instant(F.col("p.timeUnixNano")))
        .withColumn("value", _point_value(F.col("p")))
        .where(F.col("observed_at").isNotNull() & F.col("value").isNotNull())
        .withColumn("ingested_at", F.col(received))
        .withColumn("metric", F.col("r.name"))
        .withColumn("unit", F.coalesce("r.unit", F.lit("")))
        .withColumn("labels", maps.merge(attributes(F.col("p.attributes")), monotonic))
        .drop("r", "p", "_points", "scope_name", received)
    )


def otlp_metrics_unsupported(requests: DataFrame, payload: str = "payload") -> DataFrame:
    """How much was not converted: metrics of other kinds, and points without a time or a value."""
    empty = F.size(F.filter("_points", lambda p: instant(p.timeUnixNano).isNull() | _point_value(p).isNull()))
    return _points(requests, payload).agg(
        F.coalesce(F.sum(F.when(F.col("_points").isNull(), 1).otherwise(empty)), F.lit(0)).alias("unsupported")
    )


def sampling_probability(state: Column) -> Column:
    """The probability a trace state gives, or 0 when it gives none that can be read.

    The first readable member wins: an exponent `p`, or a rejection threshold `th` that is padded
    on the right to fourteen digits.
    """
    vendor = F.filter(
        F.transform(F.split(state, ","), lambda e: F.split(e, "=", 2)),
        lambda e: (F.size(e) == 2) & (F.trim(F.get(e, F.lit(0))) == "ot"),
    )
    members = F.flatten(F.transform(vendor, lambda e: F.split(F.get(e, F.lit(1)), ";")))

    def probability(member: Column) -> Column:
        name = F.trim(F.substring_index(member, ":", 1))
        raw = F.trim(F.regexp_extract(member, r"^[^:]*:(.*)$", 1))
        exponent = F.when(raw.rlike(r"^\+?[0-9]+$"), raw).try_cast("int")
        threshold = F.conv(F.rpad(F.when(raw.rlike(r"^[0-9a-fA-F]{1,14}$"), raw), 14, "0"), 16, 10).cast("double")
        return F.when((name == "p") & exponent.between(0, 62), F.pow(F.lit(0.5), exponent)).when(
            name == "th", 1 - threshold / F.lit(2.0**56)
        )

    found = F.filter(F.transform(members, probability), lambda v: v.isNotNull())
    return F.coalesce(F.get(found, F.lit(0)), F.lit(0.0)).cast("float")


def otlp_spans(requests: DataFrame, payload: str = "payload", received: str = "received_at") -> DataFrame:
    """Span rows. A span that ends before it starts lasts nothing, and says so."""
    rows = _records(requests, payload, *_PARTS["spans"])
    nanos = lambda c: F.coalesce(F.col(c).try_cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    start, end = nanos("r.startTimeUnixNano"), nanos("r.endTimeUnixNano")
    at = instant(F.col("r.startTimeUnixNano"))
    marks = maps.of(
        {
            "otlp.timestamp.missing": F.when(at.isNull(), "true"),
            "otlp.duration.negative": F.when(end < start, "true"),
            "otlp.end.missing": F.when(instant(F.col("r.endTimeUnixNano")).isNull(), "true"),
        }
    )
    named = lambda table, c, other: F.coalesce(
        F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), F.col(c)), F.lit(other)
    )
    lowered = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    return (
        rows.withColumn(
            "attributes",
            maps.merge(maps.merge(F.col("resource_attributes"), attributes(F.col("r.attributes"))), marks),
        )
        .withColumn("observed_at", F.coalesce(at, F.col(received)))
        .withColumn("ingested_at", F.col(received))
        .withColumn("trace_id", lowered("r.traceId"))
        .withColumn("span_id", lowered("r.spanId"))
        .withColumn("parent_span_id", lowered("r.parentSpanId"))
        .withColumn("name", F.coalesce("r.name", F.lit("")))
        .withColumn("kind", named(KINDS, "r.kind", "internal"))
        .withColumn("duration_ns", F.when(end >= start, (end - start).cast("long")).otherwise(0))
        .withColumn("status_code", named(STATUSES, "r.status.code", "unset"))
        .withColumn("status_message", F.coalesce("r.status.message", F.lit("")))
        .withColumn("sampling_probability", sampling_probability(F.coalesce("r.traceState", F.lit(""))))
        .drop("r", received)
    )
