"""Syslog lines to log rows. No line is lost: what cannot be read is kept and flagged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconry.functions import maps
from beaconry.functions.binding import let
from beaconry.functions.staging import stage
from beaconry.schemas import NIL_ID

# Severity names by code, and month names (fixed values).
SEVERITIES = ("emergency", "alert", "critical", "error", "warn", "notice", "info", "debug")
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")

PRIORITY = r"^<(0|[1-9][0-9]{0,2})>"
STAMP_3164 = r"^(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) ([ 0-9][0-9]) ([01][0-9]|2[0-3]):([0-5][0-9]):([0-5][0-9])"
TAG = r"(?s)^([A-Za-z0-9_.\-]{1,32})(?:\[([^\]]*)\]:?|:)(.*)$"
STAMP_3339 = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?([Zz]|[+-][0-9]{2}:[0-9]{2})$"
ELEMENT = r"(?s)\[(?:[^\]\"\\]++|\\.|\"(?:[^\"\\]++|\\.)*+\")*+\]"
ELEMENTS = rf"(?s)^(?:\[(?:[^\]\"\\]++|\\.|\"(?:[^\"\\]++|\\.)*+\")*+\])*+"
PARAM = r"(?s)\G\s*([^=]*)=\"((?:[^\"\\]|\\.)*)\""


def _blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _nilable(c: Column) -> Column:
    return F.when(~c.isin("-", ""), c)


def _elements(text: Column) -> Column:
    """Structured-data elements as a map of `id.name` to value, the last of a repeat kept."""

    def params(element: Column) -> Column:
        inner = F.substr(element, F.lit(2), F.length(element) - 2)
        return let(F.regexp_extract(inner, r"(?s)^([^ ]*)", 1), lambda name: named(name, inner))

    def named(name: Column, inner: Column) -> Column:
        rest = F.substr(inner, F.length(name) + 1)
        keys = F.transform(
            F.regexp_extract_all(rest, F.lit(PARAM), F.lit(1)), lambda k: F.concat(name, F.lit("."), k)
        )
        values = F.transform(
            F.regexp_extract_all(rest, F.lit(PARAM), F.lit(2)),
            lambda v: F.regexp_replace(v, r'\\(["\\\]])', "$1"),
        )
        # Neither an element nor a parameter without a name is kept.
        return F.filter(
            maps.entries(keys, values), lambda e: (name != "") & (F.length(e.key) > F.length(name) + 1)
        )

    return maps.last_wins(F.flatten(F.transform(F.regexp_extract_all(text, F.lit(ELEMENT), F.lit(0)), params)))


def _guess_year(rest: Column, received: Column) -> Column:
    """The instant a stamp without a year means, given when it arrived."""
    # A stamp that fits the pattern has its parts at fixed places, so they are cut without another match.
    number = lambda at: F.trim(F.substring(rest, at, 2)).try_cast("int")
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.substring(rest, 1, 3))
    day, hour, minute, second = (number(at) for at in (5, 8, 11, 14))

    def in_year(year: Column) -> Column:
        return F.when(
            rest.rlike(STAMP_3164),
            F.try_make_timestamp(year, month.cast("int"), day, hour, minute, second.cast("decimal(8,6)")),
        )

    this_year = in_year(F.year(received))
    ahead = this_year > received + F.expr("INTERVAL '1' DAY")
    return F.when(ahead, in_year(F.year(received) - 1)).otherwise(this_year)


def parse_syslog(lines: DataFrame, line: str = "line", received: str = "received_at") -> DataFrame:
    """Add facility, severity, timestamp, hostname, app_name, proc_id, msg_id, structured, message
    and parse_error to raw lines.

    A digit and a space after the priority mean RFC 5424, anything else RFC 3164. The year a 3164
    stamp lacks is that of receipt, or the one before when it would be more than a day ahead.
    """
    raw, got = F.col(line), F.col(received)
    kept = [F.col(c) for c in lines.columns]
    text = F.regexp_replace(raw, r"[\r\n]+$", "")
    number = F.regexp_extract("_text", PRIORITY, 1).try_cast("int")
    staged = stage(lines, {"_text": text})
    staged = stage(
        staged, {"_pri": F.when(number <= 191, number), "_rest": F.regexp_replace("_text", PRIORITY, "")}
    )
    staged = stage(staged, {"_new": F.col("_pri").isNotNull() & F.col("_rest").rlike("^[1-9] ")})
    staged = staged.withColumn("_old", F.col("_pri").isNotNull() & ~F.col("_new"))

    # RFC 5424: five fields and a tail, each present only if the ones before it are.
    header = F.split(F.substr(F.col("_rest"), F.lit(3)), " ", 6)
    field = lambda i: F.get("_head", F.lit(i))
    tail = field(5)
    staged = stage(staged, {"_head": F.when(F.col("_new"), header)})
    staged = stage(
        staged, {"_sd": F.when(tail.startswith("["), F.regexp_extract(tail, ELEMENTS, 0)).otherwise("")}
    )
    after_sd = F.substr(tail, F.length("_sd") + 1)
    broken = tail.startswith("[") & after_sd.startswith("[")
    space_off = lambda c: F.regexp_replace(c, "^ ", "")
    body_5424 = (
        F.when(tail.startswith("-"), space_off(F.substr(tail, F.lit(2))))
        .when(broken, after_sd)
        .when(tail.startswith("["), space_off(after_sd))
        .otherwise(F.coalesce(tail, F.lit("")))
    )
    stamp = _nilable(field(0))
    parsed_stamp = F.when(
        stamp.rlike(STAMP_3339), F.try_to_timestamp(F.regexp_replace(F.upper(stamp), "-00:00$", "Z"))
    )
    error_5424 = (
        F.when(stamp.isNotNull() & F.col("_stamp").isNull(), "rfc5424: unreadable timestamp")
        .when(tail.isNull(), "rfc5424: header ended early")
        .when(broken, "rfc5424: unterminated structured data")
    )

    # RFC 3164: a fixed-width stamp, a host, and a tag that is not delimited by spaces.
    short = F.octet_length("_rest") < 15
    when_3164 = F.when(F.col("_old") & ~short, _guess_year(F.col("_rest"), got))
    staged = stage(staged, {"_when": when_3164, "_stamp": parsed_stamp})
    after = F.when(F.col("_when").isNotNull(), F.ltrim(F.substr(F.col("_rest"), F.lit(17))))
    staged = stage(staged, {"_after": after})
    host_3164 = _blank_to_null(F.regexp_extract("_after", r"^([^ ]*)", 1))
    tagged = F.regexp_replace("_after", r"^[^ ]* ?", "")
    staged = stage(staged, {"_tagged": F.regexp_replace(tagged, r"^\s+", "")})
    has_tag = F.col("_tagged").rlike(TAG)
    tag = lambda i: F.when(has_tag, F.regexp_extract("_tagged", TAG, i))
    with_pid = F.col("_tagged").rlike(r"^[A-Za-z0-9_.\-]{1,32}\[")
    body_3164 = F.when(
        F.col("_when").isNotNull(), F.regexp_replace(F.coalesce(tag(3), F.col("_tagged")), r"^\s+", "")
    ).otherwise(F.col("_rest"))
    error_3164 = (
        F.when(short, "rfc3164: too short for a timestamp")
        .when(F.col("_when").isNull(), "rfc3164: unreadable timestamp")
        .when(host_3164.isNull(), "rfc3164: no hostname")
    )

    new, old = F.col("_new"), F.col("_old")
    none = F.lit(None).cast("string")
    severity = F.when(
        F.col("_pri").isNotNull(), F.element_at(F.array(*map(F.lit, SEVERITIES)), F.col("_pri") % 8 + 1)
    )
    return staged.select(
        *kept,
        F.coalesce(F.floor(F.col("_pri") / 8).cast("int"), F.lit(1)).alias("facility"),
        F.coalesce(severity, F.lit("notice")).alias("severity"),
        F.when(new, F.col("_stamp")).otherwise(F.col("_when")).alias("timestamp"),
        F.when(new, _nilable(field(1))).otherwise(host_3164).alias("hostname"),
        F.when(new, _nilable(field(2))).otherwise(tag(1)).alias("app_name"),
        F.when(new, _nilable(field(3))).when(with_pid, tag(2)).alias("proc_id"),
        F.when(new, _nilable(field(4))).otherwise(none).alias("msg_id"),
        F.when(new & ~broken, _elements(F.col("_sd"))).otherwise(maps.empty()).alias("structured"),
        F.when(new, F.regexp_replace(body_5424, "^\ufeff", ""))
        .when(old, body_3164)
        .when(F.col("_text") == "", raw)
        .otherwise(F.col("_text"))
        .alias("message"),
        F.when(new, error_5424)
        .when(old, error_3164)
        .when(F.col("_text") == "", "empty message")
        .otherwise("no priority")
        .alias("parse_error"),
    )


def sender(peer: Column) -> Column:
    """The address of a peer written with or without its port."""
    return F.regexp_replace(F.regexp_replace(peer, r"^(?:\[(.*)\]|([0-9.]+))(?::[0-9]+)?$", "$1$2"), "^::ffff:(?=[0-9]+\\.)", "")


def syslog_to_logs(parsed: DataFrame, received: str = "received_at", peer: str = "peer") -> DataFrame:
    """Log rows from parsed lines, with the sender's own fields under conventional names."""
    sd = F.transform_keys("structured", lambda k, v: F.concat(F.lit("syslog.sd."), k))
    named = maps.of(
        {
            "host.name": F.col("hostname"),
            "service.name": F.col("app_name"),
            "process.pid": F.col("proc_id"),
            "syslog.facility": F.col("facility"),
            "syslog.msgid": F.col("msg_id"),
            "syslog.source.address": sender(F.col(peer)),
            "parse.error": F.col("parse_error"),
            "syslog.timestamp.missing": F.when(F.col("timestamp").isNull(), "true"),
        }
    )
    made = {
        "observed_at": F.date_trunc("millisecond", F.coalesce("timestamp", received)),
        "ingested_at": F.col(received),
        "source_kind": F.lit("syslog"),
        "body": F.col("message"),
        "attributes": F.map_concat(named, sd),
        "host_name": F.coalesce("hostname", F.lit("")),
        "service_name": F.coalesce("app_name", F.lit("")),
        "trace_id": F.lit(""),
        "span_id": F.lit(""),
    }
    for column, empty in (("resource_id", NIL_ID), ("site_id", NIL_ID), ("source_vendor", "")):
        if column not in parsed.columns:
            made[column] = F.lit(empty)
    return parsed.withColumns(made)
