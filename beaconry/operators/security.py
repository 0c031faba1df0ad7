"""Security events out of log lines: message grammar, common field names, class and summary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconry.functions import maps
from beaconry.functions.staging import stage

# How many pairs make a grammar rather than a sentence (fixed values).
MIN_PAIRS = 3

# Names vendors give a field, by the common name of the field (fixed values).
FIELDS = {
    "source.ip": ("src", "srcip", "src_ip", "saddr", "sourceip", "source_address", "client_ip"),
    "destination.ip": ("dst", "dstip", "dst_ip", "daddr", "destinationip", "destination_address"),
    "source.port": ("spt", "sport", "src_port", "srcport", "sourceport"),
    "destination.port": ("dpt", "dport", "dst_port", "dstport", "destinationport"),
    "network.transport": ("proto", "protocol", "ipproto", "transport"),
    "user.name": ("user", "usr", "username", "user_name", "suser", "duser", "account", "login"),
    "event.action": ("act", "action", "disposition", "verdict"),
    "event.outcome": ("outcome", "result", "status"),
    "dns.question.name": ("query", "qname", "question", "domain"),
    "dns.response_code": ("rcode", "response_code"),
    "dns.question.type": ("qtype",),
    "rule.name": ("rule", "rulename"),
    "rule.id": ("policyid", "policy_id"),
    "observer.ingress.interface.name": ("srcintf",),
    "observer.egress.interface.name": ("dstintf",),
    "observer.name": ("devname",),
    "host.name": ("hostname",),
}

# Words that decide a class (fixed values).
ALLOW = ("allow", "allowed", "accept", "accepted", "pass", "permit", "permitted")
DENY = ("deny", "denied", "drop", "dropped", "block", "blocked", "reject", "rejected", "discard")
SUCCEEDED = ("success", "succeeded", "accept", "accepted", "ok", "pass", "passed")
FAILED = ("fail", "failed", "failure", "invalid", "denied", "reject", "rejected")
OPENED = ("start", "started", "connect", "connected", "login", "logon", "up")
CLOSED = ("stop", "stopped", "disconnect", "disconnected", "logout", "logoff", "down")
TUNNEL = ("vpn", "ipsec", "ssl-vpn", "sslvpn", "anyconnect", "wireguard", "tunnel")

# How a class of event is put in a sentence (fixed values).
VERBS = {
    "allowed": "Allowed", "denied": "Denied", "success": "Succeeded", "failure": "Failed",
    "start": "Started", "end": "Ended", "query": "Queried",
}

# A key starts where a run of its characters does, or where the last pair ended.
PAIR = r'(?:(?<![^\s=])|\G)[^\s=]*+=(?:"[^"]*"?|\S*)'
_CEF_FIELD = r"((?:[^|\\]|\\.)*+)\|"
CEF = r"(?s)^\s*CEF:[^|]*\|" + _CEF_FIELD * 6 + r"(.*)$"
ALIASES = {alias: field for field, names in FIELDS.items() for alias in names}


def key_values(text: Column) -> Column:
    """`k=v` pairs of a text as a map, quoted values whole, the first of a repeat kept."""
    pairs = F.transform(
        F.regexp_extract_all(text, F.lit(PAIR), F.lit(0)),
        lambda p: F.struct(
            F.substring_index(p, "=", 1).alias("key"), F.substr(p, F.instr(p, "=") + 1).alias("value")
        ),
    )
    bare = lambda v: F.when(v.startswith('"'), F.regexp_replace(v, '^"|"$', "")).otherwise(v)
    named = F.transform(F.filter(pairs, lambda e: e.key != ""), lambda e: F.struct(e.key.alias("key"), bare(e.value).alias("value")))
    return maps.first_wins(named)


def _enough(fields: Column) -> Column:
    return F.when(F.size(fields) >= MIN_PAIRS, fields)


def cef_fields(body: Column) -> Column:
    """Struct of a CEF message's vendor, name and fields; null for any other message."""
    part = lambda i: F.trim(
        F.regexp_replace(F.regexp_extract(body, CEF, i), r"(?s)\\([|\\])", "$1")
    )
    extension = F.regexp_replace(F.regexp_extract(body, CEF, 7), r"(?s)\\([|\\])", "$1")
    severity = F.create_map(F.lit("cef.severity"), part(6))
    # The prefix is looked for first: the pattern is costly.
    return F.when(
        body.contains("CEF:") & body.rlike(CEF),
        F.struct(
            F.nullif(part(1), F.lit("")).alias("vendor"),
            F.nullif(part(5), F.lit("")).alias("name"),
            maps.merge(severity, key_values(extension)).alias("fields"),
        ),
    )


def json_fields(body: Column) -> Column:
    """The top level of a JSON object as text; nested values stay as JSON."""
    text = F.trim(body)
    whole = F.when(text.startswith("{") & text.endswith("}"), text)
    parsed = F.map_entries(F.from_json(whole, "map<string,string>"))
    filled = F.transform(
        F.filter(parsed, lambda e: e.key != ""),
        lambda e: F.struct(e.key.alias("key"), F.coalesce(e.value, F.lit("null")).alias("value")),
    )
    return _enough(maps.first_wins(filled))


def structured_fields(structured: Column) -> Column:
    """Structured data by the last part of each name, in order of the full name."""
    named = F.transform(
        F.array_sort(F.map_entries(structured)),
        lambda e: F.struct(F.regexp_extract(e.key, r"([^.]*)$", 1).alias("key"), e.value.alias("value")),
    )
    return _enough(maps.first_wins(F.filter(named, lambda e: e.key != "")))


def with_shape(df: DataFrame, body: str = "body", structured: str | None = None) -> DataFrame:
    """Add `shape`, `fields`, `message_vendor` and `message_name`; null where no grammar fits.

    CEF comes before key=value because its extension is key=value.
    """
    text = F.col(body)
    staged = stage(df, {"_cef": cef_fields(text), "_json": json_fields(text)})
    # Only what neither of those fits is searched for pairs.
    rest = F.col("_cef").isNull() & F.col("_json").isNull()
    staged = stage(
        staged,
        {
            "_kv": F.when(rest & text.contains("="), _enough(key_values(text))),
            "_sd": F.when(rest, structured_fields(F.col(structured))) if structured else F.lit(None).cast(maps.STRING_MAP),
        },
    )
    return staged.select(
        *df.columns,
        F.when(F.col("_cef").isNotNull(), "cef")
        .when(F.col("_json").isNotNull(), "json")
        .when(F.col("_kv").isNotNull(), "key_value")
        .when(F.col("_sd").isNotNull(), "structured_data")
        .alias("shape"),
        F.coalesce("_cef.fields", "_json", "_kv", "_sd").alias("fields"),
        F.col("_cef.vendor").alias("message_vendor"),
        F.col("_cef.name").alias("message_name"),
    )


def to_common(fields: Column) -> Column:
    """Vendor keys under common names; unknown ones as `vendor.<key>`, blank values dropped.

    When two keys mean one field, the alphabetically first raw key wins.
    """
    table = F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))

    def renamed(e: Column) -> Column:
        key = F.replace(F.lower(F.trim(e.key)), F.lit("-"), F.lit("_"))
        name = F.coalesce(F.try_element_at(table, key), F.concat(F.lit("vendor."), key))
        return F.struct(name.alias("key"), F.trim(e.value).alias("value"))

    present = F.filter(F.array_sort(F.map_entries(fields)), lambda e: F.trim(e.value) != "")
    return maps.first_wins(F.transform(present, renamed))


def _value(fields: Column, key: str) -> Column:
    return F.nullif(F.trim(F.try_element_at(fields, F.lit(key))), F.lit(""))


def _word(value: Column, *choices: tuple[list[str], str]) -> Column:
    """The first choice whose word list holds the whole value."""
    lowered = F.lower(value)
    return reduce(
        lambda rest, choice: F.when(lowered.isin(*choice[0]), choice[1]).otherwise(rest),
        reversed(choices),
        F.lit(None).cast("string"),
    )


def classify(fields: Column, context: Column) -> Column:
    """Struct of category and type, or null for a message that is not a security event."""
    action, outcome = _value(fields, "event.action"), _value(fields, "event.outcome")
    user = _value(fields, "user.name")
    verdict = lambda v: _word(v, (DENY, "denied"), (ALLOW, "allowed"))
    result = lambda v: _word(v, (FAILED, "failure"), (SUCCEEDED, "success"))
    session = lambda v: _word(v, (OPENED, "start"), (CLOSED, "end"))
    signed_in = F.coalesce(result(outcome), result(action))
    in_session = F.coalesce(session(action), session(outcome), signed_in)
    passed = F.coalesce(verdict(action), verdict(outcome))
    tunnel = F.arrays_overlap(F.split(F.lower(context), "[^a-z0-9-]"), F.array(*map(F.lit, TUNNEL)))
    both_ends = _value(fields, "source.ip").isNotNull() & _value(fields, "destination.ip").isNotNull()
    named = lambda category, kind: F.struct(F.lit(category).alias("category"), kind.alias("type"))
    return (
        F.when(_value(fields, "dns.question.name").isNotNull(), named("dns", F.lit("query")))
        .when(user.isNotNull() & tunnel & in_session.isNotNull(), named("vpn", in_session))
        .when(both_ends & passed.isNotNull(), named("network", passed))
        .when(user.isNotNull() & signed_in.isNotNull(), named("authentication", signed_in))
    )


def summary(category: Column, kind: Column, fields: Column, name: Column) -> Column:
    """What happened, in the device's own words when it gave some."""
    at = lambda key: F.try_element_at(fields, F.lit(key))
    or_mark = lambda key: F.coalesce(at(key), F.lit("?"))
    verb = F.try_element_at(F.create_map(*(F.lit(x) for pair in VERBS.items() for x in pair)), kind)
    port = F.coalesce(F.concat(F.lit(":"), at("destination.port")), F.lit(""))
    origin = F.coalesce(F.concat(F.lit(" from "), at("source.ip")), F.lit(""))
    code = F.coalesce(F.concat(F.lit(" — "), at("dns.response_code")), F.lit(""))
    said = (
        F.when(category == "network", F.concat(verb, F.lit(" "), or_mark("source.ip"), F.lit(" → "), or_mark("destination.ip"), port))
        .when(category == "dns", F.concat(F.lit("Resolved "), or_mark("dns.question.name"), code))
        .otherwise(F.concat(verb, F.lit(" for "), or_mark("user.name"), origin))
    )
    return F.coalesce(F.nullif(F.trim(name), F.lit("")), said)


def security_events(logs: DataFrame, structured: str | None = None, app: str = "service_name") -> DataFrame:
    """Event rows for the log rows that are security events; other rows yield nothing.

    The log row is untouched and its attributes are carried, the event's own winning. The app name
    and a CEF message's event name are context: they tell a tunnel from a sign-in and nothing more.
    """
    shaped = with_shape(logs, "body", structured).where(F.col("shape").isNotNull())
    context = F.concat_ws(" ", F.col(app), F.col("message_name"))
    common = stage(shaped.withColumnRenamed("fields", "_raw"), {"fields": to_common(F.col("_raw"))}).drop("_raw")
    return (
        stage(common, {"_class": classify(F.col("fields"), context)})
        .where(F.col("_class").isNotNull())
        .withColumn("event_category", F.col("_class.category"))
        .withColumn("event_type", F.col("_class.type"))
        .withColumn("summary", summary(F.col("event_category"), F.col("event_type"), F.col("fields"), F.col("message_name")))
        .withColumn("attributes", maps.merge(F.col("attributes"), F.col("fields")))
        .withColumn(
            "attributes",
            F.when(
                F.col("message_vendor").isNotNull(),
                maps.merge(F.col("attributes"), F.create_map(F.lit("observer.vendor"), F.col("message_vendor"))),
            ).otherwise(F.col("attributes")),
        )
        .drop("_class", "message_vendor", "message_name")
    )
