"""Scalar column functions shared by every operator."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from beaconry.functions.binding import let
from beaconry.schemas import SEVERITIES

# Widest and narrowest time bucket, in seconds (fixed values).
MIN_BUCKET, MAX_BUCKET = 1, 86_400

# Names of IP protocol numbers (fixed values).
PROTOCOLS = {
    1: "ICMP", 6: "TCP", 17: "UDP", 47: "GRE", 50: "ESP", 58: "ICMPv6", 89: "OSPF", 132: "SCTP",
}

# TTL values packets commonly start with (fixed values).
INITIAL_TTLS = (64, 128, 255)

IPV4 = r"^(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def time_bucket(ts: Column | str, seconds: int) -> Column:
    """The start of the epoch-aligned bucket holding `ts`."""
    if not MIN_BUCKET <= seconds <= MAX_BUCKET:
        raise ValueError("a time bucket must be between 1 second and 1 day")
    return F.timestamp_seconds(F.floor(F.unix_seconds(col(ts)) / seconds) * seconds)


def tokens(text: Column | str) -> Column:
    """Maximal runs of letters and digits, case kept."""
    return F.filter(F.split(col(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def attr(attributes: Column | str, key: str) -> Column:
    """A map value, with a missing key reading as the empty string."""
    return F.coalesce(F.try_element_at(col(attributes), F.lit(key)), F.lit(""))


def severity_num(severity: Column | str) -> Column:
    """The rank of a severity name from 1 to 9; null for a name that is not one."""
    ranks = F.array(*(F.lit(s) for s in SEVERITIES))
    return F.nullif(F.array_position(ranks, col(severity)), F.lit(0)).cast("int")


def label_key(labels: Column | str) -> Column:
    """A label map as one comparable string, for use where a map cannot be a key."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(col(labels)))))


def errors(status_code: Column | str = "status_code") -> Column:
    """1 for a failed span. Only `error` is a failure; `unset` is not."""
    return (col(status_code) == "error").cast("int")


def ipv4_number(address: Column | str) -> Column:
    """An IPv4 address as a number; null for anything else."""
    a = F.trim(col(address))
    octets = F.split(F.when(a.rlike(IPV4), a), r"\.")
    return reduce(lambda n, i: n * 256 + octets[i].cast("long"), range(1, 4), octets[0].cast("long"))


def ipv4_text(number: Column | str) -> Column:
    n = col(number)
    part = lambda shift: F.shiftright(n, shift).bitwiseAND(F.lit(255)).cast("string")
    return F.concat_ws(".", part(24), part(16), part(8), part(0))


def _groups(text: Column) -> Column:
    """The eight groups of an IPv6 address without leading zeros; null for anything else."""

    def whole(halves: Column) -> Column:
        side = lambda i: F.filter(F.split(F.coalesce(F.get(halves, F.lit(i)), F.lit("")), ":"), lambda g: g != "")
        zeros = 8 - F.size(side(0)) - F.size(side(1))
        return F.when(F.size(halves) == 1, F.split(F.get(halves, F.lit(0)), ":")).when(
            (F.size(halves) == 2) & (zeros > 0), F.concat(side(0), F.array_repeat(F.lit("0"), F.greatest(zeros, F.lit(0))), side(1))
        )

    def checked(groups: Column) -> Column:
        sound = (F.size(groups) == 8) & F.forall(groups, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
        return F.when(sound, F.transform(groups, lambda g: F.regexp_replace(g, "^0+(?=.)", "")))

    return let(F.split(text, "::"), lambda halves: let(whole(halves), checked))


def _ipv6_text(text: Column) -> Column:
    """The shortest spelling of an IPv6 address, a mapped IPv4 address as such; other texts as they are."""
    number = ipv4_number(F.regexp_extract(text, r":([0-9.]+)$", 1))
    part = lambda n: F.lower(F.hex(n))
    tail = F.concat(part(F.shiftright(number, 16)), F.lit(":"), part(number.bitwiseAND(F.lit(0xFFFF))))
    plain = F.when(number.isNotNull(), F.concat(F.regexp_replace(text, "[0-9.]+$", ""), tail)).otherwise(text)

    def spelled(groups: Column) -> Column:
        last = lambda i: F.conv(F.get(groups, F.lit(i)), 16, 10).cast("long")
        mapped = (F.get(groups, F.lit(5)) == "ffff") & F.forall(F.slice(groups, 1, 5), lambda g: g == "0")

        def short(joined: Column) -> Column:
            # The longest run of zero groups, the first of equals, is left out.
            runs = [rf"^(.*?)(?:^|:)0(?::0){{{n - 1}}}(?::|$)(.*)$" for n in range(8, 1, -1)]
            return F.coalesce(*(F.when(joined.rlike(r), F.regexp_replace(joined, r, "$1::$2")) for r in runs), joined)

        return F.when(mapped, ipv4_text(last(6) * 65536 + last(7))).otherwise(let(F.array_join(groups, ":"), short))

    return F.coalesce(let(_groups(plain), spelled), text)


def address_key(address: Column | str) -> Column:
    """A canonical spelling: mapped IPv4 loses its prefix, IPv6 is in its shortest lower-case form."""
    a = F.lower(F.trim(col(address)))
    return F.when(a.contains(":"), _ipv6_text(a)).otherwise(a)


def ip_scope(address: Column | str) -> Column:
    """Which address space an IPv4 address is in; `unknown` for anything else."""
    n = ipv4_number(address)
    within = lambda low, high: n.between(low, high)
    # Bounds of the special-purpose IPv4 blocks (fixed values).
    return (
        F.when(n.isNull(), "unknown")
        .when(within(0x7F000000, 0x7FFFFFFF), "loopback")
        .when(
            within(0x0A000000, 0x0AFFFFFF)
            | within(0xAC100000, 0xAC1FFFFF)
            | within(0xC0A80000, 0xC0A8FFFF),
            "private",
        )
        .when(within(0xA9FE0000, 0xA9FEFFFF), "link_local")
        .when(within(0x64400000, 0x647FFFFF), "carrier_grade")
        .otherwise("public")
    )


def protocol_name(protocol: Column | str) -> Column:
    """The name of an IP protocol, or its number when it has none here."""
    table = F.create_map(*(F.lit(x) for pair in PROTOCOLS.items() for x in pair))
    p = col(protocol).cast("int")
    return F.coalesce(F.try_element_at(table, p), p.cast("string"))


def initial_ttl(observed: Column | str) -> Column:
    """The TTL a packet most likely started with; null when none can be."""
    ttl = col(observed)
    return reduce(
        lambda rest, start: F.when(ttl <= start, F.lit(start)).otherwise(rest),
        reversed(INITIAL_TTLS),
        F.lit(None).cast("int"),
    )


def ttl_hops(observed: Column | str) -> Column:
    return initial_ttl(observed) - col(observed)


def probability_union(confidences: Column) -> Column:
    """1 - Π(1 - c) over an array of confidences."""
    doubt = F.aggregate(
        confidences,
        F.lit(1.0),
        lambda acc, c: acc * (F.lit(1.0) - F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))),
    )
    return F.lit(1.0) - doubt


def bucket_step(span_seconds: float, target: int = 60) -> int:
    """The narrowest readable step that draws a span in about `target` buckets."""
    # Bucket widths a chart may use, in seconds (fixed values).
    ladder = (
        1, 5, 10, 15, 30, 60, 120, 300, 600, 900, 1800, 3600, 7200, 10800, 21600, 43200, 86400,
    )
    ideal = max(1, round(span_seconds)) / target
    return next((step for step in ladder if step >= ideal), MAX_BUCKET)
