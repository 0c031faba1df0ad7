"""Predicates as columns. Each refuses what the query language refuses."""

from __future__ import annotations

import datetime as dt
import math
import operator
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconry.functions.scalars import attr, col, severity_num, tokens

COMPARE = {
    "eq": operator.eq, "ne": operator.ne, "lt": operator.lt,
    "lte": operator.le, "gt": operator.gt, "gte": operator.ge,
}

# Attribute keys that are ordinary columns on logs (fixed values).
PROMOTED = {"host.name": "host_name", "service.name": "service_name"}


def literal(value) -> Column:
    if isinstance(value, float) and not math.isfinite(value):
        raise ValueError("NaN and infinity cannot be compared")
    return F.lit(value)


def moment(t: dt.datetime) -> Column:
    """A point in time as a literal; without a zone it is UTC."""
    return F.lit(t if t.tzinfo else t.replace(tzinfo=dt.timezone.utc))


def time_window(column: str, start: dt.datetime | None, end: dt.datetime | None) -> Column:
    """The half-open window [start, end)."""
    if start is not None and end is not None and start >= end:
        raise ValueError("the window ends before it starts")
    terms = []
    if start is not None:
        terms.append(F.col(column) >= moment(start))
    if end is not None:
        terms.append(F.col(column) < moment(end))
    return reduce(operator.and_, terms, F.lit(True))


def floor_time(moment: dt.datetime, seconds: int) -> dt.datetime:
    epoch = dt.datetime(1970, 1, 1, tzinfo=moment.tzinfo)
    whole = math.floor((moment - epoch).total_seconds() / seconds) * seconds
    return epoch + dt.timedelta(seconds=whole)


def bucketed_window(
    column: str, start: dt.datetime | None, end: dt.datetime | None, grain_seconds: int
) -> Column:
    """A window over rollup buckets; the first bucket is kept whole."""
    return time_window(column, start and floor_time(start, grain_seconds), end)


def compare(field: Column | str, op: str, value) -> Column:
    if isinstance(value, (list, tuple, set)):
        raise ValueError("a comparison takes one value, not a list")
    if op not in COMPARE:
        raise ValueError(f"unknown comparison {op!r}")
    return COMPARE[op](col(field), literal(value))


def is_in(field: Column | str, values: Iterable, negate: bool = False) -> Column:
    items = list(values)
    if not items:
        raise ValueError("an empty list is not a membership test")
    test = col(field).isin(*items)
    return ~test if negate else test


def members(df: DataFrame, field: str, values: DataFrame, negate: bool = False) -> DataFrame:
    """Membership in a list held as a DataFrame, for lists too long to be literals."""
    keys = values.select(F.col(values.columns[0]).alias(field)).distinct()
    return df.join(keys, field, "left_anti" if negate else "left_semi")


def all_of(*terms: Column) -> Column:
    return _junction(operator.and_, terms)


def any_of(*terms: Column) -> Column:
    return _junction(operator.or_, terms)


def _junction(op, terms: Sequence[Column]) -> Column:
    if not terms:
        raise ValueError("an empty group is neither true nor false")
    return reduce(op, terms)


def _terms(terms: Sequence[str]) -> list[str]:
    found = [t for t in terms if t]
    if not found:
        raise ValueError("a text search needs at least one term")
    return found


def _literal_array(terms: Sequence[str]) -> Column:
    return F.array(*(F.lit(t) for t in terms))


def text_search(terms: Sequence[str], mode: str, field: str = "body") -> Column:
    """Search a text column by whole tokens, by substring or by phrase."""
    if field != "body":
        raise ValueError("text search is only offered on body")
    found = _terms(terms)
    body = F.col(field)
    substring = F.lower(body).contains(" ".join(found).lower())
    if mode == "substring":
        return substring
    if mode == "any_token":
        # A text that does not hold a term anywhere is not cut into tokens.
        return any_of(*(body.contains(t) for t in found)) & F.arrays_overlap(tokens(body), _literal_array(found))
    if mode == "all_token":
        return all_of(*(body.contains(t) for t in found)) & (F.size(F.array_except(_literal_array(found), tokens(body))) == 0)
    if mode == "phrase":
        # The cheap substring runs first, so only its few hits are tokenised.
        wanted = F.array_distinct(tokens(F.lit(" ".join(found))))
        return substring & (F.size(F.array_except(wanted, tokens(body))) == 0)
    raise ValueError(f"unknown text mode {mode!r}")


def exists(df: DataFrame, field: str, key: str | None = None) -> Column:
    """A map holds a key, or a text column is not empty."""
    kind = df.schema[field].dataType.typeName()
    if kind == "map" and key is not None:
        return F.map_contains_key(F.col(field), key)
    if kind == "string":
        return F.col(field) != ""
    raise ValueError(f"existence cannot be asked of {field}")


def attr_of(df: DataFrame, key: str, attributes: str = "attributes") -> Column:
    """An attribute, read from its promoted column where the signal has one."""
    promoted = PROMOTED.get(key)
    if promoted and promoted in df.columns:
        return F.coalesce(F.col(promoted), F.lit(""))
    return attr(attributes, key)


def severity_at_least(floor: str, field: str = "severity") -> Column:
    from beaconry.schemas import SEVERITIES

    if floor not in SEVERITIES:
        raise ValueError(f"unknown severity {floor!r}")
    return severity_num(field) >= SEVERITIES.index(floor) + 1
