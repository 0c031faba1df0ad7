"""String maps: building with a rule for repeated keys, and merging."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from beaconry.functions.binding import let

STRING_MAP = "map<string,string>"


def entries(keys: Column, values: Column) -> Column:
    """An array of (key, value) structs from two arrays of one length."""
    return F.zip_with(keys, values, lambda k, v: F.struct(k.alias("key"), v.alias("value")))


def first_wins(pairs: Column) -> Column:
    """A map from (key, value) structs in which the first of a repeated key is kept."""

    def kept(p: Column, keys: Column) -> Column:
        return F.filter(p, lambda e, i: F.array_position(keys, e.key) == i + 1)

    return let(
        pairs, lambda p: let(F.transform(p, lambda e: e.key), lambda keys: F.map_from_entries(kept(p, keys)))
    )


def last_wins(pairs: Column) -> Column:
    return first_wins(F.reverse(pairs))


def merge(under: Column, over: Column) -> Column:
    """Both maps, with `over` winning where they share a key."""
    return let(
        over, lambda o: F.map_concat(F.map_filter(under, lambda k, v: ~F.map_contains_key(o, k)), o)
    )


def of(pairs: dict[str, Column]) -> Column:
    """A map of the named columns that are not null."""
    full = F.create_map(*(x for k, v in pairs.items() for x in (F.lit(k), v.cast("string"))))
    return F.map_filter(full, lambda k, v: v.isNotNull())


def empty() -> Column:
    return F.create_map().cast(STRING_MAP)
