"""Queries by name, each with the SQL that checks it where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconry.plans.views import Tables, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query over `Tables`; its result is flattened to plain columns."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: plain(build(Tables(spark, folder)))
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return build

    return register


def plain(df: DataFrame) -> DataFrame:
    """Times as epoch milliseconds, maps and arrays as text, doubles to six places."""

    def flat(f):
        c, kind = F.col(f.name), f.dataType.typeName()
        if kind in ("timestamp", "timestamp_ntz"):
            return F.unix_millis(c.cast("timestamp")).alias(f.name)
        if kind == "map":
            pairs = F.transform(F.map_entries(c), lambda e: F.concat(e.key, F.lit("="), e.value))
            return F.array_join(F.array_sort(pairs), ";").alias(f.name)
        if kind == "array":
            return F.array_join(c.cast("array<string>"), ";").alias(f.name)
        if kind in ("double", "float"):
            return F.round(c.cast("double"), 6).alias(f.name)
        if kind in ("byte", "short", "integer"):
            return c.cast("bigint").alias(f.name)
        return c.alias(f.name)

    return df.select(*(flat(f) for f in df.schema.fields))


# Spellings of `plain` for the checking SQL.
def ms(c: str, name: str | None = None) -> str:
    return f"epoch_ms({c}) AS {name or c}"


def pairs(c: str, name: str | None = None) -> str:
    return (
        f"array_to_string(list_sort(list_transform(map_entries({c}), "
        f"lambda e: e.key || '=' || e.value)), ';') AS {name or c}"
    )


def r6(c: str, name: str) -> str:
    return f"round({c}, 6) AS {name}"
