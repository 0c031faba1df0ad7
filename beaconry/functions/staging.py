"""Evaluating costly expressions once a row."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stage(df: DataFrame, named: Mapping[str, Column]) -> DataFrame:
    """Add columns that later expressions may use many times without being computed again.

    A plain projection is merged into its readers, which copies its expressions into each use; a
    parser built of several steps would grow with every one. A generator of one row is not merged.
    """
    made = F.struct(*(c.alias(n) for n, c in named.items()))
    return df.select(*(c for c in df.columns if c not in named), F.inline(F.array(made)))
