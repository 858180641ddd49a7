"""Lexicographic ascending sorts by one to four keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import numbered


def sort(df: DataFrame, *keys: str) -> DataFrame:
    if not 1 <= len(keys) <= 4:
        raise ValueError("one to four keys")
    return df.orderBy(*(F.col(k).asc() for k in keys))


def sort_positions(df: DataFrame, *keys: str) -> DataFrame:
    """df with each row's place in the order, from 0; the last key must make rows distinct."""
    if not 1 <= len(keys) <= 4:
        raise ValueError("one to four keys")
    return numbered(df, *keys)
