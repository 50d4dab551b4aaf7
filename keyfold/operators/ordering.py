"""HAVING and ORDER BY over (key, value) results, with ties broken by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def having(df: DataFrame, condition: Column | str) -> DataFrame:
    return df.filter(condition)


def sort_by_value(df: DataFrame, ascending: bool = True) -> DataFrame:
    return df.orderBy(F.col("value") if ascending else F.col("value").desc(), "key")


def sort_by_key(df: DataFrame) -> DataFrame:
    return df.orderBy("key")


def sort_within_partitions(df: DataFrame, n: int, *columns: str) -> DataFrame:
    """Each of n hash partitions sorted by itself."""
    return df.repartition(n, "key").sortWithinPartitions(*(columns or ("key",)))
