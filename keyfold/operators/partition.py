"""Dealing rows out: by key, evenly, and in two levels for skewed keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.functions import partition_id, salt
from keyfold.operators.aggregates import Measure


def with_partition_id(df: DataFrame, key: str, n: int, name: str = "partition_id") -> DataFrame:
    """Adds the md5-based partition of each row."""
    return df.withColumn(name, partition_id(F.col(key).cast("string"), n))


def hash_partitioned(df: DataFrame, key: str, n: int | None = None) -> DataFrame:
    """Rows of a key together."""
    return df.repartition(n, key) if n else df.repartition(key)


def randomly_partitioned(df: DataFrame, n: int, *columns: str) -> DataFrame:
    """Rows spread evenly and repeatably."""
    return df.repartition(n, salt(1 << 20, *(columns or df.columns)))


def two_stage_aggregate(df: DataFrame, keys: Sequence[str], measures: Sequence[Measure], salts: int = 16, spread_by: Sequence[str] = (), drop_empty: bool = False) -> DataFrame:
    """Aggregate by (key, salt), then merge the partial states by key.

    A hot key's rows go to up to ``salts`` tasks, dealt by the columns of spread_by or, without any,
    by the input partition they are in, which reads no further column. Floats may differ from the
    one-level result in the last digits, since the order of summation differs.
    """
    dealt = salt(salts, *spread_by) if spread_by else F.spark_partition_id() % salts
    names = [f"__{k}" for k in range(len(keys))]
    first = df.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), "*") if keys else df
    first = first.groupBy(*names, dealt.alias("__salt")).agg(*(c for m in measures for c in m.partial()), F.count(F.lit(1)).alias("__rows"))
    out = first.groupBy(*names).agg(*(m.final() for m in measures), F.sum("__rows").alias("__rows"))
    out = out.filter("__rows > 0") if drop_empty and not keys else out
    return out.select(*(F.col(n).alias(k) for k, n in zip(keys, names, strict=True)), *(m.name for m in measures))
