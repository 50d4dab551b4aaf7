"""Keyed aggregates: sum, max, min, avg and count, wide or as a long table of cells.

Null values are ignored, as in SQL; a group of nulls only gives null. NaN is the largest value.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("sum", "max", "min", "avg", "count")


@dataclass(frozen=True)
class Measure:
    """One aggregate: its output name, kind and input expression (SQL text or a Column)."""

    name: str
    kind: str
    value: Column | str = "1"

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"unknown aggregate {self.kind!r}; known: {', '.join(KINDS)}")

    @property
    def input(self) -> Column:
        return F.expr(self.value) if isinstance(self.value, str) else self.value

    def column(self) -> Column:
        """The one-level aggregate."""
        return {"sum": F.sum, "max": F.max, "min": F.min, "avg": F.avg, "count": F.count}[self.kind](self.input).alias(self.name)

    def partial(self) -> list[Column]:
        """State of a first level; averages travel as sum and count."""
        x, n = self.input, self.name
        if self.kind == "avg":
            return [F.sum(x).alias(f"{n}__sum"), F.count(x).alias(f"{n}__cnt")]
        return [self.column().alias(f"{n}__{self.kind}")]

    def final(self) -> Column:
        """The second level over :meth:`partial`."""
        n = self.name
        if self.kind == "avg":
            total, count = F.sum(f"{n}__sum"), F.sum(f"{n}__cnt")
            return F.when(count > 0, total / count).alias(n)
        if self.kind == "count":
            return F.coalesce(F.sum(f"{n}__count"), F.lit(0).cast("long")).alias(n)
        return {"sum": F.sum, "max": F.max, "min": F.min}[self.kind](f"{n}__{self.kind}").alias(n)


def keyed_aggregate(df: DataFrame, keys: Sequence[str], measures: Sequence[Measure], drop_empty: bool = False) -> DataFrame:
    """One row a key. Without keys, a global aggregate: one row, or none over no rows if drop_empty."""
    out = df.groupBy(*keys).agg(*(m.column() for m in measures), *([F.count(F.lit(1)).alias("__rows")] if drop_empty and not keys else []))
    return out.filter("__rows > 0").drop("__rows") if drop_empty and not keys else out


# -- Long form: (key, agg, sum, cnt, mn, mx), one cell a key ------------------------------------

CELL = "key string, agg string, sum double, cnt long, mn double, mx double"


class MixedAggregatorsError(ValueError):
    """A key was given more than one kind of aggregate."""


def cells(df: DataFrame, key: Column | str, kind: str, value: Column | str) -> DataFrame:
    """Partial cells of one kind from rows."""
    if kind not in KINDS:
        raise ValueError(f"unknown aggregate {kind!r}")
    key, value = (F.col(key) if isinstance(key, str) else key), (F.expr(value) if isinstance(value, str) else value).cast("double")
    kind, value = ("sum", F.lit(1.0)) if kind == "count" else (kind, value)
    return df.groupBy(key.cast("string").alias("key")).agg(
        F.lit(kind).alias("agg"), F.sum(value).alias("sum"), F.count(value).alias("cnt"), F.min(value).alias("mn"), F.max(value).alias("mx")
    )


def merge_cells(*parts: DataFrame) -> DataFrame:
    """Merge partial cells; merging is associative and commutative. Mixed kinds on one key fail."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    merged = both.groupBy("key").agg(
        F.min("agg").alias("agg"), F.max("agg").alias("__other"), F.sum("sum").alias("sum"), F.sum("cnt").alias("cnt"), F.min("mn").alias("mn"), F.max("mx").alias("mx")
    )
    clash = F.raise_error(F.concat(F.lit("Mixed aggregators used: "), "key"))
    return merged.withColumn("agg", F.when(F.col("agg") == F.col("__other"), F.col("agg")).otherwise(clash)).drop("__other")


def one_kind(parts: DataFrame) -> DataFrame:
    """parts, if every key has one kind of aggregate; else MixedAggregatorsError, before anything is merged."""
    mixed = parts.groupBy("key").agg(F.min("agg").alias("a"), F.max("agg").alias("b")).filter("a <> b").select("key").limit(5).collect()
    if mixed:
        raise MixedAggregatorsError(f"Mixed aggregators used: {', '.join(sorted(r.key for r in mixed))}")
    return parts


def to_num(df: DataFrame) -> DataFrame:
    """(key, value) of cells."""
    value = F.when(F.col("agg") == "sum", F.col("sum")).when(F.col("agg") == "max", F.col("mx")).when(F.col("agg") == "min", F.col("mn")).when((F.col("agg") == "avg") & (F.col("cnt") > 0), F.col("sum") / F.col("cnt"))
    return df.select("key", value.alias("value"))


def unpivot_measures(wide: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """(key, value) rows, the key being the group's parts and the measure's name joined by '-'."""
    long = wide.unpivot(list(keys), [F.col(m).cast("double").alias(m) for m in measures], "measure", "value")
    return long.select(F.concat_ws("-", *keys, "measure").alias("key"), "value")
