"""The shipped workloads: pricing summary, revenue forecast and word count."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.config import JobConfig
from keyfold.functions import words
from keyfold.operators.aggregates import Measure, unpivot_measures
from keyfold.plans.job import Job

Q1_KEYS = ("l_returnflag", "l_linestatus")
Q1_MEASURES = (
    Measure("l_quantity_sum", "sum", "l_quantity"),
    Measure("l_base_price_sum", "sum", "l_extendedprice"),
    Measure("l_disc_price_sum", "sum", "l_extendedprice * (1 - l_discount)"),
    Measure("l_charge_sum", "sum", "l_extendedprice * (1 - l_discount) * (1 + l_tax)"),
    Measure("quantity_avg", "avg", "l_quantity"),
    Measure("avg_price", "avg", "l_extendedprice"),
    Measure("avg_disc", "avg", "l_discount"),
    Measure("count", "count"),
)


def pricing_summary(cutoff: str = "1998-09-02", **config) -> Job:
    """TPC-H Q1: eight measures a (return flag, line status)."""
    return Job(Q1_KEYS, Q1_MEASURES, lambda df: df.filter(F.col("l_shipdate") <= F.lit(cutoff).cast("timestamp_ntz")), sort=Q1_KEYS, config=JobConfig(**config))


def pricing_summary_long(lineitem: DataFrame, cutoff: str = "1998-09-02") -> DataFrame:
    """Q1 as (key, value) rows, such as A-F-count."""
    return unpivot_measures(dataclasses.replace(pricing_summary(cutoff), sort=None).apply(lineitem), Q1_KEYS, [m.name for m in Q1_MEASURES])


def revenue_forecast(year: int = 1995, strict: bool = False, **config) -> Job:
    """TPC-H Q6. strict leaves the discounts 0.05 and 0.07 themselves out."""

    def rows(df: DataFrame) -> DataFrame:
        start, end = (F.lit(f"{y}-01-01").cast("timestamp_ntz") for y in (year, year + 1))
        d = F.col("l_discount")
        return df.filter((F.col("l_shipdate") >= start) & (F.col("l_shipdate") < end) & (F.col("l_quantity") < 24) & ((d > 0.05) & (d < 0.07) if strict else d.between(0.05, 0.07)))

    return Job((), (Measure("revenue", "sum", "l_extendedprice * l_discount"),), rows, config=JobConfig(**config))


def word_count(at_least: int = 1, column: str = "text", **config) -> Job:
    """Words and how often they occur, rarest first."""
    return Job(
        ("word",), (Measure("n", "count"),), lambda df: df.select(F.explode(words(F.col(column))).alias("word")),
        having=None if at_least <= 1 else F.col("n") >= at_least, sort=("n", "word"), config=JobConfig(**config),
    )
