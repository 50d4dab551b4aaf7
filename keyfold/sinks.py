"""JSON outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyfold.functions import json_number

_TAG = {"sum": "Sum", "max": "Max", "min": "Min", "avg": "Avg"}


def _value() -> Column:
    return F.when(F.col("agg") == "sum", F.col("sum")).when(F.col("agg") == "max", F.col("mx")).when(F.col("agg") == "min", F.col("mn")).otherwise(F.col("sum") / F.col("cnt"))


def json_cells(cells: DataFrame, omit_zero: bool = False) -> DataFrame:
    """(key, json): {"Sum":"12.5"} and so on; omit_zero leaves zero values out, as {}."""
    number = json_number(_value())
    tag = F.element_at(F.create_map(*(F.lit(x) for kv in _TAG.items() for x in kv)), F.col("agg"))
    full = F.concat(F.lit('{"'), tag, F.lit('":"'), number, F.lit('"}'))
    return cells.select("key", (F.when(number == "0", "{}").otherwise(full) if omit_zero else full).alias("json"))


def json_pairs(pairs: DataFrame, omit_zero: bool = False) -> DataFrame:
    """(key, json): {"key":k,"value":v} rows of a sorted result."""
    value = F.when(F.col("value") == 0, None).otherwise(F.col("value")) if omit_zero else F.col("value")
    return pairs.select("key", F.to_json(F.struct("key", value.alias("value"))).alias("json"))


def write_json(pairs: DataFrame, path: str, reducers: int | None = None, ordered: bool = True) -> None:
    """One JSON row a line. With reducers: hash partitions, each sorted by itself; else one global order.

    The commit protocol leaves _SUCCESS when, and only when, all of it is written.
    """
    out = pairs.repartition(reducers, "key").sortWithinPartitions("key") if reducers else pairs.orderBy("key") if ordered else pairs
    out.write.mode("overwrite").json(path)


def is_done(spark, path: str) -> bool:
    """Whether a write to this folder was completed."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
