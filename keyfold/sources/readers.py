"""Readers; every path may be in any store that Spark reads."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: (name, type) of a delimited lineitem line; lines end with the separator.
LINEITEM_FIELDS = (
    ("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"),
    ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"),
    ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_shipdate", "string"), ("l_commitdate", "string"),
    ("l_receiptdate", "string"), ("l_shipinstruct", "string"), ("l_shipmode", "string"), ("l_comment", "string"),
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """One row (value) a line, of any length."""
    return spark.read.text(list(paths))


def read_whole_files(spark: SparkSession, *paths: str, max_bytes: int | None = None) -> DataFrame:
    """One row (path, length, content) a file; larger files than max_bytes are left out if it is given."""
    files = spark.read.format("binaryFile").load(list(paths))
    return files.filter(F.col("length") <= max_bytes) if max_bytes else files


def delimited_lines(lines: DataFrame, fields: Sequence[tuple[str, str]], sep: str = "|", trailing: bool = True, strict: bool = True, column: str = "value") -> DataFrame:
    """Typed columns from delimited lines; lines with another number of fields are dropped.

    strict: a value that can't be read as its type fails the query; otherwise it becomes null.
    """
    parts = F.split(F.col(column), "\\Q" + sep + "\\E", -1)
    ok = lines.select(parts.alias("__p")).filter(F.size("__p") == len(fields) + trailing)
    get = [F.col("__p")[k] for k in range(len(fields))]
    return ok.select(*((c.cast(t) if strict else c.try_cast(t)).alias(n) for c, (n, t) in zip(get, fields, strict=True)))


def read_delimited(spark: SparkSession, paths: Sequence[str], fields: Sequence[tuple[str, str]] = LINEITEM_FIELDS, **options) -> DataFrame:
    return delimited_lines(read_lines(spark, *paths), fields, **options)


def union_inputs(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of all inputs."""
    return reduce(lambda a, b: a.unionByName(b), frames)
