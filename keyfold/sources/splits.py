"""What splits a set of files falls into. Spark plans its own input partitions; this is the report.

Files are taken in (path) order. Next-fit is a sequential fold, so it runs as one over the files of
each input, each of which is a group of its own and gives splits of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.config import MIB


def list_files(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, size), without reading contents."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths)).select("path", F.col("length").alias("size"))


def plan_splits(files: DataFrame, limit: int = 64 * MIB, group: str | None = None, order: str = "path", size: str = "size") -> DataFrame:
    """Whole files by next-fit: a file joins the open split if it still fits, else opens the next.

    A file above the limit gets a split of its own. Adds split (from 0). Empty files join the open split.
    The listing of one group is folded in one task; a listing holds files, not rows.
    """
    by = [group] if group else []
    packed = files.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(size).cast("long").alias("s")))).alias("fs"))
    start = "named_struct('k', -1, 'used', 0L, 'out', cast(array() as array<int>))"
    step = f"""(a, f) -> if(a.k < 0 or a.used + f.s > {limit},
        named_struct('k', a.k + 1, 'used', f.s, 'out', concat(a.out, array(a.k + 1))),
        named_struct('k', a.k, 'used', a.used + f.s, 'out', concat(a.out, array(a.k))))"""
    folded = packed.withColumn("ks", F.expr(f"aggregate(fs, {start}, {step}, a -> a.out)"))
    return folded.select(*by, F.inline(F.arrays_zip("fs", "ks"))).select(*by, F.col("fs.o").alias(order), F.col("fs.s").alias(size), F.col("ks").alias("split"))


def plan_line_splits(files: DataFrame, limit: int = 64 * MIB) -> DataFrame:
    """Byte ranges of at most ``limit`` bytes of each file: (path, split, first_byte, last_byte).

    Readers complete the last line of a range and skip the part of a line a range begins with, so
    every line is read once.
    """
    ranges = files.filter("size > 0").withColumn("split", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / limit).cast("int"))))
    first = F.col("split").cast("long") * limit
    return ranges.select("path", "split", first.alias("first_byte"), (F.least(F.col("size"), first + limit) - 1).alias("last_byte"))


def split_manifest(plan: DataFrame) -> DataFrame:
    """One JSON line a split: its files and bytes."""
    return plan.groupBy("split").agg(F.to_json(F.struct(F.first("split").alias("id"), F.sort_array(F.collect_list(F.struct("path", "size"))).alias("objects"), F.sum("size").alias("size"))).alias("value"))
