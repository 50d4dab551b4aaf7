"""Small helpers that the operators share."""

from __future__ import annotations

import ctypes
import sys
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Anything but ASCII letters, digits and non-ASCII characters separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes up to which a table is sent to every executor; beyond, it is joined by an exchange.
BROADCAST_BYTES = 32 << 20


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder that the driver and all executors share.

    The cluster names that folder in spark.checkpoint.dir. Only where everything runs in one process,
    as in tests, the warehouse stands in for it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local") or spark.conf.get("spark.master").startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: lineage ends here, and a lost executor costs nothing."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def emptied(*tables: DataFrame) -> None:
    """Deletes tables from written() that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.written_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bounded(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df, marked for broadcast if its rows, of about row_bytes each, fit into limit; any join is right either way."""
    most = max(1, limit // row_bytes)
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def quoted(name: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def alnum_words(text: Column) -> Column:
    """Array of the runs of ASCII letters, digits and non-ASCII characters."""
    return F.array_remove(F.split(text, SEPARATORS), "")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """(doc_id, text, ...) with null texts as empty; other columns are left behind, whatever their names."""
    return docs.select(quoted(id_col).alias("doc_id"), F.coalesce(quoted(text_col), F.lit("")).alias("text"), *map(quoted, more))


def id_type(docs: DataFrame, column: str = "doc_id") -> str:
    """The type of an id column, for schemas of Python functions."""
    return docs.schema[column].dataType.simpleString()


def keyed_rows(docs: DataFrame) -> DataFrame:
    """Adds h, a hash of the text: (doc_id, h) tells rows of one id apart; rows alike in both get equal results."""
    return docs.withColumn("h", F.xxhash64("text"))


def by_row(rows: DataFrame, found: DataFrame, how: str = "left") -> DataFrame:
    """rows (doc_id, h, ...) joined with found (k, kh, ...), which has a row for each (id, hash) at most; null ids match each other."""
    return rows.join(found, rows["doc_id"].eqNullSafe(found["k"]) & (rows["h"] == found["kh"]), how)


def without(docs: DataFrame, bad: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs without the rows whose id and text hash stand in bad (doc_id, h); columns and texts as they are."""
    bad = bad.select(F.col("doc_id").alias("k"), F.col("h").alias("kh")).distinct()
    h = F.xxhash64(F.coalesce(docs["`" + text_col.replace("`", "``") + "`"], F.lit("")))
    return docs.join(bad, docs["`" + id_col.replace("`", "``") + "`"].eqNullSafe(bad["k"]) & (h == bad["kh"]), "left_anti")


def give_back() -> None:
    """Freed memory goes back to the system where the C library can do that; workers live on between tasks."""
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def lean(batches: Iterator[pa.RecordBatch], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of about ``limit`` bytes, or of one row; memory held in reserve is given back after each."""
    for batch in batches:
        rows = max(1, int(batch.num_rows * min(1.0, limit / max(1, batch.nbytes))))
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)
        del batch
        pa.default_memory_pool().release_unused()
        give_back()
