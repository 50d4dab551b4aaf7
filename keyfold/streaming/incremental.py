"""Keyed aggregates over a growing folder: de-duplication, state and a checkpoint in one query."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from keyfold.operators.aggregates import Measure


def stream_lines(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format("text")
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).load(path)


def stream_job(
    rows: DataFrame, keys: Sequence[str], measures: Sequence[Measure], checkpoint: str, sink: str = "table", name: str | None = None,
    dedupe: Sequence[str] = (), event_time: str | None = None, delay: str = "10 minutes", mode: str = "complete", path: str | None = None,
) -> StreamingQuery:
    """Starts a query that takes what is there and stops; run it again to take what came since.

    dedupe: columns that identify a message. With event_time, their state is dropped ``delay`` after
    the latest event; without, it is kept for ever. The checkpoint must be in a shared folder.
    sink "table": in complete mode, a Parquet table at path that each batch writes anew; no rows reach
    the driver, as they do with "memory".
    """
    if event_time:
        rows = rows.withWatermark(event_time, delay)
    if dedupe:
        rows = rows.dropDuplicatesWithinWatermark(list(dedupe)) if event_time else rows.dropDuplicates(list(dedupe))
    out = rows.groupBy(*keys).agg(*(m.column() for m in measures))
    if sink == "table" and (mode != "complete" or not path):
        raise ValueError("sink table takes a path and complete mode")
    writer = out.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    writer = writer.queryName(name) if name else writer
    if sink == "table":
        return writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).start()
    writer = writer.format(sink)
    return writer.start(path) if path else writer.start()
