"""Exactly-once effect over at-least-once messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH_ID = ("map_id", "batch_id", "message_id")


def dedupe_batch(messages: DataFrame) -> DataFrame:
    """One message for each (map_id, batch_id, message_id)."""
    return messages.dropDuplicates(list(BATCH_ID))


def dedupe_simple(messages: DataFrame, key: str = "message_id") -> DataFrame:
    """One message for each id."""
    return messages.dropDuplicates([key])


def expected_batches(metadata: DataFrame) -> DataFrame:
    """Batches to expect in all; a mapper that reports twice counts once."""
    return metadata.dropDuplicates(["map_id"]).agg(F.coalesce(F.sum("num_batches"), F.lit(0)).cast("long").alias("expected"))


def drop_padding(messages: DataFrame, flag: str = "empty") -> DataFrame:
    """Without the rows that only fill up a batch."""
    return messages.filter(~F.coalesce(F.col(flag), F.lit(False)))
