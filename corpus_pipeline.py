"""From raw documents to token ids: five stages, each written as Parquet and read again by the next.

Every stage judges rows by their own text, so null, shared and repeated ids do not disturb it; null and
empty texts are never toxic, linked, contaminated or personal data, and stay. An empty table goes
through as an empty table. Further columns of documents are carried along, whatever their names. Stages
set the session's Arrow batch size, which holds for the session from then on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keyfold.llm.decontaminate import drop_contaminated
from keyfold.llm.frames import emptied, written
from keyfold.llm.jaccard import drop_linked
from keyfold.llm.pieces import round_trip
from keyfold.llm.pii import redact
from keyfold.llm.queries import vocabulary
from keyfold.llm.toxicity import drop_toxic

#: What counts as a near copy here; op8_jaccard has numbers of its own.
NEAR_SHINGLE, NEAR_PERCENT = 5, 80


def _small_batches(spark: SparkSession) -> None:
    """A thousand whole texts a batch: what Python workers hold at once stays small beside Spark's own memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier rejects, each scored by its whole text."""
    _small_batches(spark)
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by five words and a similarity of 0.8: that of the smallest doc_id; rows alike in id and text stay or go together."""
    _small_batches(spark)
    return drop_linked(docs, NEAR_SHINGLE, NEAR_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents of which a twentieth or more of the words stands in benchmark passages."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With personal data replaced by its kind, null texts as they are; n_chars stays that of the original text."""
    return redact(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, null as empty, and whether they decode to it."""
    _small_batches(spark)
    return round_trip(docs, vocabulary("piece_bpe_32k.model"))


STAGES = [("toxicity", toxicity), ("jaccard_join", jaccard_join), ("decontamination", decontamination), ("pii", pii), ("sentencepiece", sentencepiece)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
        if before is not None:
            emptied(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)


#: A learnt classifier, boosted trees and a tokenizer can't be said in SQL; tests use brute force.
ORACLE_SQL = None
