"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are its distinct lower-cased words, pairs of neighbouring words and pairs with one
word between them, hashed into ``BUCKETS`` coordinates; each counts once. Every coordinate has its
own learning rate, and L1 keeps all but a few weights at zero, so what is broadcast is small and
bounded by the number of buckets.

Learning is online: labelled rows reach one learner as a stream, sorted by pass and hash, and none is
held. Their number is bounded by ``MAX_ROWS``, the rows of least hash among those labelled. Scoring
runs over all documents in parallel. A label that is null, or a document whose labels differ, follows
the largest label given; without labelled rows every score is 0. Null and empty texts have no
features and get the score of the bias alone. Rows are scored one by one: ids may be null, shared or of
any type, repeated rows get equal scores, and a label counts for every row of its id. Of labels with
equal hashes the smaller id is learnt first. An empty table gives an empty result; other columns may have
any name; long texts are scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

from keyfold.llm.frames import lean, quoted, texts
from keyfold.llm.textbatch import ALNUM, WordBlock, blocks, mix

BUCKETS = 1 << 20
#: Labelled rows that are learnt from at most, and how often each is seen.
MAX_ROWS, PASSES = 16_000, 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 10.0, 1.0
THRESHOLD = 0.3
_SKIP = np.uint64(0x9FB21C651E98DF25)


def _grams(b: WordBlock) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, bucket) of every word, pair and skip pair of a block."""
    h, doc = b.hashes, b.doc_of_word()
    cells = np.uint64(BUCKETS - 1)
    yield doc, (h & cells).astype(np.int64)
    for gap in (1, 2):
        same = doc[:-gap] == doc[gap:] if len(doc) > gap else np.zeros(0, bool)
        pair = mix(h[:-gap][same] * np.uint64(0xD6E8FEB86659FD93) + h[gap:][same] + _SKIP * np.uint64(gap)) if len(same) else np.zeros(0, np.uint64)
        yield doc[:-gap][same] if len(same) else np.zeros(0, np.int64), (pair & cells).astype(np.int64)


def _features(docs: DataFrame) -> DataFrame:
    """(label, h, features): the distinct buckets of each text, packed as 32-bit integers."""

    def run(batches):
        np.seterr(over="ignore")
        for batch in lean(batches):
            packed = []
            for lo, hi, b in blocks(batch.column("text"), ALNUM, lower=True):
                keys = np.unique(np.concatenate([doc * BUCKETS + cell for doc, cell in _grams(b)]))
                edges = np.searchsorted(keys, np.arange(hi - lo + 1) * BUCKETS)
                cells = (keys % BUCKETS).astype(np.uint32)
                packed += [cells[x:y].tobytes() for x, y in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("h"), pa.array(packed, pa.binary())], names=["label", "h", "features"])

    return docs.mapInArrow(run, "label int, h long, features binary")


class Ftrl:
    """FTRL-proximal with per-coordinate rates; the last coordinate is the bias, which has no L1."""

    def __init__(self, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        least = np.where(at == BUCKETS, 0.0, self.l1)
        return np.where(np.abs(z) <= least, 0.0, (np.sign(z) * least - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, cells: np.ndarray, label: int) -> None:
        at = np.append(cells.astype(np.int64), BUCKETS)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def train(docs: DataFrame, labels: DataFrame, may_learn: Column | None = None, max_rows: int = MAX_ROWS, passes: int = PASSES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[np.ndarray, np.ndarray]:
    """(buckets, weights) that are not zero, the bias last under bucket BUCKETS.

    may_learn: condition on labels (its column doc_id) that a row must meet to be learnt from.
    """
    known = labels.select(quoted(id_col).alias("doc_id"), quoted(label_col).cast("int").alias("label")).filter("doc_id is not null and label is not null")
    if may_learn is not None:
        known = known.filter(may_learn)
    known = known.groupBy("doc_id").agg(F.max("label").alias("label")).withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(max_rows)
    rows = texts(docs, id_col, text_col).join(F.broadcast(known), "doc_id").select("label", "h", "text")  # at most max_rows labels
    stream = _features(rows).select(F.explode(F.sequence(F.lit(1), F.lit(passes))).alias("turn"), "*").repartition(1).sortWithinPartitions("turn", "h")

    def run(batches):
        model = Ftrl()
        for batch in lean(batches):
            for label, cells in zip(batch.column("label").to_pylist(), batch.column("features"), strict=True):
                model.learn(np.frombuffer(cells.as_buffer(), np.uint32), label)
        at = np.arange(BUCKETS + 1)
        w = model.weights(at)
        used = np.flatnonzero(w)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(w[used])], names=["bucket", "weight"])

    got = sorted(stream.mapInArrow(run, "bucket long, weight double").collect())  # at most a row a bucket
    return np.array([r.bucket for r in got], np.int64), np.array([r.weight for r in got], np.float64)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """(doc_id, more columns, score, predicted), one row a document; "text" among more is the text, null as empty."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = texts(docs, id_col, text_col, *(c for c in more if c != "text"))
    schema = kept.select("doc_id", *more).schema.add("score", DoubleType()).add("predicted", IntegerType())

    def run(batches):
        np.seterr(over="ignore")
        at, w = sent.value
        table = np.zeros(BUCKETS + 1)
        table[at] = w
        for batch in lean(batches):
            total = [np.zeros(0)]
            for lo, hi, b in blocks(batch.column("text"), ALNUM, lower=True):
                hits = []
                for doc, cell in _grams(b):
                    some = np.flatnonzero(table[cell])
                    hits.append(doc[some] * BUCKETS + cell[some])
                keys = np.unique(np.concatenate(hits))
                total.append(np.bincount(keys // BUCKETS, table[keys % BUCKETS], minlength=hi - lo))
            p = 1 / (1 + np.exp(-np.clip(np.concatenate(total) + table[BUCKETS], -35, 35))) if len(at) else np.zeros(batch.num_rows)
            rest = [batch.column(c) for c in ("doc_id", *more)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", *more, "score", "predicted"])

    return kept.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """The quarter of documents that is never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(doc_id, held_out, score, predicted), one row a document; held-out documents teach nothing."""
    model = train(docs, labels, ~held_out(F.col("doc_id")), max_rows, PASSES, id_col, text_col, label_col)
    return score(docs, model, threshold, id_col, text_col).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """docs without those predicted toxic, judged row by row."""
    model = train(docs, labels, ~held_out(F.col("doc_id")), max_rows, PASSES, id_col, text_col, label_col)
    rest = [c for c in docs.columns if c != text_col]
    row = F.struct(*(quoted(c).alias(f"c{k}") for k, c in enumerate(rest)), quoted(text_col).isNotNull().alias("full"))
    whole = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"), row.alias("row"))
    kept = score(whole, model, threshold, "doc_id", "text", "text", "row").filter("predicted = 0")
    return kept.select(*(F.when(F.col("row")["full"], F.col("text")).alias(c) if c == text_col else F.col("row")[f"c{rest.index(c)}"].alias(c) for c in docs.columns))
