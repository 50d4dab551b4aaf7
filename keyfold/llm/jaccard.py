"""N-gram Jaccard join: all links between documents, and the components they form.

A document's set holds the hashes of its distinct word n-grams. Documents with equal sets form a
class, which goes on as one node. Two nodes are candidates only if they share a token in their
prefixes under each of three global orders of the tokens: the order that puts tokens rare in the
corpus first drives the join; then the pairs it gives are held against the prefixes under the two
other orders, which travel with the nodes, and only what shares tokens there too is verified.
Length, position and a parity bitmap (each token flips one of 256 bits; the bits in which two sets
differ can't outnumber the tokens in which they differ) cut candidates before that. No filter drops
a pair that meets the threshold, and verification compares n-grams word by word.

Token rarity comes from a sketch over all documents: a fixed number of counters, summed over all
tasks in a tree. Any order gives the right links; the counts only make prefixes selective. Every
order is total: equal ranks are told apart by the whole token.

Near copies come in groups in which nearly all pairs link. So the join runs twice: first each node
of a prefix bucket meets the bucket's pivot only; then the join of all meets only pairs that are not
in one component yet. A bucket of more than ``HOT`` nodes is split by a second token: sets that meet
the threshold share two tokens in prefixes that are one token longer. All links between components
are found, and no group is expanded into its pairs.

Null and empty texts have no set and link with nothing; their component is their own doc_id. Every
row counts by its own text: rows that share an id, and rows without one, link like others, and
repeated rows are in one class. A component is named by its smallest id, null if it has none. Ids may
be of any type; an empty table gives an empty result; other columns are left alone, whatever their
names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyfold.llm.components import components
from keyfold.llm.frames import bounded, by_row, emptied, id_type, keyed_rows, lean, texts, without, written
from keyfold.llm.textbatch import NOT_SPACE, WordBlock, blocks, exact_ngrams, mix, ngram_hash, slices, text_buffers

#: Counters of the rarity sketch, how many travel in one row, and how many rows are added up at once.
CELLS, CELL_BLOCK, FAN_IN = 1 << 20, 1 << 12, 64
SHINGLE, PERCENT = 3, 90
#: Nodes of a bucket beyond which it is split by a second token.
HOT = 500
#: Signed 64-bit patterns of a bitmap's four words.
_BITS = ("m0", "m1", "m2", "m3")


def _sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct n-gram hashes of every text, lower-cased; a shorter text is one n-gram."""
    for _, _, b in blocks(column, NOT_SPACE, lower=True):
        grams = {k: ngram_hash(b.hashes, k) for k in range(2, n + 1)}
        grams[1] = mix(b.hashes)
        for lo, hi in zip(b.first[:-1].tolist(), b.first[1:].tolist(), strict=True):
            k = min(n, hi - lo)
            yield np.unique(grams[k][lo : hi - k + 1]) if k else np.empty(0, np.uint64)


def _cell(s: np.ndarray) -> np.ndarray:
    return (s % np.uint64(CELLS)).astype(np.int64)


def _sketch(docs: DataFrame, n: int) -> np.ndarray:
    """How often the tokens of each cell occur in all sets of the corpus; a fixed number of cells."""

    def count(batches):
        np.seterr(over="ignore")
        total, held, size = np.zeros(CELLS, np.int64), [], 0
        for batch in lean(batches):
            for s in _sets(batch.column("text"), n):
                held.append(s)
                size += len(s)
                if size > CELLS:
                    total += np.bincount(_cell(np.concatenate(held)), minlength=CELLS)
                    held, size = [], 0
        if held:
            total += np.bincount(_cell(np.concatenate(held)), minlength=CELLS)
        rows = np.minimum(total, 2**32 - 1).astype(np.uint32).reshape(-1, CELL_BLOCK)
        task = np.full(len(rows), TaskContext.get().partitionId(), np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows), dtype=np.int32)), pa.array(task), pa.array([r.tobytes() for r in rows], pa.binary())], names=["block", "task", "counts"])

    def add(key, table):
        total = np.zeros(CELL_BLOCK, np.uint64)
        for x in table["counts"]:
            total += np.frombuffer(x.as_py(), np.uint32)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "task": pa.array([key[1].as_py()], pa.int32()), "counts": pa.array([np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()], pa.binary())})

    schema = "block int, task int, counts binary"
    sums = docs.select("text").mapInArrow(count, schema)
    for _ in range(3):  # the last sums what is left of FAN_IN ** 3 tasks and more
        sums = sums.select("block", F.floor(F.col("task") / FAN_IN).cast("int").alias("task"), "counts").groupBy("block", "task").applyInArrow(add, schema)
    rows = sums.collect()  # CELLS counters for each FAN_IN ** 3 tasks
    total = np.zeros((CELLS // CELL_BLOCK, CELL_BLOCK), np.uint64)
    for r in rows:
        total[r.block] += np.frombuffer(r.counts, np.uint32)
    return np.minimum(total, 2**32 - 1).astype(np.uint32).reshape(-1)


def _ranks(s: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranks under three global orders: rare tokens first; rare classes first, then hashed; hashed. Ties: the token itself."""
    c = counts[_cell(s)]
    hashed = mix(s ^ np.uint64(0x5851F42D4C957F2D))
    level = np.floor(np.log2(c + 1.0)).astype(np.uint64)
    return c, (level << np.uint64(58)) | (mix(hashed) >> np.uint64(6)), hashed


def _lists(rows: list[np.ndarray], kind: type) -> pa.Array:
    flat = np.concatenate(rows).view(kind) if rows else np.empty(0, kind)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(r) for r in rows])]), pa.int32()), pa.array(flat))


def _prefix_len(size: int, percent: int) -> int:
    return size + 1 - -(-percent * size // 100)


def _described(docs: DataFrame, counts, n: int, percent: int) -> DataFrame:
    """Per row: size and digest of its set, its prefixes under the three orders (the first longer by one token) and its bitmap."""

    def run(batches):
        np.seterr(over="ignore")
        for batch in lean(batches):
            size, digest, first, second, third, bits = [], [], [], [], [], []
            for s in _sets(batch.column("text"), n):
                k = _prefix_len(len(s), percent) if len(s) else 0
                a, b, c = (s[np.argsort(r, kind="stable")[: k + 1]] for r in _ranks(s, counts.value))  # s is sorted: ties by token
                size.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                first.append(a)
                second.append(b[:k].astype(np.uint32))
                third.append(c[:k].astype(np.uint32))
                odd = np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=256) & 1
                bits.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
            bits = np.array(bits, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("h"), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), _lists(first, np.int64), _lists(second, np.int32), _lists(third, np.int32), *(pa.array(np.ascontiguousarray(bits[:, k])) for k in range(4))],
                names=["doc_id", "h", "n", "c", "prefix", "second", "third", *_BITS],
            )

    schema = f"doc_id {id_type(docs)}, h long, n long, c binary, prefix array<long>, second array<int>, third array<int>, m0 long, m1 long, m2 long, m3 long"
    return docs.select("doc_id", "h", "text").mapInArrow(run, schema)


def _need(nx: Column, ny: Column, percent: int) -> Column:
    return F.ceil(percent * (nx + ny) / (100 + percent) - 1e-9)


def _places_allow(x: str, y: str, percent: int) -> Column:
    """Whether sizes and the places of the first shared token let two sets meet the threshold; x is the smaller one."""
    nx, ny, px, py = (F.col(f"{side}.{name}") for name in ("n", "pos") for side in (x, y))
    return (percent * ny <= 100 * nx) & (px <= nx - F.ceil(2 * percent * nx / (100 + percent) - 1e-9)) & (F.least(nx - px, ny - py) >= _need(nx, ny, percent))


def _bits_allow(x: str, y: str, percent: int) -> Column:
    """Whether the sets' bitmaps do."""
    nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
    differ = reduce(lambda a, b: a + b, (F.bit_count(F.col(f"{x}.{b}").bitwiseXOR(F.col(f"{y}.{b}"))) for b in _BITS))
    return differ <= nx + ny - 2 * _need(nx, ny, percent)


def _smaller(x: str, y: str) -> Column:
    return (F.col(f"{x}.n") < F.col(f"{y}.n")) | ((F.col(f"{x}.n") == F.col(f"{y}.n")) & (F.col(f"{x}.k") < F.col(f"{y}.k")))


def _meeting(pairs: DataFrame, nodes: DataFrame, percent: int, counted: list[int] | None) -> DataFrame:
    """The pairs (a, b) that bitmaps allow and that share prefix tokens under the second and the third order too."""
    of = lambda side, *what: nodes.select(F.col("k").alias(side), F.struct(*what).alias(f"of_{side}"))
    near = written(pairs.distinct().join(of("a", "n", *_BITS), "a").join(of("b", "n", *_BITS), "b").filter(_bits_allow("of_a", "of_b", percent)).select("a", "b"))
    both = near.join(of("a", "second", "third"), "a").join(of("b", "second", "third"), "b")
    share = lambda order: F.arrays_overlap(f"of_a.{order}", f"of_b.{order}")
    if counted is not None:
        counted += [near.count(), both.filter(share("second")).count(), both.filter(share("second") & share("third")).count()]
    out = written(both.filter(share("second") & share("third")).select("a", "b"))
    emptied(near)
    return out


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs whose texts meet the threshold, n-grams compared word by word."""
    used = pairs.select(F.explode(F.array("a", "b")).alias("k")).distinct()
    heads = written(nodes.select("k", F.col("doc_id").alias("k_id"), "h").join(used, "k").select(F.col("k").alias("node"), F.col("k_id").alias("k"), F.col("h").alias("kh")))
    named = written(by_row(docs, bounded(heads, 64), "inner").select("node", "text").dropDuplicates(["node"]))
    both = pairs.join(named.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").join(named.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")

    def run(batches):
        for batch in lean(batches):
            data, offsets = text_buffers(pa.array([t for xy in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True) for t in xy], pa.string()))
            keep = []
            for lo, hi in slices(offsets[::2]):
                at = offsets[2 * lo : 2 * hi + 1]
                b = WordBlock(data[at[0] : at[-1]], at - at[0], NOT_SPACE, True)
                grams, edge = exact_ngrams(b.ids, n), b.first.tolist()
                for k in range(hi - lo):
                    x, y = (np.unique(grams[edge[j] : max(edge[j], edge[j + 1] - n + 1)]) for j in (2 * k, 2 * k + 1))
                    keep.append((100 + percent) * len(np.intersect1d(x, y, assume_unique=True)) >= percent * (len(x) + len(y)) > 0)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    out = written(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"))
    emptied(heads, named, pairs)
    return out


def _named(classes: DataFrame, labels: DataFrame) -> DataFrame:
    """(d, w): the first row of the component of each class d."""
    members = classes.join(labels.withColumnRenamed("id", "k"), "k", "left").select("c", "w", F.coalesce("component", "k").alias("root"))
    leads = members.groupBy("root").agg(F.min("w").alias("w"))
    return written(members.select("c", "root").join(leads, "root").select(F.col("c").alias("d"), "w"))


def _grouped(docs: DataFrame, n: int, percent: int, counted: list[int] | None = None) -> DataFrame:
    """(doc_id, h, n, w) of all rows of docs (doc_id, text, h); w: (none, doc_id, h) of the first row of the row's component, null without a set."""
    counts = docs.sparkSession.sparkContext.broadcast(_sketch(docs, n))
    described = written(_described(docs, counts, n, percent).withColumn("row", F.monotonically_increasing_id()))  # written, and fixed thereby
    counts.destroy()

    filled = described.filter("n > 0")
    classes = written(filled.groupBy("c").agg(F.min("row").alias("k"), F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "h")).alias("w")))
    nodes = written(filled.join(bounded(classes.select(F.col("k").alias("row")), 32), "row", "left_semi").select(F.col("row").alias("k"), "doc_id", "h", "n", "prefix", "second", "third", *_BITS))
    inside = F.slice("prefix", F.lit(1), (F.col("n") + 1 - F.ceil(percent * F.col("n") / 100 - 1e-9)).cast("int"))
    rows = nodes.select("k", F.posexplode(inside).alias("pos", "t"))

    # Buckets of two or more; what else their nodes need is fetched once most tokens are gone.
    buckets = rows.groupBy("t").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select(F.bitwise_not("t").alias("q"))
    several = written(rows.join(buckets, F.bitwise_not("t") == F.col("q"), "left_semi"))
    fields = ("pos", "n", "k", *_BITS)
    shared = written(several.join(nodes.select("k", "n", *_BITS), "k").select("t", F.struct(*fields).alias("r")))
    # A bucket's pivot is the node with the fewest rarer tokens.
    pivots = written(shared.groupBy("t").agg(F.min(F.struct("r.pos", "r.n", "r.k")).alias("p")))
    met = shared.select("t", F.struct("r.pos", "r.n", "r.k").alias("r")).join(pivots, "t").filter("r.k <> p.k")
    ordered = met.select(F.when(_smaller("r", "p"), F.struct("r", "p")).otherwise(F.struct(F.col("p").alias("r"), F.col("r").alias("p"))).alias("o")).select(F.col("o.r").alias("x"), F.col("o.p").alias("y"))
    with_pivot = ordered.filter(_places_allow("x", "y", percent)).select(F.col("x.k").alias("a"), F.col("y.k").alias("b"))
    first_links = _verified(_meeting(with_pivot, nodes, percent, counted), nodes, docs, n, percent)
    known = components(first_links)

    # Then all pairs of a bucket that are still apart.
    named = written(shared.select("t", "r.*").join(known.withColumnRenamed("id", "k"), "k", "left").select("t", F.struct(*fields, F.coalesce("component", "k").alias("of")).alias("r")))
    mixed = written(named.groupBy("t").agg(F.min("r.of").alias("lo"), F.max("r.of").alias("hi"), F.count(F.lit(1)).alias("size")).filter("lo <> hi").select("t", "size"))
    if mixed.isEmpty():
        by_class = _named(classes, known)
        emptied(classes, nodes, several, shared, pivots, first_links, known, named, mixed)
        return described.join(by_class, F.col("c") == F.col("d"), "left").select("doc_id", "h", "n", "w")
    split = F.col("size") > HOT if percent >= 67 else F.lit(False)  # from there on two sets that differ and link share two tokens
    few = named.join(mixed.filter(~split), "t", "left_semi").select("t", F.lit(0).cast("long").alias("u"), "r")
    many = named.join(mixed.filter(split), "t", "left_semi").withColumn("k", F.col("r.k")).join(nodes.select("k", "prefix"), "k")
    many = many.select("t", F.explode(F.slice("prefix", F.col("r.pos") + 2, F.size("prefix"))).alias("u"), "r")
    keyed = written(few.unionByName(many))
    x, y = keyed.select("t", "u", F.col("r").alias("x")), keyed.select(F.col("t").alias("t2"), F.col("u").alias("u2"), F.col("r").alias("y"))
    apart = x.join(y, (F.col("t") == F.col("t2")) & (F.col("u") == F.col("u2")) & (F.col("x.of") != F.col("y.of")) & _smaller("x", "y") & _places_allow("x", "y", percent) & _bits_allow("x", "y", percent))
    more_links = _verified(_meeting(apart.select(F.col("x.k").alias("a"), F.col("y.k").alias("b")), nodes, percent, counted), nodes, docs, n, percent)

    final = components(first_links.unionByName(more_links))
    by_class = _named(classes, final)
    emptied(classes, nodes, several, shared, pivots, first_links, known, named, mixed, keyed, more_links, final)
    return described.join(by_class, F.col("c") == F.col("d"), "left").select("doc_id", "h", "n", "w")


def jaccard_components(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", counted: list[int] | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row a document.

    Two documents link when 100 * intersection >= percent * union of their sets of word n-grams.
    counted, if given, gets the number of candidate pairs by the first order, after the second and
    after the third, for either of the two joins.
    """
    found = _grouped(keyed_rows(texts(docs, id_col, text_col)), n, percent, counted)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("w").isNull(), F.col("doc_id")).otherwise(F.col("w.doc_id")).alias("component_id"))


def drop_linked(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component: the one with the smallest id, null last.

    Of rows with one id, that with the smaller hash of its text; rows alike in id and text stay or go
    together. Documents without words stay.
    """
    found = _grouped(keyed_rows(texts(docs, id_col, text_col)), n, percent)
    first = F.col("doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("h") == F.col("w.h"))
    return without(docs, written(found.filter(F.col("w").isNotNull() & ~first).select("doc_id", "h")), id_col, text_col)
