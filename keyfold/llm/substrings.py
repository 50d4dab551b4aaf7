"""Substring dedup: words covered by long passages that stand earlier in the corpus are removed.

Suffixes are sampled: one starts at each anchor, the least-hash run of ``SEED`` words inside some run
of ``window`` words, so that equal windows have their anchor at the same offset wherever they stand.
Suffixes are split by their prefix, the anchor's words first. A prefix that occurs once ends there.
One that has more than ``FIT`` places does not fit into memory and is lengthened: to the right for the
windows that reach far to the right, to the left for the others, and where that does not suffice to
the whole window. The rows of many prefixes are sorted and form subtrees: a sorted array of what follows
the anchors with the lengths of common prefixes, whose intervals are the nodes of the tree, and
another of what precedes them. A window is a node of depth enough in the one and in the other; such
deep nodes with two leaves or more are the repeats, and all their leaves but the first go. A prefix
of a whole window is a deep node itself: its first leaf is a grouped minimum, which combines before it
shuffles, so a passage that stands in a third of all documents fills no task. Trees compare words;
prefixes of whole windows compare 128-bit hashes of them.

Documents whose whole text has stood earlier are told by a digest first: all their windows go, and
no other document needs them.

A window goes if its words start earlier: in a smaller doc_id, or before in the same document.
Whether a window goes is judged on the input, not on what is left. Null and empty texts have no words.
Rows with a null doc_id keep all words and make no others go. Rows that share an id are documents of
their own, the one whose text has the smaller hash first; rows alike in id and text are one document
and get equal results. Ids may be of any type that has an order. An empty table gives an empty result;
other columns are left alone, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.llm.frames import BROADCAST_BYTES, bounded, id_type, keyed_rows, lean, texts, written
from keyfold.llm.textbatch import NOT_SPACE, WordBlock, blocks, mix, ngram_hash, text_buffers

WINDOW, SEED = 20, 8
#: Places of a prefix that are held in memory together, some 500 bytes each; few enough that no task gets much more than another.
FIT = 500


def _runs(b: WordBlock, window: int, seed: int) -> tuple[np.ndarray, ...]:
    """Segments: (document, first window, number of windows, their anchor, its hash); words count from 0 in the block."""
    h, none = b.hashes, np.empty(0, np.int64)
    if len(h) < window:
        return none, none, none, none, none.view(np.uint64)
    grams = ngram_hash(h, seed)
    best = np.arange(len(h) - window + 1)
    low = grams[best].copy()
    at = best.copy()
    for k in range(1, window - seed + 1):
        new = grams[k : k + len(low)]
        better = new < low
        low[better] = new[better]
        at[better] = best[better] + k
    doc = b.doc_of_word()[: len(best)]
    whole = best + window <= b.first[doc + 1]
    starts, at, doc = best[whole], at[whole], doc[whole]
    if not len(starts):
        return none, none, none, none, none.view(np.uint64)
    new = np.ones(len(starts), bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    heads = np.flatnonzero(new)
    return doc[heads], starts[heads], np.diff(np.append(heads, len(starts))), at[heads], grams[at[heads]]


def _prefixes(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """(p, doc_id, h, at): the hash of each anchor and its place in the document."""

    def run(batches):
        np.seterr(over="ignore")
        for batch in lean(batches):
            batch = batch.filter(batch.column("doc_id").is_valid())  # here, so that the exchange of texts is the same for all
            for lo, hi, b in blocks(batch.column("text"), NOT_SPACE):
                doc, _, _, at, p = _runs(b, window, seed)
                rows = pa.array(doc + lo)
                yield pa.RecordBatch.from_arrays([pa.array(p.view(np.int64)), batch.column("doc_id").take(rows), batch.column("h").take(rows), pa.array((at - b.first[doc]).astype(np.int32))], names=["p", "doc_id", "h", "at"])

    return docs.filter("copy is null").select("doc_id", "h", "text").mapInArrow(run, f"p long, doc_id {id_type(docs)}, h long, at int")


def _copies(docs: DataFrame) -> DataFrame:
    """(doc_id, h, copy): documents whose whole text an earlier one has; all their windows start earlier there."""
    keys = docs.filter("doc_id is not null").select("doc_id", "h", F.sha2("text", 256).alias("m")).distinct()
    # Joined by the decoded key, so that both sides of the join get an exchange and a large group can be split.
    first = keys.groupBy("m").agg(F.min(F.struct("doc_id", "h")).alias("first"), F.count(F.lit(1)).alias("k")).filter("k > 1").select(F.unhex("m").alias("q"), "first")
    return keys.join(first, F.unhex("m") == F.col("q")).filter(F.struct("doc_id", "h") > F.col("first")).select("doc_id", "h", F.lit(True).alias("copy"))


def _segments(marked: DataFrame, window: int, seed: int, lengthened: bool) -> DataFrame:
    """(g, doc_id, h, start, n, off, words): n windows from start on, whose anchor is off words behind; g tells the prefix.

    marks holds 2 * place + (1 if the prefix is to be lengthened) of anchors that occur again.
    """
    half = (window - seed) // 2

    def rows_of(batch, b, lo, doc, start, n, at, g):
        raw, edge = b.data.tobytes(), b.first[doc]
        words = [raw[x:y] for x, y in zip(b.starts[start].tolist(), b.ends[start + n + window - 2].tolist(), strict=True)]
        rows = pa.array(doc + lo)
        numbers = [pa.array(x.astype(np.int32)) for x in (start - edge, n, at - start)]
        return pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), batch.column("doc_id").take(rows), batch.column("h").take(rows), *numbers, pa.array(words, pa.binary()).cast(pa.string())], names=["g", "doc_id", "h", "start", "n", "off", "words"])

    def run(batches):
        np.seterr(over="ignore")
        for batch in lean(batches):
            batch = batch.filter(batch.column("marks").is_valid())
            marks = batch.column("marks")
            lists = marks.flatten().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(marks)), np.diff(marks.offsets.to_numpy()))
            for lo, hi, b in blocks(batch.column("text"), NOT_SPACE):
                mine = (owner >= lo) & (owner < hi) & (lists % 2 == lengthened)
                if not mine.any():
                    continue
                doc, start, n, at, p = _runs(b, window, seed)
                live = np.isin(at, b.first[owner[mine] - lo] + lists[mine] // 2)
                doc, start, n, at, p = doc[live], start[live], n[live], at[live], p[live]
                if not lengthened:
                    yield rows_of(batch, b, lo, doc, start, n, at, p)
                    continue
                # To the right for windows with at most half of the spare words before the anchor, to the left for the rest.
                cut = np.clip(at - half, start, start + n)
                right, left = np.flatnonzero(cut < start + n), np.flatnonzero(cut > start)
                far, near = ngram_hash(b.hashes, window - half), ngram_hash(b.hashes, seed + half + 1)
                yield rows_of(batch, b, lo, doc[right], cut[right], (start + n - cut)[right], at[right], far[at[right]])
                yield rows_of(batch, b, lo, doc[left], start[left], (cut - start)[left], at[left], mix(near[at[left] - half - 1] + np.uint64(1)))

    schema = f"g long, doc_id {id_type(marked)}, h long, start int, n int, off int, words string"
    return marked.mapInArrow(run, schema)


def _sorted_suffixes(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): the rows in the order of their words, and how many first words each shares with the one before it."""
    bits = int(cells.max(initial=0) + 1).bit_length()
    per = max(1, 62 // bits)
    keys = []
    for k in range(0, cells.shape[1], per):
        key = np.zeros(len(cells), np.int64)
        for column in cells[:, k : k + per].T:
            key = (key << bits) | (column + 1)
        keys.append(key)
    order = np.lexsort(keys[::-1])
    same = cells[order[1:]] == cells[order[:-1]]
    common = np.where(same.all(1), cells.shape[1], same.argmin(1))
    return order, np.concatenate([np.zeros(min(1, len(order)), np.int64), common])


def _nodes(tree: tuple[np.ndarray, np.ndarray], depth: int) -> np.ndarray:
    """The node of each row in the tree cut at a depth: rows between which no common prefix is shorter."""
    order, common = tree
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < depth)
    return out


def _subtree_repeats(rows: pa.Table, window: int, seed: int) -> pa.RecordBatch:
    """(doc_id, h, start, n): runs of windows that are leaves of deep nodes, but not the first."""
    number = pc.rank(rows["doc_id"].combine_chunks(), tiebreaker="dense").to_numpy()
    h, start, n, off = (rows[c].to_numpy() for c in ("h", "start", "n", "off"))
    first = np.lexsort((start + off, h, number))  # leaves in the order of their places
    number, h, start, n, off = (x[first] for x in (number, h, start, n, off))
    rows = rows.take(pa.array(first))
    data, offsets = text_buffers(rows["words"].combine_chunks())
    b = WordBlock(data, offsets, NOT_SPACE, False)
    spread = window - seed
    ids = np.concatenate([b.ids.astype(np.int64), [-1]])
    anchor, end = b.first[:-1] + off, b.first[1:]
    ahead = anchor[:, None] + np.arange(window)
    behind = anchor[:, None] - 1 - np.arange(spread)
    after = _sorted_suffixes(ids[np.where(ahead < end[:, None], ahead, len(ids) - 1)])
    before = _sorted_suffixes(ids[np.where(behind >= b.first[:-1, None], behind, len(ids) - 1)])
    place = start + off
    gone = np.zeros((len(n), spread + 1), bool)
    for o in range(spread + 1):
        mine = np.flatnonzero((o <= off) & (o > off - n))
        node = _nodes(after, window - o)[mine] * np.int64(len(n) + 1) + _nodes(before, o)[mine]
        _, lead, of = np.unique(node, return_index=True, return_inverse=True)
        lead = mine[lead[of.reshape(-1)]]
        gone[mine, o] = (number[mine] != number[lead]) | (h[mine] != h[lead]) | (place[mine] != place[lead])
    gone = np.pad(gone[:, ::-1], ((0, 0), (1, 1)))  # later windows have smaller offsets
    row, begin = np.nonzero(gone[:, 1:] & ~gone[:, :-1])
    _, stop = np.nonzero(gone[:, :-1] & ~gone[:, 1:])
    at = pa.array(row)
    return pa.RecordBatch.from_arrays([rows["doc_id"].combine_chunks().take(at), pa.array(h[row]), pa.array((place[row] - spread + begin).astype(np.int32)), pa.array((stop - begin).astype(np.int32))], names=["doc_id", "h", "start", "n"])


def _subtrees(segments: DataFrame, window: int, seed: int) -> DataFrame:
    """Repeats within prefixes: sorted by prefix, a prefix is never cut between two calls."""

    def run(batches):
        np.seterr(over="ignore")
        held = None
        for batch in lean(batches):
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            g = held["g"].to_numpy()
            cut = int(np.searchsorted(g, g[-1])) if len(g) else 0
            if cut:
                yield _subtree_repeats(held.slice(0, cut), window, seed)
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield _subtree_repeats(held, window, seed)

    return segments.repartition("g").sortWithinPartitions("g").mapInArrow(run, f"doc_id {id_type(segments)}, h long, start int, n int")


def _windows(segments: DataFrame, window: int) -> DataFrame:
    """(k0, k1, doc_id, h, start): the windows of segments, by a 128-bit hash of their words."""

    def run(batches):
        np.seterr(over="ignore")
        for batch in lean(batches):
            for lo, hi, b in blocks(batch.column("words"), NOT_SPACE):
                n, start = (batch.column(c).slice(lo, hi - lo).to_numpy() for c in ("n", "start"))
                row = np.repeat(np.arange(len(n)), n)
                step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                keys = [pa.array(ngram_hash(x, window)[b.first[row] + step].view(np.int64)) for x in (b.hashes, b.hashes2)]
                at = pa.array(row + lo)
                yield pa.RecordBatch.from_arrays([*keys, batch.column("doc_id").take(at), batch.column("h").take(at), pa.array((start[row] + step).astype(np.int32))], names=["k0", "k1", "doc_id", "h", "start"])

    return segments.select("doc_id", "h", "start", "n", "words").mapInArrow(run, f"k0 long, k1 long, doc_id {id_type(segments)}, h long, start int")


def _kept(marked: DataFrame, window: int, with_text: bool) -> DataFrame:
    """What is left of each text; gone holds runs of windows (start, n)."""

    def run(batches):
        for batch in lean(batches):
            n_words, n_removed, digest, left = [], [], [], []
            for text, copy, gone in zip(*(batch.column(c).to_pylist() for c in ("text", "copy", "gone")), strict=True):
                words = text.encode().split()
                kept = words
                if copy and len(words) >= window:
                    kept = []
                elif gone:
                    edge = np.zeros(len(words) + 1, np.int32)
                    for g in gone:
                        edge[g["start"]] += 1
                        edge[g["start"] + g["n"] + window - 1] -= 1
                    kept = [w for w, k in zip(words, np.cumsum(edge[:-1]).tolist(), strict=True) if not k]
                joined = b" ".join(kept)
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
                digest.append(hashlib.sha256(joined).hexdigest())
                left.append(joined)
            out = [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                out.append(pa.array(left, pa.binary()).cast(pa.string()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(out, names=names)

    return marked.select("doc_id", "text", "copy", "gone").mapInArrow(run, f"doc_id {id_type(marked)}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)


def substring_dedup(docs: DataFrame, window: int = WINDOW, seed: int = SEED, fit: int = FIT, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), and what is kept if with_text; one row a document."""
    plain = keyed_rows(texts(docs, id_col, text_col))
    docs = plain.join(written(_copies(plain)), ["doc_id", "h"], "left")  # the same exchange of texts serves all joins of a query
    prefixes = _prefixes(docs, window, seed)
    # Keyed anew (~p), so that both sides of the join get an exchange and a hot prefix can be split.
    again = prefixes.groupBy("p").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select(F.bitwise_not("p").alias("q"), (F.col("k") > fit).cast("int").alias("long"))
    live = written(prefixes.join(again, F.bitwise_not("p") == F.col("q")).groupBy("doc_id", "h").agg(F.collect_set(F.col("at") * 2 + F.col("long")).alias("marks")))
    marked = docs.join(live, ["doc_id", "h"], "left").select("doc_id", "h", "text", "marks")

    hot = live.select("doc_id", "h", F.filter("marks", lambda m: m % 2 == 1).alias("marks")).filter(F.size("marks") > 0)
    held = hot.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("marks")), F.lit(0))).first()
    hot = F.broadcast(hot) if 64 * held[0] + 4 * held[1] <= BROADCAST_BYTES else hot
    lengthened = written(_segments(plain.join(hot, ["doc_id", "h"]).select("doc_id", "h", "text", "marks"), window, seed, True))
    sizes = written(lengthened.groupBy("g").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select(F.bitwise_not("g").alias("q"), (F.col("k") > fit).alias("long")))
    of = lambda long: lengthened.join(sizes.filter(F.col("long") == long), F.bitwise_not("g") == F.col("q"), "left_semi")
    trees = _subtrees(_segments(marked, window, seed, False).unionByName(of(False)), window, seed)

    windows = _windows(of(True), window)
    first = windows.groupBy("k0", "k1").agg(F.min(F.struct("doc_id", "h", "start")).alias("first"), F.count(F.lit(1)).alias("k")).filter("k > 1").select(F.bitwise_not("k0").alias("q0"), F.col("k1").alias("q1"), "first")
    # A window of very many places is one row of first; while these are few, the places need not be dealt out by window at all.
    later = windows.join(bounded(written(first), 80), (F.bitwise_not("k0") == F.col("q0")) & (F.col("k1") == F.col("q1"))).filter(F.struct("doc_id", "h", "start") > F.col("first"))
    gone = trees.unionByName(later.select("doc_id", "h", "start", F.lit(1).alias("n"))).groupBy("doc_id", "h").agg(F.collect_list(F.struct("start", "n")).alias("gone"))
    return _kept(docs.join(gone, ["doc_id", "h"], "left"), window, with_text)
