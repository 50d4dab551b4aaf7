"""Benchmark decontamination by winnowing, with DataFrame functions only.

The fingerprint of a run of ``window`` words is the least hash of its ``gram``-word runs. It depends
on these words alone, so a passage that a document shares with an item has the same fingerprint in
both, and every shared passage of ``window`` words is found. Neighbouring windows mostly share their
least hash, so a document is a short list of (fingerprint, first window, last window). That list is
joined with the distinct fingerprints of the benchmark; where it meets one, and only there, the hits
are extended to whole windows, whose words are joined with the windows of the items.

An item of fewer words than ``window`` is one window of its own length, and its fingerprint is the
hash of all its words; documents are probed for it in the same join. Items without words or without
an id are left out; items that share an id count as one.

The benchmark's own tables are sent to all executors while they fit into a bound of bytes, and
joined by an exchange beyond; both give the same rows. The ids of items are joined last, once for a
window and a document, however often the window occurs in either.

Null and empty texts have no words and are never contaminated. Ids may be of any type, null or
shared: every row is judged by its own text, so repeated rows get equal results. Ties between hashes
do not matter, since a window has one fingerprint wherever it stands. Without documents, or without
items, nothing is contaminated. Other columns are left alone, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keyfold.llm.frames import alnum_words, ascii_lower, bounded, by_row, emptied, keyed_rows, texts, without, written

WINDOW, GRAM = 13, 8
_RUNS = "array<struct<len:int,f:bigint,at:int,stop:int>>"


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once; a plain column would be pasted into every place that names it."""
    return F.get(F.transform(F.array(value), use), 0)


def _places(size: Column) -> Column:
    """0, 1 ... size - 1."""
    return F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))


def _run_hashes(hs: Column, length: int) -> Column:
    """Hashes of all runs of ``length`` word hashes."""
    return F.transform(_places(F.size(hs) - length + 1), lambda i: F.xxhash64(*(F.get(hs, i + k) for k in range(length))))


def _least(hashes: Column, length: int) -> Column:
    """Minima of all runs of ``length`` entries."""
    return F.transform(_places(F.size(hashes) - length + 1), lambda i: F.least(*(F.get(hashes, i + k) for k in range(length))))


def _fingerprints(hs: Column, length: int, window: int, gram: int) -> Column:
    """Fingerprint of each run of ``length`` words; entry i is that of the run that starts at word i."""
    return _bound(_run_hashes(hs, gram), lambda g: _least(g, window - gram + 1)) if length == window else _run_hashes(hs, length)


def _winnowed(hs: Column, length: int, window: int, gram: int) -> Column:
    """(len, f, at, stop): the windows at to stop - 1 have the fingerprint f."""

    def runs(prints: Column) -> Column:
        heads = F.filter(_places(F.size(prints)), lambda i: (i == 0) | (F.get(prints, i) != F.get(prints, i - 1)))
        return _bound(heads, lambda h: F.transform(h, lambda at, k: F.struct(F.lit(length).alias("len"), F.get(prints, at).alias("f"), at.alias("at"), F.coalesce(F.get(h, k + 1), F.size(prints)).alias("stop"))))

    return _bound(_fingerprints(hs, length, window, gram), runs)


def _words(text: str = "text") -> Column:
    return alnum_words(ascii_lower(F.col(text)))


def _hashes(ws: Column) -> Column:
    return F.transform(ws, lambda w: F.xxhash64(w))


def _item_windows(benchmark: DataFrame, window: int, gram: int) -> tuple[DataFrame, DataFrame, list[int]]:
    """Windows (len, win, wid, f), the items of each (wid, ids), and the lengths there are."""
    items = benchmark.filter("doc_id is not null").select("doc_id", _words().alias("ws")).filter(F.size("ws") > 0)
    items = items.select("doc_id", "ws", F.least(F.size("ws"), F.lit(window)).alias("len"))
    cut = items.select("doc_id", "len", F.explode(F.transform(_places(F.size("ws") - F.col("len") + 1), lambda i: F.slice("ws", i + 1, F.col("len")))).alias("part"))
    pairs = written(cut.select("doc_id", "len", F.array_join("part", " ").alias("win")).distinct())
    sizes = sorted(r["len"] for r in pairs.select("len").distinct().collect())  # at most `window` numbers
    hs = _hashes(F.split("win", " "))
    prints = reduce(lambda rest, n: F.when(F.col("len") == n, F.get(_fingerprints(hs, n, window, gram), 0)).otherwise(rest), sizes, F.lit(None).cast("long"))
    windows = written(pairs.select("len", "win").distinct().select("len", "win", F.monotonically_increasing_id().alias("wid"), prints.alias("f")))
    # Ids of a window, once for each; a window of very many items is one row here and never sent to all.
    ids = written(pairs.join(windows.select("len", "win", "wid"), ["len", "win"]).groupBy("wid").agg(F.sort_array(F.collect_set(F.col("doc_id").cast("string"))).alias("ids")))
    emptied(pairs)
    return windows, ids, sizes


def contaminated_windows(docs: DataFrame, windows: DataFrame, sizes: list[int], window: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h, n_words) of all rows, and (k, kh, at, len, wid) of all places of item windows; docs: doc_id, text, h."""
    prints = bounded(windows.select("len", "f").distinct(), 48)
    runs = F.concat(F.array().cast(_RUNS), *(_winnowed(F.col("hs"), n, window, gram).cast(_RUNS) for n in sizes))
    probes = docs.select("doc_id", "h", _hashes(_words()).alias("hs")).select("doc_id", "h", F.explode(runs).alias("r")).select("doc_id", "h", "r.*")
    met = written(probes.join(prints, ["len", "f"], "left_semi").groupBy("doc_id", "h").agg(F.collect_set(F.struct("len", "at", "stop")).alias("runs")))
    total = met.agg(F.sum(F.size("runs")), F.count("*")).first()
    hits = met.select(F.col("doc_id").alias("k"), F.col("h").alias("kh"), "runs")
    if (total[0] or 0) * 24 + total[1] * 64 <= 32 << 20:
        hits = F.broadcast(hits)

    def extended(ws: Column) -> Column:
        of = lambda r: F.transform(F.sequence(r["at"], r["stop"] - 1), lambda i: F.struct(i.alias("at"), r["len"].alias("len"), F.array_join(F.slice(ws, i + 1, r["len"]), " ").alias("win")))
        return F.struct(F.size(ws).cast("long").alias("n_words"), F.flatten(F.transform(F.coalesce("runs", F.array().cast("array<struct<len:int,at:int,stop:int>>")), of)).alias("places"))

    cut = by_row(docs, hits).select("doc_id", "h", _bound(_words(), extended).alias("x"))
    rows = written(cut.select("doc_id", "h", "x.n_words", "x.places"))
    places = rows.filter(F.size("places") > 0).select(F.col("doc_id").alias("k"), F.col("h").alias("kh"), F.explode("places").alias("p")).select("k", "kh", "p.*").distinct()
    found = written(places.join(bounded(windows.select("len", "win", "wid"), 160), ["len", "win"]).select("k", "kh", "at", "len", "wid"))
    emptied(met)
    return rows.select("doc_id", "h", "n_words"), found


def _judged(docs: DataFrame, benchmark: DataFrame, window: int, gram: int) -> DataFrame:
    windows, ids, sizes = _item_windows(benchmark, window, gram)
    rows, found = contaminated_windows(docs, windows, sizes, window, gram)
    # Words inside the union of the windows of a row: each adds what lies behind all that began before it.
    before = Window.partitionBy("k", "kh").orderBy("at", "len").rowsBetween(Window.unboundedPreceding, -1)
    spans = found.select("k", "kh", "at", "len").withColumn("behind", F.max(F.col("at") + F.col("len")).over(before))
    hit = spans.groupBy("k", "kh").agg(F.sum(F.greatest(F.lit(0), F.col("at") + F.col("len") - F.greatest("at", F.coalesce("behind", F.lit(0))))).alias("hit"))
    named = found.select("k", "kh", "wid").distinct().join(ids, "wid").groupBy("k", "kh").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("ids"))
    both = hit.join(named.select(F.col("k").alias("k2"), F.col("kh").alias("kh2"), "ids"), F.col("k").eqNullSafe(F.col("k2")) & (F.col("kh") == F.col("kh2"))).select("k", "kh", "hit", "ids")
    n_hit = F.coalesce("hit", F.lit(0)).cast("long")
    return by_row(rows, both).select(
        "doc_id", "h", "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("ids", ","), F.lit("")), 256).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated), one row a document.

    n_hit counts words inside any window that an item has too; a document is contaminated if these
    are at least a twentieth of its words.
    """
    return _judged(keyed_rows(texts(docs, id_col, text_col)), texts(benchmark, item_col, item_text), window, gram).drop("h")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without the contaminated rows, each judged by its own text."""
    bad = _judged(keyed_rows(texts(docs, id_col, text_col)), texts(benchmark, item_col, item_text), window, gram).filter("contaminated")
    return without(docs, written(bad.select("doc_id", "h")), id_col, text_col)
