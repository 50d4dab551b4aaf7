"""Quality rules: how much of a text repeats itself.

Rolling hashes of several n-gram lengths are computed over the words of many texts at once in numpy:
prefix sums of a polynomial over word hashes, of which every window of every length is a difference.
For each length, the characters inside words that a repeat of an earlier n-gram covers are measured,
and likewise the characters of lines that repeat an earlier line. Places whose hashes are equal are
compared word by word, so two different n-grams never count as one. A text is kept if the base rules
pass and each measure stays within its limit.

Null and empty texts have no words, fail the base rules (too few words) and are not kept. Rows are
judged one by one, so repeated rows, and rows that share an id or have none, each get the result of
their own text; ids may be of any type, other columns may have any name. Ties do not matter: equality
is all that counts. An empty table gives an empty result. Texts of any length are judged whole.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from keyfold.llm.frames import id_type, lean, texts
from keyfold.llm.textbatch import NOT_SPACE, WordBlock, blocks, byte_class, mix

#: Largest share, in hundredths, of word characters inside repeated n-grams, by n.
NGRAM_LIMITS = {5: 30, 7: 26, 10: 20}
#: Largest share, in hundredths, of characters in repeated lines.
LINE_LIMIT = 30
MIN_WORDS = 50

_SYMBOLS = byte_class(b"#*$%&|<>")
_DOC = np.uint64(0xA24BAED4963EE407)
_BASE = 0x9E3779B97F4A7C15


class Rolling:
    """Polynomial hashes modulo 2^64 of all runs of words, of any length, from one pass over the words."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        up, self.down = (np.full(n + 1, base, np.uint64) for base in (_BASE, pow(_BASE, -1, 1 << 64)))
        up[0] = self.down[0] = 1
        np.cumprod(up, out=up)
        np.cumprod(self.down, out=self.down)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * up[:n], dtype=np.uint64, out=self.total[1:])

    def runs(self, n: int) -> np.ndarray:
        """Entry i covers the words i to i + n - 1."""
        return (self.total[n:] - self.total[:-n]) * self.down[: len(self.total) - n]


def _sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[edges[1:]] - total[edges[:-1]]


def _covered(hits: np.ndarray, n: int, words: int) -> np.ndarray:
    """Words that lie in a window of n words starting at a hit."""
    edge = np.zeros(words + 1, np.int32)
    np.add.at(edge, hits, 1)
    np.add.at(edge, hits + n, -1)
    return np.cumsum(edge[:-1]) > 0


def repeats(block: WordBlock, rolling: Rolling, doc: np.ndarray, n: int, first_too: bool) -> np.ndarray:
    """Words covered by n-grams found twice or more in their text; without the first place unless first_too."""
    words = len(block.ids)
    if words < n:
        return np.zeros(words, bool)
    starts = np.flatnonzero(np.arange(words - n + 1) + n <= block.first[doc[: words - n + 1] + 1])
    keys = mix(rolling.runs(n)[starts] + doc[starts].astype(np.uint64) * _DOC)
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    if not same.any():
        return np.zeros(words, bool)
    a, b = starts[order[:-1][same]], starts[order[1:][same]]
    alike = doc[a] == doc[b]
    for k in range(n):
        alike &= block.ids[a + k] == block.ids[b + k]
    if not alike.all():  # hashes have collided: number the windows by their words
        keys = np.unique(np.column_stack([doc[starts], *(block.ids[starts + k] for k in range(n))]), axis=0, return_inverse=True)[1].reshape(-1)
        order = np.argsort(keys, kind="stable")
        same = keys[order[1:]] == keys[order[:-1]]
    again = np.zeros(len(keys), bool)
    again[order[1:][same]] = True
    if first_too:
        again[order[:-1][same]] = True
    return _covered(starts[again], n, words)


def _line_rules(text: str) -> tuple[int, int, int]:
    """Repeated lines, their characters, characters of all lines; lines without a word don't count."""
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    seen, n, chars = set(), 0, 0
    for x in lines:
        if x in seen:
            n, chars = n + 1, chars + len(x)
        seen.add(x)
    return n, chars, sum(map(len, lines))


def repetition_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram_limits: Mapping[int, int] = NGRAM_LIMITS, line_limit: int = LINE_LIMIT, min_words: int = MIN_WORDS) -> DataFrame:
    """One row a document: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, dup_line_chars, line_chars, dup_chars_<n> for each length, base_failed, kept."""
    limits = dict(ngram_limits)
    docs = texts(docs, id_col, text_col)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", "line_chars", *(f"dup_chars_{n}" for n in limits)]

    def run(batches):
        np.seterr(over="ignore")
        for batch in lean(batches):
            column = batch.column("text")
            for lo, hi, b in blocks(column, NOT_SPACE):
                doc, rolling = b.doc_of_word(), Rolling(b.hashes)
                lead = (b.data & 0xC0) != 0x80
                n_words = np.diff(b.first)
                chars = _sums(lead & NOT_SPACE[b.data], b.offsets)
                length = np.zeros(len(b.data) + 1, np.int64)
                np.cumsum(lead, out=length[1:])
                word_len = length[b.ends] - length[b.starts]
                n_repeat = _sums(repeats(b, rolling, doc, 3, True), b.first)
                inside = [_sums(np.where(repeats(b, rolling, doc, n, False), word_len, 0), b.first) for n in limits]
                lines = np.array([_line_rules(t) for t in column.slice(lo, hi - lo).to_pylist()], np.int64).reshape(-1, 3)
                failed = (n_words < min_words) | (100 * n_repeat > 50 * n_words)
                kept = ~failed & (100 * lines[:, 1] <= line_limit * lines[:, 2])
                for part, limit in zip(inside, limits.values(), strict=True):
                    kept &= 100 * part <= limit * chars
                numbers = [n_words, chars, _sums(_SYMBOLS[b.data], b.offsets), lines[:, 0], n_repeat, lines[:, 1], lines[:, 2], *inside]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), *(pa.array(np.ascontiguousarray(x), pa.int64()) for x in numbers), pa.array(failed), pa.array(kept)], names=["doc_id", *counts, "base_failed", "kept"])

    schema = f"doc_id {id_type(docs)}, " + ", ".join(f"{c} long" for c in counts) + ", base_failed boolean, kept boolean"
    return docs.mapInArrow(run, schema)
