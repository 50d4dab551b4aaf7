"""Token counts: batch encoding that returns lengths only.

Texts are cut at safe boundaries: before a single space or line end between two characters that are
not white space, and, inside what is still long, between a letter or digit and a punctuation mark. A
pre-tokenizer that starts a new piece at these places makes the count of a text the sum of the counts
of its parts. That is not taken for granted: a tokenizer is tried on pairs of characters of all classes
first, and a kind of boundary at which it does not add up is not used; nor is any if an added token
holds white space, takes the white space beside it, or stands only between words. Parts that recur are
encoded once; those not met yet go to the library in batches of bounded bytes. A text without any such
boundary is encoded whole.

Special strings inside texts count as the library handles them by default. Null and empty texts have 0
tokens. Ids may be null, shared or of any type: rows are counted one by one, repeated rows alike. An
empty table gives an empty result; other columns are left alone, whatever their names.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from keyfold.llm.frames import id_type, lean, texts
from keyfold.llm.textbatch import slices, text_buffers

#: Bytes of text that are cut and encoded together.
BATCH_BYTES = 1 << 20
#: Parts whose counts a worker remembers; all are forgotten when there are more.
REMEMBERED = 200_000
CALL_BYTES = 1 << 16
#: Characters of a part from which on it is cut at punctuation too.
LONG = 1000
#: Places where white space may be cut, and where letters meet punctuation. White space is Python's, which is the broadest.
_SPACES = {" ": r" (?=\S)", "\n": r"\n(?=\S)"}
_MARKS = re.compile(r"(?<=[^\W_])(?=[^\w\s])")
#: One character or two of every class that pre-tokenizers tell apart.
_TRIED = ("a", "Z", "é", "漢", "7", "٣", "²", ".", ",", "'", "s", "-", "_", "$", "“", "，", "\u0301", "\U0001f600", "'s", "ab", "12", "..")


class Counter:
    """Counts tokens of texts with a tokenizer file of the tokenizers library."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ.setdefault("RAYON_NUM_THREADS", "1")  # Spark runs a task for each core
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = self.tokenizer.get_added_tokens_decoder().values()
        plain = not any(t.lstrip or t.rstrip or t.single_word or re.search(r"\s", t.content) for t in added)
        spaces = [p for space, p in _SPACES.items() if plain and self._adds_up((x, space + y) for x in _TRIED for y in _TRIED)]
        self.spaces = re.compile(r"(?<=\S)(?=" + "|".join(spaces) + ")") if spaces else None
        inner = not any(_MARKS.search(t.content) for t in added)
        self.marks = plain and inner and self._adds_up((x, y) for x in _TRIED for y in _TRIED if _MARKS.match(x + y, len(x)))
        self.remembered, self.known = remembered, {"": 0}

    def _count(self, batch: list[str]) -> list[int]:
        return list(map(len, self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)))

    def _adds_up(self, pairs) -> bool:
        left, right = zip(*pairs, strict=True)
        return all(x + y == z for x, y, z in zip(self._count(list(left)), self._count(list(right)), self._count([a + b for a, b in zip(left, right, strict=True)]), strict=True))

    def _learn(self, parts: set[str]) -> None:
        new = [p for p in parts if p not in self.known]
        lo = size = 0
        for hi, p in enumerate(new, 1):
            size += len(p) + 1
            if size >= CALL_BYTES or hi == len(new):
                self.known.update(zip(new[lo:hi], self._count(new[lo:hi]), strict=True))
                lo, size = hi, 0

    def cut(self, text: str) -> list[str]:
        parts = self.spaces.split(text) if self.spaces else [text]
        if self.marks and any(len(p) > LONG for p in parts):
            parts = [q for p in parts for q in (_MARKS.split(p) if len(p) > LONG else [p])]
        return parts

    def __call__(self, batch: list[str]) -> list[int]:
        if len(self.known) > self.remembered:
            self.known = {"": 0}
        cut = list(map(self.cut, batch))
        every: set[str] = set()
        for c in cut:
            every.update(c)
        self._learn(every)
        get = self.known.__getitem__
        return [sum(map(get, c)) for c in cut]


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every text; path: a tokenizer file that every executor has."""

    def run(batches):
        counter = Counter(path)
        for batch in lean(batches):
            column = batch.column("text")
            _, offsets = text_buffers(column)
            for lo, hi in slices(offsets, BATCH_BYTES):
                n = np.array(counter(column.slice(lo, hi - lo).fill_null("").to_pylist()), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array(np.diff(offsets[lo : hi + 1])), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"]
                )

    docs = texts(docs, id_col, text_col)
    return docs.mapInArrow(run, f"doc_id {id_type(docs)}, n_bytes long, n_tokens long, over_limit boolean")
