"""Word-level views of Arrow text batches.

The Python-side operators of this subpackage work on the UTF-8 buffers that Arrow hands over, many
documents at a time, instead of on Python strings. A :class:`WordBlock` holds the words of a slice
of a batch as byte ranges, a 128-bit hash of every word for comparisons between blocks, and, where
asked for, each word's number among the block's distinct words, which tells equal words exactly.

Blocks are cut at about ``BLOCK_BYTES`` of text, so memory does not grow with the batch; a text that
is longer than that forms a block of its own and is still processed whole, at about 15 bytes a byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash

BLOCK_BYTES = 1 << 18

def byte_class(members: bytes, negate: bool = False) -> np.ndarray:
    """Boolean lookup table over byte values."""
    lut = np.zeros(256, bool)
    lut[list(members)] = True
    return ~lut if negate else lut


#: Words are runs of anything but space and the control characters 09-0D.
NOT_SPACE = byte_class(b" \t\n\x0b\x0c\r", negate=True)
#: Words are runs of ASCII letters, digits and non-ASCII characters.
ALNUM = byte_class(bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


#: Masks of the first bytes of a little-endian number; multipliers.
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_C = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ngram_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n entries; entry i covers words[i : i + n]. Doubling: log n passes."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    have, out = 1, words
    while have < n:
        step = min(have, n - have)
        out = mix(out[: len(out) - step] * np.uint64(0xD6E8FEB86659FD93) + out[step:] + np.uint64(have))
        have += step
    return out


def exact_ngrams(ids: np.ndarray, n: int) -> np.ndarray:
    """Numbers of all runs of n words: equal runs, and no others, have equal numbers. ids: numbers of the words."""
    out, have = ids.astype(np.int64), 1
    while have < n and len(out):
        step = min(have, n - have)
        pair = out[: max(0, len(out) - step)] * np.int64(len(ids) + 1) + out[step:]
        out, have = np.unique(pair, return_inverse=True)[1].reshape(-1), have + step
    return out


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every run of w entries."""
    have = 1
    while have < w:
        step = min(have, w - have)
        x = np.minimum(x[: len(x) - step], x[step:])
        have += step
    return x


class WordBlock:
    """The words of some consecutive texts.

    starts, ends: byte ranges of words in ``data``; hashes, hashes2: two 64-bit hashes of each word;
    first: index of each document's first word, with one closing entry.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lut: np.ndarray, lower: bool):
        self.data, self.offsets = data, offsets
        n = len(data)
        inside = lut[data]
        before, after = np.empty(n, bool), np.empty(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edges = offsets[(offsets < n)]
        before[edges] = False
        if n:
            before[0] = after[n - 1] = False
            after[offsets[(offsets > 0)] - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.inside, self.lower = inside, lower
        self._packed = _LOWER[data] if lower else data
        self.hashes, self.hashes2 = self._hashed()

    def _hashed(self) -> tuple[np.ndarray, np.ndarray]:
        """Words of up to 16 bytes are two numbers, which are mixed both ways round with the length; longer ones go through xxh3."""
        size = self.ends - self.starts
        room = np.zeros(len(self._packed) + 16, np.uint8)
        room[: len(self._packed)] = self._packed
        at = np.lib.stride_tricks.as_strided(room, (len(self._packed) + 1, 16), (1, 1))[self.starts]
        pair = np.ascontiguousarray(at).view(np.uint64).reshape(-1, 2)
        low, high = pair[:, 0] & _KEEP[np.minimum(size, 8)], pair[:, 1] & _KEEP[np.clip(size - 8, 0, 8)]
        n = size.astype(np.uint64)
        one = mix(low * _C[0] + mix(high * _C[1] + n))
        two = mix(high * _C[2] + mix(low * _C[3] + n * _C[0]))
        far = np.flatnonzero(size > 16)
        if len(far):
            raw = self._packed.tobytes()
            digests = b"".join([xxhash.xxh3_128_digest(raw[x:y]) for x, y in zip(self.starts[far].tolist(), self.ends[far].tolist(), strict=True)])
            both = np.frombuffer(digests, np.uint64).reshape(-1, 2)
            one[far], two[far] = both[:, 0], both[:, 1]
        return one, two

    @cached_property
    def ids(self) -> np.ndarray:
        """Number of each word among the distinct words of the block: equal words, and no others, have equal numbers."""
        edge = np.zeros(len(self.starts) + 1, np.int64)
        np.cumsum(self.ends - self.starts, out=edge[1:])
        words = pa.Array.from_buffers(pa.large_binary(), len(self.starts), [None, pa.py_buffer(edge), pa.py_buffer(np.ascontiguousarray(self._packed[self.inside]))])
        return words.dictionary_encode().indices.to_numpy(zero_copy_only=False)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.first))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (from 0) of a string array; nulls count as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]] if len(offsets) else raw, offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes of text each, or of one row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def blocks(column: pa.Array, lut: np.ndarray = NOT_SPACE, lower: bool = False) -> Iterator[tuple[int, int, WordBlock]]:
    """(first row, last row + 1, words) for slices of a string column."""
    data, offsets = text_buffers(column)
    for lo, hi in slices(offsets):
        yield lo, hi, WordBlock(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lut, lower)
