"""SentencePiece encoding and decoding with the tokenizers library as the backend.

The model file, a protobuf message, is read field by field; normaliser, metaspace marker, scores and
byte fallback are rebuilt from it, for unigram models as scores and for BPE models as merges ranked
by the score of what they make. Models with user-defined pieces, with the marker at word ends or with
white space left as it is are refused with a ValueError, as are kinds other than these two.

Where no piece of a BPE model holds the marker after another character, nothing merges across the
start of a run of markers, so a normalised text is cut there. Parts that recur are encoded once; new
ones go to the library in batches, on ``threads`` threads. Other texts are encoded whole. Unigram
paths of equal score are told apart by rounding, which differs between libraries, so for unigram
models parity is verified text by text against the sentencepiece library, whose ids stand where the
two differ. Decoding looks pieces up in a table: unknown ids, control pieces and bytes that form no
character come out as that library has them.

Null texts count as empty; an empty text has no ids and decodes to an empty text. Ids of documents may
be null, shared or of any type: rows are coded one by one, repeated rows alike. An empty table gives an
empty result; other columns are left alone, whatever their names. Long texts are coded whole, never cut
anywhere else.
"""

from __future__ import annotations

import codecs
import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.llm.frames import give_back, id_type, lean, quoted, texts

MARK = "▁"
#: Kinds of pieces and of models in the file format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Parts that a worker remembers since it last forgot, besides as many from before that; parts a call; bytes of text handled together.
REMEMBERED, CALL_PARTS, BATCH_BYTES = 120_000, 5_000, 1 << 20
THREADS = 2
#: What stands for an unknown piece in a decoded text.
UNKNOWN_TEXT = " \u2047 "

codecs.register_error("each byte", lambda e: ("\ufffd" * (e.end - e.start), e.end))


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, at
        shift += 7


def message(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class Model:
    """What the file says: pieces with scores and kinds, and how texts are normalised."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        trainer, normalizer = {}, {}
        for field, value in message(data):
            if field == 1:
                piece = dict(message(value))
                self.pieces.append((piece[1].decode(), float(np.frombuffer(piece.get(2, b"\0" * 4), "<f4")[0]), piece.get(3, NORMAL)))
            elif field == 2:
                trainer = dict(message(value))
            elif field == 3:
                normalizer = dict(message(value))
        self.kind, self.byte_fallback = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0))
        self.charsmap, self.prefix, self.squeeze = normalizer.get(2, b""), bool(normalizer.get(3, 1)), bool(normalizer.get(4, 1))
        refused = {
            f"models of kind {self.kind}": self.kind not in (UNIGRAM, BPE), "user-defined pieces": any(kind == USER for _, _, kind in self.pieces),
            "the marker at word ends": bool(trainer.get(24, 0)), "white space left as it is": not normalizer.get(5, 1),
        }
        if any(refused.values()):
            raise ValueError("not supported: " + ", ".join(k for k, bad in refused.items() if bad))
        self.unknown_text = trainer.get(44, UNKNOWN_TEXT.encode()).decode()
        self.unknown = next((k for k, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)

    def merges(self) -> list[tuple[str, str]]:
        """Pairs of pieces that make a piece, best piece first; of one piece's pairs the shorter left side first."""
        usable = {p for p, _, kind in self.pieces if kind == NORMAL}
        ranked = sorted((p for p in self.pieces if p[2] == NORMAL and len(p[0]) > 1), key=lambda p: -p[1])
        return [(p[:k], p[k:]) for p, _, _ in ranked for k in range(1, len(p)) if p[:k] in usable and p[k:] in usable]

    def cuts(self) -> bool:
        """Whether no piece of a BPE model holds the marker after another character."""
        return self.kind == BPE and not any(MARK in p.lstrip(MARK) for p, _, kind in self.pieces if kind == NORMAL)


class Pieces:
    """Encodes and decodes texts as the model file says."""

    def __init__(self, path: str, threads: int = THREADS, remembered: int = REMEMBERED):
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        from tokenizers import Regex, Tokenizer, models, normalizers

        with open(path, "rb") as f:
            self.model = m = Model(f.read())
        if m.kind == UNIGRAM:
            core = models.Unigram([(p, s) for p, s, _ in m.pieces], unk_id=m.unknown, byte_fallback=m.byte_fallback)
        else:
            core = models.BPE({p: k for k, (p, _, _) in enumerate(m.pieces)}, m.merges(), unk_token=m.pieces[m.unknown][0], fuse_unk=True, byte_fallback=m.byte_fallback)
        self.tokenizer = Tokenizer(core)
        steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
        if m.squeeze:
            steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip(left=True, right=True)]
        if m.prefix:
            steps.append(normalizers.Prepend(MARK))
        self.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
        self.library = None
        if m.kind == UNIGRAM:
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        blank = lambda p: p.replace(MARK, " ").encode()
        other = {CONTROL: lambda p: b"", UNKNOWN: lambda p: m.unknown_text.encode(), BYTE: lambda p: bytes([int(p[3:-1], 16)])}
        self.table = [other.get(kind, blank)(p) for p, _, kind in m.pieces]
        self.parts = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+") if m.cuts() else None
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.remembered = remembered

    def _learn(self, parts: set[str]) -> None:
        new = []
        for p in parts:
            if p not in self.known:
                if (ids := self.older.get(p)) is None:
                    new.append(p)
                else:
                    self.known[p] = ids
        for k in range(0, len(new), CALL_PARTS):
            call = new[k : k + CALL_PARTS]
            for p, e in zip(call, self.tokenizer.encode_batch_fast(call, add_special_tokens=False), strict=True):
                self.known[p] = np.array(e.ids, np.int32).tobytes()

    def encode(self, batch: list[str]) -> list[np.ndarray]:
        if len(self.known) > self.remembered:
            self.older, self.known = self.known, {}
        if self.model.charsmap or self.model.squeeze:
            flat = [self.normalizer.normalize_str(t) if t else "" for t in batch]
        else:  # nothing but the prefix and the marker
            start = MARK if self.model.prefix else ""
            flat = [start + t.replace(" ", MARK) if t else "" for t in batch]
        cut = [self.parts.findall(t) if self.parts else [t] if t else [] for t in flat]
        every: set[str] = set()
        for c in cut:
            every.update(c)
        self._learn(every)
        get = self.known.__getitem__
        out = [np.frombuffer(b"".join(map(get, c)), np.int32) for c in cut]
        return out if self.library is None else [self._verified(t, ids) for t, ids in zip(batch, out, strict=True)]

    def _verified(self, text: str, ids: np.ndarray) -> np.ndarray:
        right = np.array(self.library.encode(text, num_threads=1), np.int32)
        return ids if np.array_equal(ids, right) else right

    def decode(self, batch: list[list[int]]) -> list[str]:
        get = self.table.__getitem__
        return [(b"".join(map(get, ids[k:])) if k == 0 else b"".join((lead, *map(get, ids[k:])))).decode("utf-8", "each byte") for ids in batch for k, lead in [self._lead(ids)]]

    def _lead(self, ids: list[int]) -> tuple[int, bytes]:
        """How many first pieces are read, and what they give without the white space that the normaliser puts before a text."""
        if not (self.model.prefix or self.model.squeeze):
            return 0, b""
        for k, i in enumerate(ids, 1):
            text = self.table[i]
            marked = self.model.pieces[i][2] not in (BYTE, UNKNOWN) and text.startswith(b" ")
            text = text[1:] if marked else text
            if text or marked and not self.model.squeeze:
                return k, text
        return len(ids), b""


def _grouped(sizes: np.ndarray, limit: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    lo = total = 0
    for hi, n in enumerate(sizes.tolist(), 1):
        total += n
        if total >= limit or hi == len(sizes):
            yield lo, hi
            lo, total = hi, 0


def encode(docs: DataFrame, path: str, threads: int = THREADS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids), one row a document; path: a model file that every executor has."""

    def run(batches):
        pieces = Pieces(path, threads)
        for batch in lean(batches):
            column = batch.column("text")
            for lo, hi in _grouped(pc.binary_length(column).to_numpy(zero_copy_only=False)):
                ids = pieces.encode(column.slice(lo, hi - lo).to_pylist())
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32)))], names=["doc_id", "ids"])

    docs = texts(docs, id_col, text_col)
    return docs.mapInArrow(run, f"doc_id {id_type(docs)}, ids array<int>")


def decode(coded: DataFrame, path: str, threads: int = THREADS, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) from ids; null ids give an empty text."""

    def run(batches):
        pieces = Pieces(path, threads)
        for batch in lean(batches):
            ids = batch.column("ids")
            for lo, hi in _grouped(np.diff(ids.offsets.to_numpy()) * 4):
                out = pieces.decode([x or [] for x in ids.slice(lo, hi - lo).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(out, pa.string())], names=["doc_id", "text"])

    coded = coded.select(quoted(id_col).alias("doc_id"), quoted(ids_col).alias("ids"))
    return coded.mapInArrow(run, f"doc_id {id_type(coded)}, text string")


def round_trip(docs: DataFrame, path: str, threads: int = THREADS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256, same), one row a document.

    Every text is encoded, its ids decoded again; same says whether the decoded text is the text.
    A text that holds the marker itself, which stands for a space, does not come back the same.
    """

    def run(batches):
        pieces = Pieces(path, threads)
        for batch in lean(batches):
            column = batch.column("text")
            for lo, hi in _grouped(pc.binary_length(column).to_numpy(zero_copy_only=False)):
                given = column.slice(lo, hi - lo).to_pylist()
                ids = pieces.encode(given)
                lists = [x.tolist() for x in ids]
                back = pieces.decode(lists)
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(lo, hi - lo), pa.array([len(x) for x in lists], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids))),
                        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back]), pa.array([a == b for a, b in zip(given, back, strict=True)]),
                    ],
                    names=["doc_id", "n_tokens", "ids", "decoded_sha256", "same"],
                )
        del pieces
        give_back()

    docs = texts(docs, id_col, text_col)
    return docs.mapInArrow(run, f"doc_id {id_type(docs)}, n_tokens long, ids array<int>, decoded_sha256 string, same boolean")


def parity(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, same): whether the ids of each text are those of the sentencepiece library."""

    def run(batches):
        import sentencepiece

        pieces, library = Pieces(path, 1), sentencepiece.SentencePieceProcessor(model_file=path)
        for batch in lean(batches):
            column = batch.column("text")
            for lo, hi in _grouped(pc.binary_length(column).to_numpy(zero_copy_only=False)):
                given = column.slice(lo, hi - lo).to_pylist()
                same = [a.tolist() == b for a, b in zip(pieces.encode(given), library.encode(given, num_threads=1), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(same)], names=["doc_id", "same"])

    docs = texts(docs, id_col, text_col)
    return docs.mapInArrow(run, f"doc_id {id_type(docs)}, same boolean")
