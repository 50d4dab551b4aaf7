"""Unigram models made by hand, since tokenizers are never trained here."""

import struct
from collections import Counter

import pytest

from keyfold.llm import pieces


def number(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(k, value):
    if isinstance(value, int):
        return number(k << 3) + number(value)
    if isinstance(value, float):
        return number(k << 3 | 5) + struct.pack("<f", value)
    return number(k << 3 | 2) + number(len(value)) + value


def model(path, parts, byte_fallback=False, trainer=b"", **normal):
    table = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{k:02X}>", 0.0, 6) for k in range(256 if byte_fallback else 0)), *parts]
    rules = {3: 1, 4: 1, 5: 1} | {int(k[1:]): v for k, v in normal.items()}
    data = b"".join(field(1, field(1, p.encode()) + field(2, score) + field(3, kind)) for p, score, kind in table)
    data += field(2, field(3, 1) + field(35, int(byte_fallback)) + trainer) + field(3, b"".join(field(k, v) for k, v in rules.items()))
    path.write_bytes(data)
    return str(path)


@pytest.fixture(scope="module")
def texts(spark):
    have = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    return [*have, "", None, " two  spaces ", "▁mark", "漢字 ☃", "a", "\n"]


@pytest.fixture(scope="module")
def parts(texts):
    """Characters and frequent runs of four, with round scores, so that many paths tie."""
    chars, runs = Counter(), Counter()
    for t in texts[:40]:
        t = "▁" + t.replace(" ", "▁")
        chars.update(t)
        runs.update(w[k : k + n] for w in t.replace("▁", " ▁").split() for n in (2, 3, 4) for k in range(len(w) - n + 1))
    return [(c, -8.0, 1) for c in sorted(chars)] + [(r, -10.0 - len(r) % 3 * 0.1, 1) for r, _ in runs.most_common(800)]


@pytest.mark.parametrize("byte_fallback", [False, True])
@pytest.mark.parametrize("normal", [{}, {"f3": 0}, {"f4": 0}])
def test_unigram_as_the_library(tmp_path, texts, parts, byte_fallback, normal):
    import sentencepiece

    path = model(tmp_path / "m.model", parts, byte_fallback, **normal)
    ours, library = pieces.Pieces(path), sentencepiece.SentencePieceProcessor(model_file=path)
    given = [t or "" for t in texts]
    ids = ours.encode(given)
    assert [x.tolist() for x in ids] == library.encode(given)
    assert ours.decode([x.tolist() for x in ids]) == [library.decode(x.tolist()) for x in ids]
    odd = [[0], [1, 5, 2], [5, 0, 0, 7], list(range(3, 40)), []]
    assert ours.decode(odd) == [library.decode(x) for x in odd]


def test_what_is_not_supported_is_refused(tmp_path, parts):
    for name, kind in (("user", {"parts": [*parts, ("[x]", 0.0, 4)]}), ("suffix", {"trainer": field(24, 1)}), ("space", {"f5": 0}), ("kind", {"trainer": field(3, 3)})):
        with pytest.raises(ValueError):
            pieces.Pieces(model(tmp_path / name, **({"parts": parts} | kind)))


def test_parity_of_bytes_that_are_no_character():
    import sentencepiece

    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    ours, library = pieces.Pieces(path), sentencepiece.SentencePieceProcessor(model_file=path)
    odd = [[3 + 0xE6, 3 + 0xBC], [3 + 0xE6, 3 + 0xBC, 400], [3 + 0xFF, 0, 3 + 0x41], [1, 2, 0], [29871, 29871, 263], [263, 1, 263]]
    assert ours.decode(odd) == [library.decode(x) for x in odd]
