"""The piece table against the library, and against plain merging."""

from __future__ import annotations

import random
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import sentencepiece

from tidemark.llm import pieces
from tidemark.llm.queries import PIECE_MODEL

PATH = public_tokenizers.path(PIECE_MODEL)


def test_pieces_on_mixed_characters(monkeypatch):
    """Pieces run together with blanks, marks, line ends, quotes and characters no piece has."""
    monkeypatch.setattr(pieces, "REMEMBERED_CHARS", 2000)  # the memory turns over all the time
    monkeypatch.setattr(pieces, "BLOCK_CHARS", 500)
    codec = pieces.Codec(pieces.read_model(PATH))
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rng = random.Random(1)
    alphabet = [rng.choice(codec.names[300:]) for _ in range(2000)] + list(" \n\t.,0123456789▁éß漢字'\"()\U0001f600")
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(3000)] + ["", " ", "▁", "  a", "a ", "x" * 5000]
    for text, got in zip(texts, codec.encode(texts), strict=True):
        ids = library.encode(text)
        assert got == np.array(ids, "<u4").tobytes(), text
        assert codec.decode(ids) == library.decode(ids), text


def plain_merges(scores: dict, text: str) -> list[str]:
    symbols = list(text)
    while True:
        found = [(scores[a + b], -i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in scores]
        if not found:
            return symbols
        at = -max(found)[1]
        symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]


def test_pieces_equal_plain_merging_of_odd_vocabularies():
    """Scores in any order and ties: a piece may come before its parts, or never arise."""
    rng = random.Random(4)
    for _ in range(40):
        words = {"".join(rng.choice("abc") for _ in range(rng.randrange(2, 5))) for _ in range(12)} | set("abc▁")
        vocabulary = [(w, float(rng.randrange(-9, 0)), 1) for w in sorted(words)]
        model = {"digest": b"", "pieces": vocabulary + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)], "prefix": True, "begin": 1, "end": 2, "unknown": ""}
        codec = pieces.Codec(model)
        scores = {w: s for w, s, _ in vocabulary}
        texts = ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 12))) for _ in range(200)]
        for text, got in zip(texts, codec.encode(texts), strict=True):
            want = plain_merges(scores, "▁" + text)
            ids = [codec.ids[t] if t in codec.ids else codec.bytes_at[ord(t)] for t in want]
            assert got == np.array(ids, "<u4").tobytes(), (text, want)


def test_two_models_in_one_worker():
    model = pieces.read_model(PATH)
    other = model | {"digest": b"other", "begin": 5, "prefix": False}
    a, b = (pieces.codec_of(SimpleNamespace(value=m)) for m in (model, other))
    assert a is not b and (a.begin, b.begin) == (1, 5)
    assert a is pieces.codec_of(SimpleNamespace(value=dict(model)))
    assert a.encode(["of"]) != b.encode(["of"])


def test_table_of_numbers():
    table = pieces.Hashed(4)
    table.put(np.array([1, 17, 33, 5], np.int64), np.array([1, 2, 3, 4], np.int32))
    assert table.get(np.array([33, 1, 2, 5, 17])).tolist() == [3, 1, -1, 4, 2]
    table.put(np.arange(100, 106), np.arange(6, dtype=np.int32))  # over half: starts anew
    assert table.get(np.array([1, 105])).tolist() == [-1, 5]
